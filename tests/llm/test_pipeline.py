"""The pipeline's stages against brute force, and the query list."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from ledgerframe.llm import registry
from ledgerframe.llm.common import table
from ledgerframe.llm.mixing import mix_sources
from ledgerframe.llm.sentencepieces import Pieces, decode_pieces

from .data import SF, edge_docs, edge_rows, empty_docs, words
from .test_dedup import brute_windows, shingles, smallest_reachable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


def bag(df, columns=COLUMNS):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("edges", [False, True])
def test_language_stage(spark, documents, edges):
    docs = edge_docs(spark) if edges else documents
    got = P.language(spark, docs, SF)
    assert got.columns == docs.columns
    want = Counter((r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert bag(got, ["doc_id", "text"]) == want and {r.lang for r in got.collect()} <= {"de", "en", "es", "fr"}


@pytest.mark.parametrize("edges", [False, True])
def test_near_copies_stage(spark, documents, edges):
    docs = edge_docs(spark) if edges else documents
    rows = [tuple(r) for r in docs.collect()]
    # a null id is an id of its own for every text, below all others
    nodes = {(r[0] is not None, r[0] or 0, "" if r[0] is not None else r[1] or ""): shingles(r[1]) for r in rows}
    order = sorted(nodes)
    sets = [nodes[n] for n in order]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = smallest_reachable(range(len(sets)), links)
    want = Counter(n[1] if n[0] else None for i, n in enumerate(order) if low[i] == i)
    got = P.near_copies(spark, docs, SF)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    assert bag(got) - bag(docs) == Counter()


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_near_copies_stage_at_80(spark, sf):
    docs = table(spark, sf, "documents")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    low = smallest_reachable(sets, links)
    assert {r.doc_id for r in P.near_copies(spark, docs, sf).collect()} == {i for i in sets if low[i] == i}


def test_near_copies_stage_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(3, a), (7, a + " end"), (7, b), (7, b), (9, c), (9, c + " end"), (None, "one"), (None, "two"), (11, ""), (11, "...")]
    got = P.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()
    left = Counter((r.doc_id, r.text.removesuffix(" end")) for r in got)
    assert left == Counter([(3, a), (7, b), (9, c), (None, "one"), (None, "two"), (11, ""), (11, "...")])


@pytest.mark.parametrize("edges", [False, True])
def test_passages_stage(spark, documents, edges):
    docs = edge_docs(spark) if edges else documents
    rows = docs.select(*COLUMNS).collect()
    got = P.passages(spark, docs, SF)
    kept = [t for *_, t in brute_windows([r.text for r in rows])]
    assert got.columns == docs.columns and bag(got) == Counter((r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(rows, kept))


@pytest.mark.parametrize("edges", [False, True])
def test_mix_and_pieces_stages(spark, documents, edges):
    docs = edge_docs(spark) if edges else documents
    got = P.mix(spark, docs, SF)
    taken = Counter()
    for r in mix_sources(docs).select(*COLUMNS, "copies").collect():
        taken[tuple(r)[:-1]] += r.copies
    assert got.columns == docs.columns and bag(got) == +taken
    out = P.pieces(spark, docs, SF)
    back = decode_pieces(out, Pieces.load(), to="back")
    assert out.columns == [*[c for c in docs.columns if c not in ("ids", "n_tokens")], "ids", "n_tokens"] and back.where("NOT (back <=> text)").count() == 0


def test_stages_keep_every_column(spark):
    """Columns with any name and type pass through; stages change texts, their lengths and languages only."""
    docs = edge_docs(spark).withColumns({"at": F.lit("2024-01-02 03:04:05.123456").cast("timestamp"), "by": F.create_map(F.lit(1), F.col("source"))})
    others = [c for c in docs.columns if c not in ("text", "lang", "n_chars")]
    held = {repr(r) for r in docs.select(*others).collect()}
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.schema["at"] == docs.schema["at"]
        found = {repr(r) for r in got.select(*others).collect()}
        assert found and found <= held


def test_stages_on_no_rows(spark):
    for _, stage in P.STAGES:
        assert stage(spark, empty_docs(spark), SF).collect() == []


def test_run_is_the_stages_in_turn(spark, documents):
    docs = documents
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    ran = P.run(spark, SF)
    assert ran.columns == [*COLUMNS, "ids", "n_tokens"]
    key = lambda df: Counter((r.doc_id, r.text, tuple(r.ids)) for r in df.collect())
    found = key(ran)
    assert found == key(docs) and len(found) > 100 and max(found.values()) <= 3
    assert sum(n * len(words(t)) for (_, t, _), n in found.items()) > 1000


def test_query_list():
    found = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert [k for k, _ in P.STAGES] == ["language_id", "minhash_dedup", "substring_dedup", "source_mixing", "sentencepieces"] and len(edge_rows()) > 50
