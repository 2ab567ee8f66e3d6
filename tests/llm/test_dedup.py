"""Operators 1, 4 and 9: against SQL, brute force, edge cases and a batch-by-batch index."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import minhash_dedup, registry
from ledgerframe.llm.embedding_dedup import near_vectors
from ledgerframe.llm.substring_dedup import FingerprintIndex, dedup_substrings

from ..oracle import assert_same
from .data import SF, edge_docs, edge_rows, empty_docs, lower, words


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name, sf):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    low = {}
    for n in nodes:
        low[find(n)] = min(low.get(find(n), n), n)
    return {n: low[find(n)] for n in nodes}


def shingles(text):
    w = words(lower(text))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_minhash_on_edges(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    sets = {r[0]: shingles(r[1]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    got = minhash_dedup.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])
    assert sum(r.doc_id is None for r in got) == 2 and not any(r.kept for r in got if r.doc_id is None)
    assert minhash_dedup.near_duplicates(empty_docs(spark)).collect() == []


def test_minhash_finds_a_large_group_and_its_chain(spark):
    """A chain of near copies whose ends are far apart, and a group of copies of all kinds."""
    rng = np.random.default_rng(3)
    text = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    chain = []
    for i in range(60):
        text = list(text)
        text[int(rng.integers(0, 200))] = f"new{i}"
        chain.append((i, " ".join(text)))
    group = [f"g{x}" for x in rng.integers(0, 5000, 300)]
    many = [(1000 + i, " ".join(group) + f" end{i % 50}") for i in range(1500)]
    df = spark.createDataFrame(chain + many, "doc_id long, text string").repartition(4)
    sets = {i: shingles(t) for i, t in chain}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links) | {1000 + i: 1000 for i in range(1500)}
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == want


def test_bounds_follow_the_posterior():
    bounds = minhash_dedup.posterior_bounds(0.85, 1e-5)
    assert len(bounds) == minhash_dedup.HASHES // minhash_dedup.STEP and all(a <= b for a, b in zip(bounds, bounds[1:]))
    assert 0 < bounds[-1] < 0.85 * minhash_dedup.HASHES


def brute_windows(texts, window=35, others=()):
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in [*lists, *(words(t) for t in others)] for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings_on_edges(spark):
    rows = edge_rows()
    want = Counter((r[0], n, gone, hashlib.sha256(kept.encode()).hexdigest(), kept) for r, (n, gone, kept) in zip(rows, brute_windows([r[1] for r in rows])))
    docs = edge_docs(spark)
    carried = dedup_substrings(docs, carry=("lang", "n_chars", "kept"))
    got = carried.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == want
    assert Counter((r.doc_id, r.rest.lang, r.rest.n_chars, r.rest.kept) for r in got) == Counter((r.doc_id, r.lang, r.n_chars, r.kept) for r in docs.collect())
    assert dedup_substrings(empty_docs(spark)).collect() == []


def test_index_batches(spark, tmp_path):
    """Each batch is judged against itself and all earlier ones; compaction changes nothing."""
    rows = [(r[0] if r[0] is not None else -1, r[1]) for r in edge_rows() if r[1] is None or len(r[1]) < 20_000]
    index = FingerprintIndex(spark, str(tmp_path / "index"), text_parts=3)
    old = []
    for k in range(3):
        batch = rows[k::3]
        df = spark.createDataFrame(batch, "doc_id long, text string")
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup_substrings(df, index=index).collect())
        assert got == Counter((i, *x) for (i, _), x in zip(batch, brute_windows([t for _, t in batch], others=old)))
        old += [t for _, t in batch]
        if k == 1:
            index.compact()
            assert sum(kind == "run" for kind, *_ in index.entries()) == 1


def brute_vectors(rows):
    ok = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    links = [
        (a, b) for a in ok for b in ok
        if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98
    ]
    return links


def test_vectors_on_edges(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        v = rng.normal(size=16)
        rows.append((i, v.tolist(), int(i % 2)))
        if i % 4 == 0:
            for k in range(3):
                rows.append((100 + 10 * i + k, (v + 0.03 * rng.normal(size=16)).tolist(), int(i % 2) if k else 7))
    rows += [rows[0], (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] * 16, 1), (906, [1.0] * 16, None)]
    rows += [(907, [1e-30, 2e-30], 1), (908, [1e30, 2e30], 1), (909, [5.0], 3), (910, [7.0], 3), (911, [-7.0], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string").repartition(3)
    links = brute_vectors([(a, None if b is None else [None if x is None else np.float32(x) for x in b], c) for a, b, c in rows])
    component = smallest_reachable([(r[0], i) for i, r in enumerate(rows)], [((rows[a][0], a), (rows[b][0], b)) for a, b in links])
    n = Counter(x for pair in links for x in pair)
    want = Counter((r[0], n[i], component[(r[0], i)][0], r[0] == component[(r[0], i)][0]) for i, r in enumerate(rows))
    assert len(links) >= 40
    assert Counter(tuple(r) for r in near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()) == want
    assert near_vectors(df.limit(0)).collect() == []
    alone = near_vectors(df.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert [tuple(r) for r in alone] == [(None, 0, None, False)]
