"""Operators 2, 3, 5, 6, 7, 8 and 10 against brute force, round trips and held-out rows."""

import hashlib
import json
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import chat, kernels, language_id, licenses, mixing, quality_rules, resampling, sentencepieces
from ledgerframe.llm.common import table

from .data import SF, edge_docs, edge_rows, empty_docs, lower, words

SF2 = "/root/testdata/sf0.01"


# 2: mixing


def brute_targets(sizes):
    """Water filling of {source: size} with weights 5, 2, 1 and caps of three times the size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and rest * weight[s] / free > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        capped |= over


@pytest.mark.parametrize("sf", [SF, SF2])
def test_mix_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.op2_source_mixing(spark, sf).collect()
    text = {r.doc_id: (r.source, len(words(r.text))) for r in docs.collect()}
    sizes = Counter()
    for source, n in text.values():
        sizes[source] += n
    want, taken = brute_targets(sizes), Counter()
    assert len(rows) == len(text)
    for r in rows:
        source, n = text[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source]) and r.target == pytest.approx(want[source], rel=1e-9)
        assert r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[source] += r.taken
    for source, goal in want.items():
        largest = max(n for s, n in text.values() if s == source)
        assert abs(taken[source] - goal) <= max(0.02 * goal, 0.15 * largest)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.op2_source_mixing(spark, sf).collect()))


def test_mix_on_edges(spark):
    docs = edge_docs(spark)
    got = mixing.mix_sources(docs)
    rows = got.collect()
    assert len(rows) == len(edge_rows())
    sizes = Counter()
    for r in edge_rows():
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and r.source_size == sizes[r.source] and len(r.places) == r.copies
    assert set(docs.columns) <= set(got.columns) and got.where("doc_id = 6").select("taken").distinct().count() == 1
    assert mixing.mix_sources(empty_docs(spark)).collect() == []
    none = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in none) == [(1, 0, 0), (2, 0, 0)]


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    plan = spark.createDataFrame([("a", 400), ("b", 100), (None, 11)], "source string, blocks long")
    firsts = []
    for seed in range(60):
        rows = mixing.split_tree(plan, seed, 2).collect()
        per, shard = Counter(), Counter()
        for r in rows:
            assert r.blocks >= 0
            per[r.source] += r.blocks
            shard[r.shard] += r.blocks
        assert per == {"a": 400, "b": 100, None: 11}
        assert max(shard.values()) - min(shard.values()) <= 2
        firsts.append(next(r.blocks for r in rows if r.source == "a" and r.shard == 0))
    n, k, d = 511, 400, 127
    mean, var = d * k / n, d * k / n * (n - k) / n * (n - d) / (n - 1)
    assert abs(np.mean(firsts) - mean) < 5 * (var / 60) ** 0.5 and 0.4 < np.var(firsts) / var < 2.2


def test_splitting_tree_has_a_plan_of_two_levels(spark):
    plan = spark.createDataFrame([("a", 900), ("b", 400), (None, 7)], "source string, blocks long")
    sizes = [len(mixing.split_tree(plan, 17, depth)._jdf.queryExecution().optimizedPlan().toString()) for depth in (2, 8)]
    assert sizes[1] < 1.5 * sizes[0]


def test_splitting_tree_of_many_sources(spark):
    plan = spark.range(3000).selectExpr("CAST(id AS STRING) AS source", "id % 7 AS blocks")
    per, shard = Counter(), Counter()
    for r in mixing.split_tree(plan, 1, 5).collect():
        per[r.source] += r.blocks
        shard[r.shard] += r.blocks
    assert all(per[str(i)] == i % 7 for i in range(3000)) and len(shard) == 32 and max(shard.values()) - min(shard.values()) <= 5


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permuted_blocks(spark, n):
    at = [r.at for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(n).cast("long"), F.lit("s"), 3)).alias("at")).collect()]
    assert sorted(at) == list(range(n)) and (n < 64 or at != list(range(n)))


def test_quotas_decide_which_blocks_a_shard_draws(spark, monkeypatch):
    """A shard's draws are its stretch of each source's permuted blocks; the tree's depth changes shards, not what is taken."""
    # several documents a block: with fewer, most blocks would hold none and never be drawn
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 4096)
    docs = table(spark, SF2, "documents")
    taken, shards = [], []
    for depth in (0, 2, 5):
        out = mixing.sized(docs, mixing.SEED)
        plan, _ = mixing.mix_plan(out.select("_mix.*"), depth=depth)
        quotas = defaultdict(dict)
        for r in mixing.split_tree(plan, mixing.SEED, depth).collect():
            quotas[r.source][r.shard] = r.blocks
        total = {r.source: r.blocks for r in plan.collect()}
        assert {s: sum(q.values()) for s, q in quotas.items()} == total and sum(total.values()) > 100
        rows = mixing.mix_sources(docs, depth=depth, into="m").select("doc_id", "source", "m").collect()
        blocks, words, squares = defaultdict(set), Counter(), 0
        for r in rows:
            squares += len(r.m.places) * r.m.size**2
            assert r.m.taken == r.m.size * len(r.m.places)
            for p in r.m.places:
                low = sum(q for k, q in quotas[r.source].items() if k < p.shard)
                assert low <= p.block < low + quotas[r.source][p.shard]
                blocks[r.source].add(p.block)
                words[p.shard] += r.m.size
        assert all(len(b) <= total[s] for s, b in blocks.items()) and sum(map(len, blocks.values())) > 0.6 * sum(total.values())
        mean = sum(words.values()) / (1 << depth)
        # documents are whole, so a shard's words are a sum of draws that fell to it by chance
        spread = (squares / (1 << depth)) ** 0.5
        assert len(words) == 1 << depth and all(abs(w - mean) <= 5 * spread for w in words.values())
        taken.append({r.doc_id: r.m.taken for r in rows})
        shards.append({r.doc_id: [p.shard for p in r.m.places] for r in rows})
    assert taken[0] == taken[1] == taken[2] and shards[0] != shards[1] != shards[2]


# 3: licences


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licence_base_places(spark):
    docs = table(spark, SF2, "documents").select("doc_id", "text").collect() + [(r[0], r[1]) for r in edge_rows()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(df).collect())
    assert got == Counter((i, *brute_base(t)) for i, t in docs)
    assert licenses.scan_licenses(empty_docs(spark)).collect() == []
    for r in licenses.scan_licenses(edge_docs(spark)).collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_licence_spans(spark):
    full = licenses.TEMPLATES[2][1].split()
    broken = " ".join(full[:12] + ["surprise"] + full[13:])
    texts = [(1, "Before. " + " ".join(full).upper() + " after"), (2, "x " + broken), (3, " ".join(full[:6])), (4, "Licensed under CC-BY-NC 4.0, or else"), (5, "licensed under the Creative Commons Attribution license")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert ("mit", 1, 1 + len(full), 1.0) in [tuple(s) for s in got[1].spans]
    assert "mit" in got[2].labels and 0.8 <= got[2].score < 1 and got[3].labels == "" and got[3].score == 0
    assert "cc-by-nc-4.0" in got[4].labels.split(",")


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under the gnu general public license version 4", set()),
        ("licensed under the gnu general public license version 1 only", set()),
        ("licensed under the gnu affero general public license version 2", set()),
        ("licensed under the GNU Lesser General Public License, version 3", {"lgpl"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc-4.0"}),
        ("a Creative Commons Attribution 4.0 International License", {"cc-by-4.0"}),
        ("Licensed under CC BY-SA 4.0", {"cc-by-sa-4.0"}),
        ("subject to the terms of the Mozilla Public License, v. 1.1", set()),
        ("Released under the MIT License.", {"mit"}),
    ],
)
def test_licence_labels_follow_what_decides(text, labels):
    row = licenses.Scanner().scan(next(kernels.slices(pa.array([text]))))[0]
    assert {s["label"] for s in row[7]} == labels


def test_licence_template_texts_are_found_and_told_apart():
    scanner = licenses.Scanner()
    texts = [" ".join(licenses._parsed(t)[0]) for _, t in licenses.TEMPLATES]
    rows = scanner.scan(next(kernels.slices(pa.array(texts), 1 << 20)))
    for (label, _), text, row in zip(licenses.TEMPLATES, texts, rows):
        assert (label, 0, len(text.split()), 1.0) in [tuple(s.values()) for s in row[7]]
        # another label only where its template lies within this text
        assert all(any(k == s["label"] and text.find(t) >= 0 for (k, _), t in zip(licenses.TEMPLATES, texts)) or s["cover"] < 1 for s in row[7])


def test_licence_stretches_lose_no_match():
    rng = np.random.default_rng(3)
    scanner = licenses.Scanner()
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses._parsed(t)[0]})
    parts = [licenses._parsed(t)[0] for _, t in licenses.TEMPLATES]
    for _ in range(60):
        said = []
        while len(said) < 200:
            t = parts[rng.integers(len(parts))]
            a = rng.integers(len(t))
            said += t[a : a + rng.integers(1, 40)] + list(rng.choice([*vocabulary, "other"], rng.integers(0, 5)))
        t = next(kernels.slices(pa.array([" ".join(said)])))
        starts, ends, firsts = kernels.words(t)
        ids = scanner.numbers(kernels.word_hashes(t.data, starts, ends))
        cuts = [-1, *np.flatnonzero(ids < 0).tolist(), len(ids)]
        whole = [(a + 1, ids[a + 1 : b].tolist()) for a, b in zip(cuts, cuts[1:]) if b > a + 1]
        some = [(a, ids[a:b].tolist()) for a, b in scanner.stretches(ids, np.full(len(ids), len(ids)))]
        assert scanner.spans(some) == scanner.spans(whole)


def test_automaton_gives_matching_statistics():
    rng = np.random.default_rng(1)
    templates = [rng.integers(0, 3, 12).tolist() for _ in range(4)]
    automaton = licenses.SuffixAutomaton(templates)
    subs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    text = rng.integers(0, 4, 200).tolist()
    want = [max([k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in subs], default=0) for i in range(len(text))]
    found = list(automaton.statistics(text))
    assert [n for n, _ in found] == want
    for i, (n, state) in enumerate(found):
        if n:
            ends = {k: min(e for e in range(n, len(t) + 1) if t[e - n : e] == text[i + 1 - n : i + 1]) for k, t in enumerate(templates) if tuple(text[i + 1 - n : i + 1]) in {tuple(t[a : a + n]) for a in range(len(t))}}
            assert automaton.ends[state] == ends


# 5: pieces


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces.load()


def naive(model, ids_of, text, skip):
    """One merge at a time over a whole text: best score, leftmost; candidates that ``skip`` names are left out."""
    s = ["▁"] + ["▁" if c == " " else ("\0" + c if c == "▁" else c) for c in text]
    at = [0] + [1 + len(text[:i].encode()) for i in range(len(text))]
    while True:
        best = None
        for i in range(len(s) - 1):
            joined = ids_of.get(s[i] + s[i + 1])
            if joined is not None and s[i] in ids_of and s[i + 1] in ids_of and not skip(at[i], ids_of[s[i]], joined):
                key = (-model.get_score(joined), i)
                best = min(best or (key, i), (key, i))
        if best is None:
            break
        i = best[1]
        s[i : i + 2] = [s[i] + s[i + 1]]
        del at[i + 1]
    out = []
    for x in s:
        out += [ids_of[x]] if x in ids_of else [3 + b for b in (x[1:] if x == "\0▁" else x).encode()]
    return out


def test_pieces_equal_the_library_and_a_naive_agenda(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    ids_of = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}
    texts = [t for _, t, *_ in edge_rows() if t] + ["aaaa" * 30, " " * 70, "    indented\n\n\tcode();", "<s>[INST] x</s>", "ﬁ　é́", "\u0000\u007f퟿\U0010ffff"]
    ids, offsets = pieces.encode(next(kernels.slices(pa.array(texts), 1 << 24)), np.zeros(len(texts)))
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert [g for g, t in zip(got, texts) if "▁" not in t] == [model.encode(t) for t in texts if "▁" not in t]
    assert pieces.decode(ids, offsets) == texts
    short = [t[:90] for t in texts]
    keys = np.arange(len(short))
    for rate in (0.1, 0.5, 0.9):
        ids, offsets = pieces.encode(next(kernels.slices(pa.array(short), 1 << 24)), keys, rate)
        assert pieces.decode(ids, offsets) == short
        for k, t in enumerate(short):
            base = lambda place: kernels.mix(kernels.mix(np.array([k], np.uint64)) + np.uint64(place))  # noqa: B023, E731
            skip = lambda place, left, into: bool(pieces._skipped(base(place), np.array([left]), np.array([into]), rate)[0])  # noqa: B023, E731
            assert ids[offsets[k] : offsets[k + 1]].tolist() == naive(model, ids_of, t, skip), t


def test_pieces_of_documents(spark, pieces):
    rows = sentencepieces.op5_sentencepieces(spark, SF).collect()
    assert len(rows) == 200 and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    docs = edge_docs(spark)
    runs = [sentencepieces.encode_pieces(d, pieces, rate, seed) for d, rate, seed in ((docs, 0.1, 1), (docs.repartition(7), 0.1, 1), (docs, 0.1, 2), (docs, 0.0, 1))]
    ids = [Counter((r.doc_id, tuple(r.ids) if r.ids is not None else None, r.n_tokens) for r in d.select("doc_id", "ids", "n_tokens").collect()) for d in runs]
    assert ids[0] == ids[1] and ids[0] != ids[2]
    long = [next(n for (i, _, n) in c if i == 12) for c in ids]
    assert long[3] < long[0] < 1.5 * long[3]
    assert set(docs.columns) <= set(runs[0].columns)
    back = sentencepieces.decode_pieces(runs[0], pieces, to="size")
    assert back.where("NOT (size <=> text)").count() == 0 and back.count() == len(edge_rows())
    assert sentencepieces.encode_pieces(empty_docs(spark), pieces).collect() == []
    with pytest.raises(ValueError):
        sentencepieces.encode_pieces(docs, pieces, 1.0)
    with pytest.raises(Exception, match="no such piece"):
        sentencepieces.decode_pieces(spark.createDataFrame([([32000],)], "ids array<int>"), pieces).collect()
    assert sentencepieces.decode_pieces(spark.createDataFrame([([1, 28705, 0, 2],)], "ids array<int>"), pieces).first().decoded == " ⁇ "


def test_long_texts_are_cut_without_a_change(pieces, monkeypatch):
    text = next(t for _, t, *_ in edge_rows() if t and len(t) > 100_000)
    t = next(kernels.slices(pa.array([text]), 1 << 24))
    whole, _ = pieces.encode(t, np.array([5]), 0.2)
    monkeypatch.setattr(sentencepieces, "SLICE_BYTES", 9999)
    parts = [pieces.encode(kernels.Texts(d, np.array([0, len(d)]), 0), np.array([5]), 0.2, np.array([at]))[0] for d, at in sentencepieces._segments(t)]
    assert len(parts) > 10 and np.concatenate(parts).tolist() == whole.tolist()


# 6: quality rules


def brute_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(w)
    failed = n < 50 or 100 * len(repeat) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), failed


def test_quality_counts(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF2, "documents").collect()] + [(r[0], r[1]) for r in edge_rows()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    forest = quality_rules.train(table(spark, SF2, "documents"), table(spark, SF2, "labels"))
    rows = quality_rules.apply_rules(df, forest).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality_rules.COUNTS), r.base_failed) for r in rows) == Counter((i, *brute_counts(t)) for i, t in docs)
    assert not any(r.kept and r.base_failed for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality_rules.apply_rules(empty_docs(spark), forest).collect() == []


def test_quality_verdict_on_unseen_rows(spark):
    docs, labels = table(spark, SF2, "documents"), table(spark, SF2, "labels")
    seen = F.col("doc_id") % 2 == 0
    forest = quality_rules.train(docs, labels.where(seen))
    rows = quality_rules.apply_rules(docs, forest).join(labels.where(~seen), "doc_id").select("kept", "score", "quality", "base_failed").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.9


def test_forest_is_monotone_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality_rules.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (rng.random(2000) < 0.1)).astype(float)
    forest = quality_rules.fit(x, y)
    for j, (_, sign) in enumerate(quality_rules.FEATURES):
        if sign < 0:
            grid = np.repeat(x[:50], 21, axis=0)
            grid[:, j] = np.tile(np.linspace(0, 1, 21), 50)
            assert (np.diff(forest.score(grid).reshape(50, 21), axis=1) <= 1e-12).all()
    assert np.mean((forest.score(x) > 0.5) == (y == 1)) > 0.85
    for y in (np.ones(5), np.zeros(0)):
        assert len(set(quality_rules.fit(x[: len(y)], y).score(x[:3]))) == 1


# 7: importance resampling


def brute_weights(texts, target):
    def grams(text):
        data = b" " + bytes(32 if b in (9, 10, 11, 12, 13, 32) else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()) + b" "
        return {data[i : i + n] for n in resampling.GRAM_BYTES for i in range(len(data) - n + 1)}

    def bucket(g):
        return (int.from_bytes(bytes([len(g)]) + g, "big") * 0x9E3779B97F4A7C15 % 2**64) >> (64 - resampling.BUCKET_BITS)

    of = [{bucket(g) for g in grams(t)} for t in texts]
    raw, good = Counter(b for s in of for b in s), Counter(b for t in target for b in {bucket(g) for g in grams(t)})
    share = sum(good.values()) / max(1, sum(raw.values()))
    ratio = lambda b: np.log((good[b] / share + resampling.PRIOR) / (raw[b] + resampling.PRIOR))
    return [sum(ratio(b) for b in s) for s in of]


def test_resampling_weights_and_top_k(spark):
    rows = edge_rows()
    rows = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    df = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    target = df.where("doc_id >= 120")
    want = brute_weights([r[1] for r in rows], [r[1] for r in rows if r[0] is not None and r[0] >= 120])
    got = resampling.resample(df, target, k=20).collect()
    assert sorted(round(r.log_weight, 6) for r in got) == pytest.approx(sorted(want), abs=1e-5) and len(got) == len(rows) and sum(abs(x) > 1 for x in want) > len(want) / 2
    least = sorted((r.gumbel_key for r in got), reverse=True)[19]
    assert all(r.kept == (r.gumbel_key >= least) for r in got)
    assert resampling.resample(empty_docs(spark), target).collect() == []
    assert {r.log_weight for r in resampling.resample(df, target.limit(0)).collect()} == {0.0}
    assert not any(r.kept for r in resampling.resample(df, target, k=0).collect())


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    keys = np.concatenate([rng.gumbel(size=9000), np.full(2000, 0.25), [-1e9, 1e9]])
    df = spark.createDataFrame([(float(x),) for x in keys], "key double")
    for k in (1, 2, 3000, 6000, 11002):
        assert resampling._kth_largest(df, k) == np.sort(keys)[::-1][k - 1]


def auc(good, bad):
    """The chance that a good row's value is above a bad row's."""
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


#: On unseen halves: the least AUC, the least share of good rows kept, the largest share of bad rows kept.
UNSEEN = {SF2: (0.75, 0.7, 0.4), "/root/testdata/sf0.1": (0.85, 0.8, 0.3)}


@pytest.mark.parametrize("sf", UNSEEN)
def test_resampling_tells_unseen_documents_apart(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen = F.col("doc_id") % 2 == 0
    rows = resampling.resample(docs, resampling.good_texts(docs, labels.where(seen))).join(labels.where(~seen), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rows if r.quality == 0 or r.toxic == 1]
    least, kept, left = UNSEEN[sf]
    assert auc([r.log_weight for r in good], [r.log_weight for r in bad]) >= least
    assert np.mean([r.kept for r in good]) > kept and np.mean([r.kept for r in bad]) < left


def test_resampling_counts_every_ratio():
    ratios = resampling.log_ratios(np.array([9, 4, 0, 7]), np.array([10, 10, 10, 10]))
    assert np.all(ratios != 0)
    assert np.all(ratios[[0, 3]] > 0) and np.all(ratios[[1, 2]] < 0)


@pytest.mark.parametrize("sf", [SF, SF2, "/root/testdata/sf0.1"])
def test_resampling_mostly_leaves_bad_documents(spark, sf):
    rows = resampling.op7_importance_resampling(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    bad = [r for r in rows if r.quality == 0 or r.toxic == 1]
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.median([r.log_weight for r in bad]) < np.median([r.log_weight for r in good])
    assert np.mean([r.kept for r in bad]) < 0.4 and np.mean([r.kept for r in good]) > 0.8


# 8: language


def test_language_on_held_out_documents(spark):
    docs = table(spark, SF2, "documents")
    rows = language_id.op8_language_id(spark, SF2).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 100 and np.mean([r.lang_pred == r.lang for r in unseen]) > 0.97
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_uses_the_text_alone(spark):
    docs = edge_docs(spark)
    filters = language_id.learn(table(spark, SF2, "documents"))
    got = language_id.identify(docs, filters).collect()
    assert len(got) == len(edge_rows())
    changed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s"), "doc_id": F.col("doc_id") + 1})
    assert Counter((r.doc_id, r.lang_pred, r.score) for r in got) == Counter((None if r.doc_id is None else r.doc_id - 1, r.lang_pred, r.score) for r in language_id.identify(changed, filters).collect())
    text = defaultdict(set)
    for r in edge_rows():
        text[r[0]].add(any(c.isalpha() for c in r[1] or ""))
    for r in got:
        assert (r.lang_pred != "und") in text[r.doc_id] and 0 <= r.score <= 1
    kept = language_id.identify(docs, filters, keep=True)
    assert kept.columns == [*[c for c in docs.columns if c not in ("lang_pred", "score")], "lang_pred", "score"]
    nothing = language_id.learn(empty_docs(spark))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty_docs(spark), filters).collect() == []


def test_filter_has_every_learned_gram_and_few_others(spark):
    filters = language_id.learn(table(spark, SF2, "documents"))
    assert (filters.false_rate < 0.2).all() and (filters.coverage > 0.5).all()
    t = next(kernels.slices(pa.array(["the of and that"])))
    total, hits = filters.hits(t)
    assert hits[0].max() <= total[0] and hits[0, filters.languages.index("en")] >= 0.8 * total[0]


def test_ngrams_come_in_blocks(monkeypatch):
    """Whatever the block, each text's n-grams are those of the whole text, and memory doesn't follow the text."""
    texts = ["Straße of the and", "", None, "the", "no 1 x", "日本 and so on"] * 3
    filters = language_id.Filters(["a", "b"], np.arange(1 << language_id.SLOT_BITS, dtype=np.uint64)[None], np.full(2, 0.1), np.full(2, 0.5))
    (t,) = kernels.slices(pa.array(texts))
    want, ratios = [], filters.hits(t)
    for s in texts:
        low = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in lower(s or "").encode())
        three = sum(low[i + 1] != 32 and (low[i] != 32 or low[i + 2] != 32) for i in range(len(low) - 2))
        want.append(three + sum(low[i + 1] != 32 != low[i + 2] for i in range(len(low) - 3)))
    assert ratios[0].tolist() == want
    for block in (1, 2, 3, 5, 16):
        monkeypatch.setattr(language_id, "BLOCK", block, raising=False)
        assert all((a == b).all() for a, b in zip(filters.hits(t), ratios))
    monkeypatch.undo()
    (t,) = kernels.slices(pa.array(["some words of a long document " * 100_000]))
    tracemalloc.start()
    total, _ = filters.hits(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total[0] > 4_000_000 and peak < 10e6


# 10: chat


def brute_digest(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    whole = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in rows)
    loss = "".join(text or "" for _, _, role, text in rows if role == "assistant")
    return len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_reads_back_every_conversation(spark):
    rows = [tuple(r) for r in table(spark, SF2, "conversations").select("conv_id", "turn", "role", "text").collect()] + list(chat.PROBE)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    got = chat.op10_chat_format(spark, SF2).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {k: brute_digest(v) for k, v in by.items()} and len(got) == len(by)


def test_chat_on_edges(spark):
    nasty = "<|turn|>user<|says|>\\<|done|>[INST]\\\\ </s>\n"
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "user", nasty), (3, 0, None, None), (None, 0, "assistant", "a"), (4, None, "assistant", "first"), (4, 0, "user", "x" * 300_000),
        (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (6, 0, nasty, "role"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string").repartition(3)
    examples = chat.format_chat(df).collect()
    mine = sorted((e for e in examples if e.conv_id == 1), key=lambda e: e.example)
    assert [e.complete for e in mine] == [False, True] and len(mine) == 2
    assert [chat.unescape(e.text[e.loss_start : e.loss_end]) for e in mine] == [nasty, ""]
    assert [t for t in chat.read_turns(mine[1].text)] == [("user", "q"), ("assistant", nasty), ("user", ""), ("assistant", "")]
    assert mine[1].text.startswith(mine[0].text)
    for e in examples:
        n = len(chat.read_turns(e.text))
        assert [e.text.count(x) for x in ("<|turn|>", "<|says|>", "<|done|>", "</s>", "[INST]")] == [n, n, n, 0, 0]
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(df)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: brute_digest(v) for k, v in by.items()}
    assert all(r.formatted_chars == sum(len(e.text) for e in examples if e.conv_id == k) for k, r in got.items())
    assert chat.format_chat(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        chat.read_turns("loose text")
    assert json.dumps(chat.read_turns("")) == "[]"
