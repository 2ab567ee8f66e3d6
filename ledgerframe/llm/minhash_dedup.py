"""MinHash near-deduplication with sequential Bayesian verification.

A text's set is its distinct shingles of ``SHINGLE`` words (A-Z lower-cased, split at ASCII
white space); a text with fewer words is one shingle; a text without words has no set and
links with nothing.  Texts with equal sets form one class.  Classes are banded; then

1. each band's bucket proposes pairs with its smallest member only; signatures of a pair
   are compared in batches, and the pair is pruned as soon as the posterior probability that
   its similarity reaches the threshold falls below ``MISS``; the likeliest pair of each
   class is verified on full sets;
2. buckets that then still hold several components are compared tile by tile (``TILE``
   members a side, so a hot bucket becomes many tasks), skipping pairs of one component and
   pairs that met in an earlier band; survivors of the same pruning are verified within
   their tile, which gets each text once and never leaves as a list of pairs.

So every pair that meets in a band is pruned by its signature, verified, or known to be
connected already; no bucket is capped.  Components follow from the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, contents, own_nodes, table, tasks_for, written

SHINGLE = 5
HASHES = 160
#: A pair at the threshold shares no band with at most this probability.
UNMET = 1e-5
#: Signature entries compared before the next look at the posterior.
STEP = 10
#: Posterior probability of reaching the threshold below which a pair is pruned.
MISS = 1e-5
#: Members a side of a tile, and shingles that they have together, about.
TILE, TILE_SHINGLES = 512, 1 << 21

_rng = np.random.default_rng(2024)
_MUL = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | K._U(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(t: K.Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, and offsets."""
    data = K.LOWER[t.data]
    starts, ends, firsts = K.words(t)
    hashes = K.word_hashes(data, starts, ends)
    windows, inside = K.window_hashes(hashes, firsts, size)
    n = np.diff(firsts)
    at = np.flatnonzero(inside)
    owner = K.owners(firsts)[at]
    values = windows[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        prefix = K.ROLL_WORDS_A.prefix(hashes)
        whole = K.ROLL_WORDS_A.spans(prefix, firsts[short], firsts[short + 1])
        values = np.concatenate([values, K.mix(whole + n[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])) if len(values) else np.zeros(0, bool)
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(t) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minima of ``HASHES`` permutations (sets x HASHES); empty sets give 0."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    x = (values >> K._U(32)).astype(np.uint32)
    starts = offsets[full]
    at = 0
    while at < len(full):  # pieces that stay in the cache
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 32_768)))
        end = starts[to] if to < len(full) else len(x)
        piece, cuts = x[starts[at] : end], starts[at:to] - starts[at]
        for k in range(HASHES):
            low = np.minimum.reduceat(piece * _MUL[k] + _ADD[k], cuts)
            out[full[at:to], k] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
        at = to
    return out


def posterior_bounds(threshold: float, miss: float = MISS) -> list[int]:
    """Fewest equal entries after each batch that keep a pair.

    With a uniform prior on the similarity s, P(s >= t | m of n equal) is the probability
    that a binomial of n + 1 trials at rate t is at most m.
    """
    bounds = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while m < n and total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        bounds.append(m)
    return bounds


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs (a[left[i]], b[right[i]]) that no batch prunes, and their equal entries."""
    at, equal = np.arange(len(left)), np.zeros(len(left), np.int32)
    for k, least in enumerate(bounds):
        if not len(at):
            break
        cut = slice(k * STEP, (k + 1) * STEP)
        equal[at] += (a[left[at], cut] == b[right[at], cut]).sum(axis=1)
        at = at[equal[at] >= least]
    return at, equal[at]


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def banding(threshold: float) -> int:
    """Signature entries a band: the most with which pairs at the threshold meet but for ``UNMET``."""
    for rows in range(8, 0, -1):
        if (1 - threshold**rows) ** (HASHES // rows) <= UNMET:
            return rows
    raise ValueError(f"{HASHES} hashes don't find pairs of similarity {threshold}")


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = HASHES // rows
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = K.mix(h ^ sig[:, b * rows + r].astype(np.uint64)) + K._U(r)
        keys[:, b] = h
    return keys


def sketch(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ca, cb) with n_shingles, key and check (hashes of the set, null if empty) and sig for text.

    A signature is null where the same task has given one for the set not long ago.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for t in K.slices(batch.column(1)):
                values, offsets = shingle_sets(t)
                sums = [np.zeros(len(t), np.uint64), np.zeros(len(t), np.uint64)]
                for s, salt in zip(sums, (1, 2)):
                    total = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(K.mix(values + K._U(salt)), out=total[1:])
                    s += total[offsets[1:]] - total[offsets[:-1]]
                key = K.mix(sums[0] ^ K.mix(sums[1])).view(np.int64)
                check = K.mix(sums[1] + K._U(3)).view(np.int64)
                n = np.diff(offsets)
                fresh = np.zeros(len(t), bool)
                if len(seen) > 1 << 17:
                    seen.clear()
                for i, v in enumerate(zip(key.tolist(), check.tolist())):
                    if n[i] and v not in seen:
                        seen.add(v)
                        fresh[i] = True
                lengths = np.where(fresh, n, 0)
                sig = signatures(values[np.repeat(fresh, n)], np.append(0, np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(t.first, len(t)) for k in (0, 2, 3)), pa.array(n.astype(np.int64)), pa.array(key, mask=n == 0), pa.array(check, mask=n == 0),
                        pa.array([s.tobytes() if f else None for s, f in zip(sig, fresh)], pa.binary()),
                    ],
                    names=["doc_id", "ca", "cb", "n_shingles", "key", "check", "sig"],
                )

    return docs.select("doc_id", "text", "ca", "cb").mapInArrow(run, "doc_id long, ca long, cb long, n_shingles long, key long, check long, sig binary")


def _bands(classes: DataFrame, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _band_keys(_sig(batch.column(1)), rows)
                node, size = (np.repeat(batch.column(k).to_numpy(), keys.shape[1]) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node), pa.array(size)], names=["band", "node", "size"])

    return classes.select("node", "sig", "n_shingles").mapInArrow(run, "band long, node long, size long")


def _pruned(pairs: DataFrame, classes: DataFrame, bounds: list[int]) -> DataFrame:
    """(a, b, equal) of the pairs that survive the sequential comparison."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                at, equal = survivors(_sig(batch.column(2)), _sig(batch.column(3)), every, every, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(equal)], names=["a", "b", "equal"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, equal int")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    near = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    both = near.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}).hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ids = b.to_pylist()
            hit = np.zeros(batch.num_rows, bool)
            for t in K.slices(batch.column(2)):
                values, offsets = shingle_sets(t)
                for i in range(len(t)):
                    row = t.first + i
                    if ids[row] != held or last is None:
                        held, last = ids[row], shingle_sets(next(K.slices(batch.column(3).slice(row, 1))))[0]
                    hit[row] = _reaches(values[offsets[i] : offsets[i + 1]], last, percent)
            some = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([a.take(some), b.take(some)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _cross_pairs(bands: DataFrame, classes: DataFrame, labels: DataFrame, bounds: list[int], band_rows: int) -> DataFrame:
    """Surviving pairs of different components within a bucket, found tile by tile.

    One row per tile and class: the classes it is still to be compared with, packed (empty
    where it is only another's partner).
    """
    placed = bands.join(labels, "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("component"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"), F.min("component").alias("c0"), F.max("component").alias("c1")]
    mixed = placed.groupBy("band").agg(*sums).where("c0 <> c1")
    blocks = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("sizes") / TILE_SHINGLES)).cast("int")
    rows = placed.join(mixed.select("band", blocks.alias("blocks")), "band")
    block = F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
    rows = rows.join(classes.select("node", "sig"), "node").select("band", "i", "j", "block", "node", "component", "sig")

    def compare(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        band, i, j, block, node, comp, sig = (np.concatenate(c) for c in zip(*rows))
        left = np.flatnonzero(block == i[0])
        right = left if i[0] == j[0] else np.flatnonzero(block == j[0])
        # a pair is compared where it first meets
        keys = _band_keys(sig, band_rows)
        me = int(np.flatnonzero(keys[0].view(np.int64) == band[0])[0])
        out_a, out_b = [], []
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            a, b = np.repeat(some, len(right)), np.tile(right, len(some))
            ok = (comp[a] != comp[b]) & ((node[a] < node[b]) if i[0] == j[0] else True)
            a, b = a[ok], b[ok]
            k, _ = survivors(sig, sig, a, b, bounds)
            a, b = a[k], b[k]
            met = (keys[a, :me] == keys[b, :me]).any(axis=1)
            out_a.append(node[a[~met]])
            out_b.append(node[b[~met]])
        return np.concatenate(out_a), np.concatenate(out_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            a, b = compare(held)
            if len(a):
                nodes = np.unique(np.concatenate([a, b]))
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                low, high = np.searchsorted(a, nodes, "left"), np.searchsorted(a, nodes, "right")
                tile = K.mix(K.mix(np.array([now[0]], np.int64).view(np.uint64) + K._U(now[1])) + K._U(now[2])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(tile, len(nodes))), pa.array(nodes), pa.array([b[i:j].tobytes() for i, j in zip(low, high)], pa.binary())], names=["tile", "node", "partners"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(6)]
            sig = _sig(batch.column(6))
            cut = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)) + 1
            for s, e in zip([0, *cut], [*cut, batch.num_rows]):
                key = (columns[0][s], columns[1][s], columns[2][s])
                if key != now and held:
                    yield from done()
                    held = []
                now = key
                held.append((*(c[s:e] for c in columns), sig[s:e]))
        if held:
            yield from done()

    # a row costs comparisons, not bytes
    tasks = tasks_for(classes.sparkSession, classes.count(), 4096)
    return rows.repartition(tasks, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "tile long, node long, partners binary")


def _verified_tiles(cross: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs of each tile; pairs that the tile's own links connect already are skipped."""
    tasks = tasks_for(texts.sparkSession, cross.count(), 2048)
    rows = cross.join(texts, "node").select("tile", "node", "partners", "text")

    def links(held: list[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        sets, root = {}, {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for part in held:
            ids = part["node"].to_pylist()
            for t in K.slices(part["text"]):
                values, offsets = shingle_sets(t)
                for i in range(len(t)):
                    sets[ids[t.first + i]] = values[offsets[i] : offsets[i + 1]]
        root.update({x: x for x in sets})
        for part in held:
            for a, packed in zip(part["node"].to_pylist(), part["partners"].to_pylist()):
                for b in np.frombuffer(packed, np.int64).tolist():
                    if find(a) != find(b) and _reaches(sets[a], sets[b], percent):
                        root[find(a)] = find(b)
                        yield max(a, b), min(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            found = list(links(held))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(tiles)) + 1
            for s, e in zip([0, *cut], [*cut, batch.num_rows]):
                if tiles[s] != now and held:
                    yield from done()
                    held = []
                now = tiles[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from done()

    return rows.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def _reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    k = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[k] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``.

    Two texts link if 100 * intersection >= percent * union.  ``component_id`` is the
    smallest id reachable (the own id for texts without words).  Nulls count as empty texts;
    null ids never name a component unless all its ids are null, and are never kept; a
    repeated row is kept wherever its id is; extra columns are ignored.  With ``by_row`` texts
    under one id are told apart by columns ``content`` and ``content2`` (two xxhash64 of the
    text, nulls as empty): of a component only the rows of the smallest id and content are
    kept.  Bands follow from ``percent``; one so low that they would miss pairs is refused.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    ca, cb = contents(text)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), ca.alias("ca"), cb.alias("cb"), text.alias("text"))
    bounds, band_rows = posterior_bounds(percent / 100), banding(percent / 100)
    sketched = written(sketch(rows), "sketch")
    classes = sketched.where("key IS NOT NULL").groupBy("key", "check").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ca", "cb")).alias("low"), F.first("sig", ignorenulls=True).alias("sig"), F.first("n_shingles").alias("n_shingles")
    )
    classes = own_nodes(written(classes.select("key", "check", F.col("low.doc_id").alias("low"), "low.ca", "low.cb", "sig", "n_shingles"), "classes"))
    bands = _bands(classes, band_rows)
    first = bands.groupBy("band").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "b")
    met = written(bands.join(first, "band").select("band", F.col("node").alias("a"), "b", "size"), "bands")
    pairs = met.where("a <> b").select("a", "b").distinct()
    colliding = met.select(F.col("a").alias("node")).distinct()
    # whole texts of the classes that meet any other
    wanted = colliding.join(classes.select("node", "low", "ca", "cb"), "node")
    # one row a node, however often its id and text are repeated: grouped by what the join is dealt by
    by = ["ca", "cb", "least", "none"]
    own = lambda c: {"least": F.coalesce(c, F.lit(0)), "none": F.col(c).isNull()}
    texts = rows.withColumns(own("doc_id")).drop("doc_id").join(wanted.withColumns(own("low")).drop("low").hint("merge"), by)
    texts = written(texts.groupBy(*by).agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "texts")
    best = _pruned(pairs, classes, bounds).groupBy("a").agg(F.max(F.struct("equal", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = written(_verified(best, texts, percent), "links")
    labels = components(links, "a", "b")
    cross = written(_cross_pairs(met.select("band", F.col("a").alias("node"), "size"), classes, labels, bounds, band_rows), "cross")
    links = written(links.union(_verified_tiles(cross, texts, percent)), "links")
    labels = components(links, "a", "b").withColumnRenamed("component", "root")
    # the smallest id of each component
    ids = classes.select("node", "key", "check", "low", "ca", "cb").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lead = F.min(F.struct(F.col("low").isNull(), "low", "ca", "cb"))
    low = ids.groupBy("root").agg(F.min("low").alias("component_id"), *([lead["ca"].alias("first_ca"), lead["cb"].alias("first_cb")] if by_row else []))
    named = ids.join(low, "root").select("key", "check", *low.columns[1:])
    out = sketched.select("doc_id", "n_shingles", "key", "check", "ca", "cb").join(named, ["key", "check"], "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.col("doc_id") == F.col("component_id")
    if by_row:
        kept = kept & (F.col("key").isNull() | ((F.col("ca") == F.col("first_ca")) & (F.col("cb") == F.col("first_cb"))))
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(kept, F.lit(False)).alias("kept")]
    return out.select(*columns, *([F.col("ca").alias("content"), F.col("cb").alias("content2")] if by_row else []))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM d
), g AS (
  SELECT DISTINCT doc_id, md5(x) AS h FROM s, unnest(s) AS u(x)
), size AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN size sa ON a = sa.doc_id JOIN size sb ON b = sb.doc_id WHERE 100 * common.n >= 85 * (sa.n + sb.n - common.n)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, edge.b FROM reach JOIN edge ON reach.y = edge.a
), low AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, low.component_id, s.doc_id = low.component_id AS kept
FROM s JOIN low ON s.doc_id = low.x
"""
