"""Quality classification by importance resampling.

Two generative models over hashed byte n-grams, each counted once a text: one of target text
(labelled good), one of the raw corpus.  A text's log weight is the sum of all its n-grams'
log ratios; none is left out.  The prior is relative to the corpus - every n-gram is taken as
seen ``PRIOR`` more times in raw text and in the target's share of that - so that a target of
any size is smoothed alike.  Texts are drawn
without replacement by Gumbel top-k: the k largest sums of log weight and keyed Gumbel noise.
By default k is the number of target-like texts, i.e. the sum of the weights capped at 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import table, written

#: Labelled rows that the target model is fitted on, at most; chosen by a hash of the id.
FIT_ROWS = 20_000
BUCKET_BITS = 19
#: Lengths of the n-grams.
GRAM_BYTES = (3, 4)
PRIOR = 0.5
SEED = 29
_CUTS = 64
#: Rows left when the k-th largest key is looked up directly.
DIRECT = 4096

#: Buckets are the top bits of an n-gram's length and bytes times this number (2**64 over the golden ratio).
_SPREAD = K._U(0x9E3779B97F4A7C15)
_FOLD = K.LOWER.copy()
_FOLD[K.WHITE] = 32


def _grams(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's n-grams (the edges count as spaces) and the texts' indices."""
    n = len(t)
    size = np.diff(t.offsets)
    # a space before and after each text
    at = t.offsets[:-1] + 2 * np.arange(n)
    data = np.full(len(t.data) + 2 * n, 32, np.uint64)
    inner = np.ones(len(data), bool)
    inner[at] = False
    inner[at + size + 1] = False
    data[inner] = _FOLD[t.data]
    # text and bucket in one number, of 32 bits if they fit: sorting is most of the work
    kind = np.uint32 if n <= 1 << (32 - BUCKET_BITS) else np.uint64
    owner = np.repeat(np.arange(n, dtype=kind), size + 2)
    pairs = [np.zeros(0, kind)]
    for length in GRAM_BYTES:
        m = len(data) - length + 1
        if m <= 0:
            continue
        key = np.full(m, length, np.uint64)
        for j in range(length):
            key <<= K._U(8)
            key |= data[j : m + j]
        pair = (owner[:m] << kind(BUCKET_BITS)) | ((key * _SPREAD) >> K._U(64 - BUCKET_BITS)).astype(kind)
        pairs.append(pair[owner[:m] == owner[length - 1 :]])
    pair = np.sort(np.concatenate(pairs))
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    return (pair & kind((1 << BUCKET_BITS) - 1)).astype(np.int64), (pair >> kind(BUCKET_BITS)).astype(np.int64)


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets over every text; each task sends one vector, summed on executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for t in K.slices(batch.column(0)):
                total += np.bincount(_grams(t)[0], minlength=len(total))
        parts = total.reshape(_CUTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CUTS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["cut", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cut, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[cut] = sums.get(cut, 0) + np.frombuffer(raw, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["cut", "counts"])

    # one vector a task: as many tasks as keep the cluster busy, however many files there are
    tasks = max(_CUTS, 4 * texts.sparkSession.sparkContext.defaultParallelism)
    rows = texts.coalesce(tasks).mapInArrow(count, "cut int, counts binary").repartition("cut").mapInArrow(add, "cut int, counts binary").collect()
    out = np.zeros((_CUTS, (1 << BUCKET_BITS) // _CUTS), np.int64)
    for r in rows:
        out[r.cut] += np.frombuffer(r.counts, np.int64)
    return out.ravel()


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    share = target.sum() / max(1, raw.sum())
    return np.log((target / share + PRIOR) / (raw + PRIOR))


def _kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of column ``key``, narrowed down by histograms of 1024 bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    left = k
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        step = (high - low) / 1024
        if step <= 0 or low + step <= low:
            return low
        cell = F.least(F.floor((F.col("key") - low) / step), F.lit(1023)).cast("int").alias("cell")
        found = sorted(inside.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect(), reverse=True)
        for r in found:
            if r.n >= left:
                low, high = r.a, r.b
                if low == high:
                    return low
                if r.n <= DIRECT:
                    rest = keys.where((F.col("key") >= low) & (F.col("key") <= high)).orderBy(F.col("key").desc()).limit(DIRECT).collect()
                    return rest[left - 1].key
                break
            left -= r.n


def resample(docs: DataFrame, target: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept; one row per row of ``docs``.

    ``target`` has a column ``text``.  Null and empty texts have the n-grams of an empty
    text (none) and log weight 0.  The noise depends on seed, id and text, so rows equal in both are
    drawn together: all rows that tie with the k-th are kept.  Without any row, or with an
    empty target, every weight is 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    wanted = gram_counts(target.select(F.coalesce("text", F.lit("")).alias("text")))
    ratios = log_ratios(wanted, gram_counts(rows.select("text"))) if wanted.sum() else np.zeros(1 << BUCKET_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.slices(batch.column(2)):
                grams, owner = _grams(t)
                w = np.bincount(owner, shared.value[grams], minlength=len(t)) if len(grams) else np.zeros(len(t))
                part = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(w)], names=["doc_id", "noise", "log_weight"])

    noise = F.xxhash64(F.lit(seed), "doc_id", "text").alias("noise")
    scored = rows.select("doc_id", noise, "text").mapInArrow(score, "doc_id long, noise long, log_weight double")
    uniform = (F.shiftrightunsigned("noise", 11) + 0.5) / float(1 << 53)
    scored = written(scored.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("gumbel_key")), "weights")
    if k is None:
        k = int(round(scored.agg(F.sum(F.least(F.lit(1.0), F.exp("log_weight")))).first()[0] or 0))
    if k <= 0:
        return scored.withColumn("kept", F.lit(False))
    least = _kth_largest(scored.select(F.col("gumbel_key").alias("key")), min(k, scored.count()))
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def good_texts(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Texts of at most ``fit_rows`` labelled rows that are of quality and not toxic."""
    good = labels.where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left_semi")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample(docs, good_texts(docs, table(spark, sf_dir, "labels")))
