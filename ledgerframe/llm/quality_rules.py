"""Quality rules: statistics of each text, fixed base rules, and a gradient-boosted verdict.

Statistics are computed with numpy over slices of texts.  The verdict comes from small
boosted trees with monotonic constraints, trained on a bounded sample of labelled rows and
flattened into node arrays, so that a slice is scored with a few array look-ups per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import table

#: Labelled rows that the trees are fitted on, at most; chosen by a hash of the id.
FIT_ROWS = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and their constraint: -1 quality may only fall as the feature grows, 0 free.
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_rate", -1), ("dup_line_rate", -1), ("repeat_rate", -1),
    ("upper_rate", -1), ("digit_rate", 0), ("bang_rate", -1), ("punct_rate", 0), ("wide_rate", 0), ("line_words", 0),
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONT = (np.arange(256) & 0xC0) == 0x80
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!\"'(),-./:;?@[]^_`{}~+="]] = True


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return K.per_text(mask, offsets)


def statistics(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (texts x 5) and features (texts x len(FEATURES))."""
    starts, ends, firsts = K.words(t)
    n = np.diff(firsts)
    wide = _CONT[t.data]
    before = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(wide, out=before[1:])
    chars = K.per_text((ends - starts) - (before[ends] - before[starts]), firsts)
    symbols = _count(_SYMBOL[t.data], t.offsets)
    owner = K.owners(firsts)
    hashes = K.word_hashes(t.data, starts, ends)
    # lines: cut at \n and at the texts' ends; a line counts if it holds a word
    cut = t.data == 10
    line_ends = np.flatnonzero(cut)
    bounds = np.unique(np.concatenate([t.offsets[:-1], line_ends + 1])) if len(t.data) else np.zeros(0, np.int64)
    bounds = bounds[bounds < len(t.data)]
    line_stop = np.append(bounds[1:], len(t.data))
    line_stop = line_stop - (cut[line_stop - 1] if len(bounds) else 0)
    line_words = np.searchsorted(starts, line_stop) - np.searchsorted(starts, bounds)
    line_owner = np.searchsorted(t.offsets, bounds, "right") - 1
    full = line_words > 0
    lh = K.word_hashes(t.data, bounds[full], line_stop[full]) if full.any() else np.zeros(0, np.uint64)
    lo = line_owner[full]
    key = K.mix(lh ^ K.mix(lo.astype(np.uint64) + K._U(1)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    dup_lines = np.bincount(lo[again], minlength=len(t))
    n_lines = np.bincount(lo, minlength=len(t))
    # words in three-word windows found at least twice in their text
    windows, inside = K.window_hashes(hashes, firsts, 3)
    at = np.flatnonzero(inside)
    twice = K.repeated(K.mix(windows[at] ^ K.mix(owner[at].astype(np.uint64) + K._U(1))))
    covered = np.zeros(len(hashes) + 1, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    repeats = K.per_text(covered[: len(hashes)], firsts)
    counts = np.stack([n, chars, symbols, dup_lines, repeats], axis=1).astype(np.int64)
    w, size = np.maximum(n, 1), np.maximum(np.diff(t.offsets), 1)
    rate = lambda mask: _count(mask[t.data], t.offsets) / size
    features = np.stack(
        [
            np.log1p(n), chars / w, symbols / w, dup_lines / np.maximum(n_lines, 1), repeats / w, rate(_UPPER), rate(_DIGIT),
            _count(t.data == 33, t.offsets) / w, rate(_PUNCT), rate(_CONT), n / np.maximum(n_lines, 1),
        ],
        axis=1,
    )
    return counts, features


@dataclass
class Forest:
    """All trees in flat arrays; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a row is good."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0) -> Forest:
    """Gradient boosting on the logistic loss over binned features, with the constraints of FEATURES.

    Of a constrained split, the right leaf may not exceed the left one; the midpoint bounds
    both subtrees, as usual.  With no rows or a single class the score is that class's share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        left[-1] = right[-1] = len(left) - 1
        return len(left) - 1

    margin = np.full(len(y), bias)
    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            me = node()
            weight = lambda gg, hh: float(np.clip(gg / (hh + smooth), low, high))
            G, H = g[rows].sum(), h[rows].sum()
            value[me] = rate * weight(G, H)
            if level == depth or len(rows) < 20:
                margin[rows] += value[me]
                return me
            best = (1e-6, None, None, 0.0, 0.0)
            for j, (_, sign) in enumerate(FEATURES):
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
                gain = gl**2 / (hl + smooth) + (G - gl) ** 2 / (H - hl + smooth) - G**2 / (H + smooth)
                wl, wr = np.clip(gl / (hl + smooth), low, high), np.clip((G - gl) / (H - hl + smooth), low, high)
                gain[(hl < 1) | (H - hl < 1)] = -1
                if sign < 0:
                    gain[wr > wl] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k, wl[k], wr[k])
            _, j, k, wl, wr = best
            if j is None:
                margin[rows] += value[me]
                return me
            feature[me], threshold[me] = j, float(cuts[j][k])
            go = binned[rows, j] <= k
            mid = (wl + wr) / 2
            bounded = FEATURES[j][1] < 0
            left[me] = grow(rows[go], level + 1, mid if bounded else low, high)
            right[me] = grow(rows[~go], level + 1, low, mid if bounded else high)
            return me

        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
    return Forest(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int), np.array(value, float), np.array(roots, int), bias, depth)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """Base counts of every whole text, with features, or with a score if ``forest`` is given."""
    extra = "features array<double>" if forest is None else "score double"
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + f", {extra}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.slices(batch.column(1)):
                counts, features = statistics(t)
                last = pa.array(list(features), pa.list_(pa.float64())) if forest is None else pa.array(forest.score(features))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), *(pa.array(counts[:, j]) for j in range(len(COUNTS))), last], names=["doc_id", *COUNTS, extra.split()[0]])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Fit the trees on at most ``fit_rows`` labelled rows (those with the smallest id hashes).

    Rows with a null id or quality are not used; of several texts under one id the one with
    the smallest hash is.  The sample is broadcast and collected: its size is bounded by
    ``fit_rows``.
    """
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    ids = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    ids = ids.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = {r.doc_id: r.quality for r in some.collect()}
    found = measure(ids).select("doc_id", "features").toPandas().sort_values("doc_id")
    x = np.array(found["features"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([rows[i] for i in found["doc_id"]], float))


def apply_rules(docs: DataFrame, forest: Forest, keep_from: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, ``score`` and ``kept``; one row per row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word
    windows.  Null texts have no words and fail.  Lines are cut at ``\\n``; a line counts as
    a copy if an earlier line of the text is equal and it holds a word.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, forest=forest).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= keep_from))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", *COUNTS, "base_failed", "kept", "score")
