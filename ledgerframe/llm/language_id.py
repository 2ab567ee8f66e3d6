"""Language identification with language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: slot ``i`` holds a mask with one bit per
language, an n-gram sets its language's bit in ``PROBES`` slots, and the AND of those slots
gives every language that contains the n-gram in one look-up.  Per-language popcounts over a
text's n-grams are corrected for the filter's false positives and for how much of its own
text each language's n-gram set covers; the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import table

#: About so many documents per language are learned from, chosen by a hash of the id.
FIT_DOCS = 1_000
#: N-grams rarer than this share of a language's n-grams are not in its set, which
#: therefore has at most 1 / RARE members.
RARE = 4e-5
SLOT_BITS = 18
PROBES = 2
#: Places of a text whose n-grams are held at a time.
BLOCK = 1 << 15
UNKNOWN = "und"

_SPACE = np.full(256, 32, np.uint8)
_SPACE[65:91] = np.arange(97, 123)
_SPACE[97:123] = np.arange(97, 123)
_SPACE[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _grams(t: K.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte 4-grams and 3-grams of letters, word edges being spaces, and their texts' indices.

    They come by ``BLOCK`` places where n-grams start, so that memory follows neither the
    slice nor its longest document.
    """
    for a in range(0, len(t.data) - 2, BLOCK):
        raw = t.data[a : a + BLOCK + 3]
        first, end = np.searchsorted(t.offsets, [a, a + len(raw) - 1], "right") - [1, 0]
        data = _SPACE[raw].astype(np.uint32)
        owner = np.repeat(np.arange(first, end), np.diff(np.clip(t.offsets[first : end + 1], a, a + len(raw))))
        three = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        ok3 = (owner[:-2] == owner[2:]) & (data[1:-1] != 32) & ((data[:-2] != 32) | (data[2:] != 32))
        ok3[BLOCK:] = False  # it starts in the next block
        four = (three[:-1] << 8) | data[3:]
        ok4 = (owner[:-3] == owner[3:]) & (data[1:-2] != 32) & (data[2:-1] != 32)
        yield np.concatenate([three[ok3], four[ok4]]), np.concatenate([owner[:-2][ok3], owner[:-3][ok4]])


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    h = K.mix(grams.astype(np.uint64) + K._U(0x9E3779B9))
    return [((h >> K._U(20 * k)) & K._U((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(PROBES)]


def has_letter(t: K.Texts) -> np.ndarray:
    found = K.per_text(_ASCII_LETTER[t.data], t.offsets) > 0
    for i in np.flatnonzero(~found):
        raw = t.data[t.offsets[i] : t.offsets[i + 1]].tobytes()
        found[i] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return found


@dataclass
class Filters:
    """The bit-sliced filter: ``planes[k][slot]`` has bits for languages 64 k to 64 k + 63."""

    languages: list[str]
    planes: np.ndarray
    false_rate: np.ndarray
    coverage: np.ndarray

    def hits(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """N-grams per text, and how many of them each language contains (texts x languages)."""
        total = np.zeros(len(t))
        out = np.zeros((len(t), len(self.languages)))
        for grams, owner in _grams(t):
            if not len(grams):
                continue
            low = int(owner.min())
            owner = owner - low
            n = int(owner.max()) + 1
            total[low : low + n] += np.bincount(owner, minlength=n)
            slots = _slots(grams)
            for k, plane in enumerate(self.planes):
                mask = plane[slots[0]]
                for s in slots[1:]:
                    mask &= plane[s]
                for j in range(64 * k, min(64 * k + 64, len(self.languages))):
                    bit = (mask >> K._U(j - 64 * k)) & K._U(1)
                    out[low : low + n, j] += np.bincount(owner, bit.astype(float), minlength=n)
        return total, out

    def predict(self, t: K.Texts) -> tuple[list[str], np.ndarray]:
        known = has_letter(t)
        if not self.languages:
            return [UNKNOWN] * len(t), np.zeros(len(t))
        total, hits = self.hits(t)
        n = np.maximum(total, 1)[:, None]
        share = np.clip((hits / n - self.false_rate) / (1 - self.false_rate), 0, None) / self.coverage
        best = np.argmax(share, axis=1)
        score = np.clip(share.max(axis=1) / np.maximum(share.sum(axis=1), 1e-12), 0, 1)
        score[~known] = 0.0
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], score


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Filters:
    """Fit the filters on a bounded sample of documents that aren't held out and have a language.

    N-grams of the sample are counted on the executors; only those above ``RARE`` of their
    language's total come to the driver, at most 1 / RARE per language.
    """
    mine = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in mine.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((0, 1 << SLOT_BITS), np.uint64), np.zeros(0), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, fit_docs / sizes[l]))]), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for t in K.slices(batch.column(1)):
                found = [[] for _ in names]
                for grams, owner in _grams(t):
                    own = codes[t.first + owner]
                    for j in np.unique(own):
                        found[j].append(np.unique(grams[own == j], return_counts=True))
                for lang, parts in zip(names, found):
                    if not parts:
                        continue
                    g, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([x for _, x in parts]))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = mine.where(place < share).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counted.join(F.broadcast(total), "lang").where(F.col("n") >= RARE * F.col("total")).collect()
    planes = np.zeros(((len(languages) + 63) // 64, 1 << SLOT_BITS), np.uint64)
    coverage = np.zeros(len(languages))
    for j, lang in enumerate(languages):
        rows = [r for r in kept if r.lang == lang]
        coverage[j] = max(sum(r.n for r in rows) / rows[0].total if rows else 0.0, 1e-6)
        for s in _slots(np.array([r.gram for r in rows], np.int64)):
            np.bitwise_or.at(planes[j // 64], s, K._U(1 << (j % 64)))
    filled = np.array([np.mean((planes[j // 64] >> K._U(j % 64)) & K._U(1)) for j in range(len(languages))])
    return Filters(languages, planes, filled**PROBES, coverage)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``lang_pred`` and ``score`` of every whole text; one row per row of ``docs``.

    Only the text is used.  Null texts and texts without a letter are ``und`` with score 0,
    and so is every text if nothing could be learned; ties go to the first language by name.
    With ``keep`` the source's columns stay and the two are called ``names`` (columns that
    have these names are replaced); else the result has the id, ``held_out``, ``lang_pred`` and ``score``.
    """
    if keep:
        columns = [c for c in docs.columns if c not in names]
        source = docs.select(*[F.col(f"`{c}`") for c in columns])
    else:
        source, columns = docs.select(docs[id_col].alias("doc_id"), held_out(id_col).alias("held_out"), docs[text_col].alias(text_col)), ["doc_id", "held_out", text_col]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    out = T.StructType([*source.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for t in K.slices(batch.column(at)):
                part = batch.slice(t.first, len(t))
                lang, score = model.predict(t)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, *names])

    found = source.mapInArrow(run, out)
    return found if keep else found.drop(text_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.withColumn("doc_id", F.col("doc_id").cast("long")), learn(docs))

