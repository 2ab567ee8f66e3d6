"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A merge-type model turns a text into characters (spaces become U+2581, with one more in
front) and repeatedly merges the adjacent pair whose joined piece has the best score, the
leftmost on ties.  With dropout each candidate merge - a place and the two pieces that meet
there - is skipped for good if a keyed hash of document, place and pieces falls below the
rate.  The decision belongs to the candidate alone, so the order of tests and the cut of
the input into tasks don't matter, and a seed gives the same ids everywhere.

No piece spans two characters that are adjacent in no piece, so texts fall into short
stretches with agendas of their own.  All stretches of a slice take one step of their agenda
at a time with numpy; stretches longer than ``LONG`` use a heap instead.

Characters without a piece, and U+2581 itself, are written as byte pieces; hence decoding
gives back every text exactly, whatever was skipped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import fresh, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 41
#: Bytes of text encoded at a time: some 60 bytes of arrays are held for each.
SLICE_BYTES = 1 << 18
#: Characters of a stretch beyond which its agenda is a heap.
LONG = 48

_SPACE = "▁"
_NEVER = np.iinfo(np.int64).max


class _Map:
    """An open-addressing map from non-negative integers to integers, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, K._U(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * K._U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that aren't there."""
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


@dataclass
class Pieces:
    """A merge-type SentencePiece model as arrays, made once on the driver and broadcast.

    Ids from ``size`` on stand for characters that occur in pieces without being one; the
    last id stands for every other character.
    """

    size: int
    chars: _Map
    meets: _Map
    merges: _Map
    rank: np.ndarray
    byte_ids: np.ndarray
    surface: np.ndarray
    ends: np.ndarray
    space: int

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_ids, surfaces, normal = np.full(256, -1, np.int32), [], {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unused(i):
                surfaces.append(b"")
            elif model.is_unknown(i):
                surfaces.append(" ⁇ ".encode())
            else:
                normal[piece] = i
                surfaces.append(piece.replace(_SPACE, " ").encode())
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so decoding would lose characters")
        if any(a != _SPACE and b == _SPACE for p in normal for a, b in zip(p, p[1:])):
            raise ValueError("the model has pieces that reach into the next word")
        ids = dict(normal)
        for c in sorted({c for p in normal for c in p} | {_SPACE}):
            ids.setdefault(c, len(surfaces) + len(ids) - len(normal))
        top = size + len(ids) - len(normal) + 1
        order = {s: k for k, s in enumerate(sorted({-model.get_score(i) for i in normal.values()}))}
        rank = np.zeros(top, np.int64)
        for i in normal.values():
            rank[i] = order[-model.get_score(i)]
        single = {c: i for c, i in ids.items() if len(c) == 1}
        pairs = {ids[p[:k]] * top + ids[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        meets = sorted({single[a] * top + single[b] for p in normal for a, b in zip(p, p[1:])})
        as_map = lambda d: _Map(np.array(list(d), np.int64), np.array(list(d.values()), np.int32))
        points = {ord(c): i for c, i in single.items() if c != _SPACE} | {32: single[_SPACE]}
        return cls(
            size, as_map(points), _Map(np.array(meets, np.int64), np.ones(len(meets), np.int32)), as_map(pairs), rank, byte_ids,
            np.frombuffer(b"".join(surfaces), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in surfaces])]), single[_SPACE],
        )

    @property
    def top(self) -> int:
        return len(self.rank)

    def _symbols(self, t: K.Texts, fronts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Id, first byte and byte count of every character, and each text's first symbol.

        A text with ``fronts`` gets a space of no bytes in front.
        """
        data = t.data
        lead = (data & 0xC0) != 0x80
        lead[t.offsets[:-1][t.offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(lead)
        count = np.diff(np.append(at, len(data)))
        first = data[at]
        point = np.where((count == 1) & (first < 0x80), first.astype(np.int64), -1)
        for n, mark, bits in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
            some = np.flatnonzero((count == n) & ((first & (0xFF ^ bits)) == mark))
            value = (first[some] & bits).astype(np.int64)
            for k in range(1, n):
                value = (value << 6) | (data[at[some] + k] & 0x3F)
            point[some] = value
        ids = self.chars(np.maximum(point, 0))
        ids[(ids < 0) | (point < 0)] = self.top - 1
        begin = np.searchsorted(at, t.offsets)
        put = begin[:-1][fronts]
        ids, start, count = np.insert(ids, put, self.space), np.insert(at, put, at_text := t.offsets[:-1][fronts]), np.insert(count, put, np.zeros(len(at_text), count.dtype))
        return ids.astype(np.int32), start, count, begin + np.append(0, np.cumsum(fronts))

    def _skipped(self, base: np.ndarray, left: np.ndarray, into: np.ndarray, rate: float) -> np.ndarray:
        h = K.mix(base + ((into.astype(np.uint64) << K._U(32)) | left.astype(np.uint64)))
        return (h >> K._U(11)) < K._U(int(rate * (1 << 53)))

    def _candidates(self, left: np.ndarray, right: np.ndarray, base: np.ndarray | None, place: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Joined pieces and agenda keys (rank, then place) of adjacent pairs."""
        into = self.merges(left.astype(np.int64) * self.top + right)
        key = np.full(len(left), _NEVER, np.int64)
        some = np.flatnonzero(into >= 0)
        if base is not None:
            some = some[~self._skipped(base[place[some]], left[some], into[some], rate)]
        key[some] = (self.rank[into[some]] << 32) | place[some]
        return into, key

    def _merge_together(self, ids: np.ndarray, gone: np.ndarray, at: np.ndarray, lens: np.ndarray, base: np.ndarray | None, rate: float) -> None:
        """Agendas of all stretches (symbols ``at``, ``lens`` each), one merge of each a round."""
        s = ids[at]
        into, key = np.full(len(at), -1, np.int32), np.full(len(at), _NEVER, np.int64)
        inner = np.ones(len(at), bool)
        inner[np.cumsum(lens) - 1] = False
        inner = np.flatnonzero(inner)
        into[inner], key[inner] = self._candidates(s[inner], s[inner + 1], base, at[inner], rate)
        while len(lens):
            starts = np.cumsum(lens) - lens
            best = np.minimum.reduceat(key, starts)
            live = best != _NEVER
            if not live.all():
                stay = np.repeat(live, lens)
                at, s, into, key = at[stay], s[stay], into[stay], key[stay]
                lens, best = lens[live], best[live]
                if not len(lens):
                    return
            here = np.flatnonzero(key == np.repeat(best, lens))
            s[here] = ids[at[here]] = into[here]
            gone[at[here + 1]] = True
            stay = np.ones(len(at), bool)
            stay[here + 1] = False
            at, s, into, key = at[stay], s[stay], into[stay], key[stay]
            lens = lens - 1
            here -= np.arange(len(here))
            ends = np.cumsum(lens)
            key[here] = _NEVER
            both = np.concatenate([here[here + 1 < ends], here[here > ends - lens] - 1])
            into[both], key[both] = self._candidates(s[both], s[both + 1], base, at[both], rate)

    def _merge_long(self, ids: np.ndarray, gone: np.ndarray, first: int, n: int, base: np.ndarray | None, rate: float) -> None:
        """The same agenda for one long stretch."""
        s = ids[first : first + n].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place = np.arange(first, first + n)
        into, key = self._candidates(ids[first : first + n - 1], ids[first + 1 : first + n], base, place[:-1], rate)
        some = np.flatnonzero(key != _NEVER)
        heap = [(k, i, i + 1, s[i], s[i + 1], m) for k, i, m in zip(key[some].tolist(), some.tolist(), into[some].tolist())]
        heapq.heapify(heap)
        one = np.empty(1, np.int32), np.empty(1, np.int32)
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if s[i] != a or after[i] != j or s[j] != b:
                continue
            s[i], s[j] = m, -1
            gone[first + j] = True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    one[0][0], one[1][0] = s[x], s[y]
                    into, key = self._candidates(*one, base, place[x : x + 1], rate)
                    if key[0] != _NEVER:
                        heapq.heappush(heap, (int(key[0]), x, y, s[x], s[y], int(into[0])))
        ids[first : first + n] = s

    def encode(self, t: K.Texts, keys: np.ndarray, rate: float = 0.0, shifts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and offsets.

        ``keys`` is each text's part of the dropout hash.  ``shifts`` (where a text begins
        in the document it continues) is 0 for whole texts.
        """
        shifts = np.zeros(len(t), np.int64) if shifts is None else shifts
        fronts = (np.diff(t.offsets) > 0) & (shifts == 0)
        ids, start, count, begin = self._symbols(t, fronts)
        n = len(ids)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(t) + 1, np.int64)
        base = None
        if rate > 0:
            sizes = np.diff(begin)
            place = start - np.repeat(t.offsets[:-1] - shifts, sizes) + (count > 0)
            base = K.mix(np.repeat(K.mix(keys.astype(np.uint64)), sizes) + place.astype(np.uint64))
        cut = np.ones(n, bool)
        cut[1:] = self.meets(ids[:-1].astype(np.int64) * self.top + ids[1:]) < 0
        cut[begin[:-1][begin[:-1] < n]] = True
        firsts = np.flatnonzero(cut)
        lens = np.diff(np.append(firsts, n))
        gone = np.zeros(n, bool)
        short = (lens > 1) & (lens <= LONG)
        stretch = np.repeat(short, lens)
        self._merge_together(ids, gone, np.flatnonzero(stretch), lens[short], base, rate)
        for i in np.flatnonzero(lens > LONG):
            self._merge_long(ids, gone, int(firsts[i]), int(lens[i]), base, rate)
        kept = np.flatnonzero(~gone)
        ids, start, count = ids[kept], start[kept], count[kept]
        raw = ids >= self.size
        width = np.where(raw, count, 1)
        ends = np.append(0, np.cumsum(width))
        out = np.repeat(ids, width)
        at = np.flatnonzero(np.repeat(raw, width))
        out[at] = self.byte_ids[t.data[np.repeat(start - ends[:-1], width)[at] + at]]
        return out, ends[np.searchsorted(kept, begin)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id sequences; bytes that are no UTF-8 (never from :meth:`encode`) become U+FFFD."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("no such piece")
        first = self.ends[ids]
        width = self.ends[ids + 1] - first
        ends = np.append(0, np.cumsum(width))
        data = self.surface[np.repeat(first - ends[:-1], width) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def _segments(t: K.Texts) -> Iterator[tuple[np.ndarray, int, int]]:
    """Stretches (bytes, first byte) of one long text, cut before a space after another byte."""
    data, at = t.data, 0
    while at < len(data):
        to = len(data)
        if to - at > SLICE_BYTES:
            space = np.flatnonzero((data[at + SLICE_BYTES :] == 32) & (data[at + SLICE_BYTES - 1 : -1] != 32))
            to = at + SLICE_BYTES + int(space[0]) if len(space) else to
        yield data[at:to], at
        at = to


def encode_pieces(docs: DataFrame, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``; one row per row, columns of those names are replaced.

    The dropout of a document is keyed by ``seed`` and its id: rows that repeat id and text
    get equal ids, and documents with a null id share one key.  A null text has null
    ids and 0 tokens, an empty text no ids.  With ``dropout`` 0 the ids are those of the
    model's own encoder, except that U+2581 is written in bytes.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be at least 0 and below 1")
    columns = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    extra = fresh("_text", columns), fresh("_key", columns)
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias(extra[0]), key.alias(extra[1]))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    out = T.StructType([*source.schema.fields[: len(columns)], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column(len(columns))
            keys = batch.column(len(columns) + 1).to_numpy()
            for t in K.slices(text, SLICE_BYTES):
                own = keys[t.first : t.first + len(t)]
                if len(t) == 1 and len(t.data) > SLICE_BYTES:
                    parts = [model.encode(K.Texts(d, np.array([0, len(d)]), 0), own, dropout, np.array([at]))[0] for d, at in _segments(t)]
                    ids = np.concatenate(parts)
                    offsets = np.array([0, len(ids)])
                else:
                    ids, offsets = model.encode(t, own, dropout)
                missing = text.slice(t.first, len(t)).is_null()
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=missing if text.null_count else None)
                part = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], lists, pa.array(np.diff(offsets))], names=[*columns, "ids", "n_tokens"])

    return source.mapInArrow(run, out)


def decode_pieces(tokens: DataFrame, pieces: Pieces, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``tokens`` with the text of ``ids_col`` in column ``to`` (replaced if there is one).

    Null ids give a null text; control pieces give nothing; an id outside the model is an
    error.
    """
    columns = [c for c in tokens.columns if c != to]
    source = tokens.select(*[F.col(f"`{c}`") for c in columns], F.col(ids_col).cast("array<int>").alias(fresh("_ids", columns)))
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)
    out = T.StructType([*source.schema.fields[: len(columns)], T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                lists = part.column(len(columns))
                flat = lists.flatten()
                if flat.null_count:
                    raise ValueError("no such piece")
                offsets = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
                texts = shared.value.decode(flat.to_numpy(), offsets)
                none = lists.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(texts, pa.string(), mask=none)], names=[*columns, to])

    return source.mapInArrow(run, out)


def op5_sentencepieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """ids and n_tokens of every document, and whether decoding them gave back its text."""
    pieces = Pieces.load(model)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = decode_pieces(encode_pieces(docs, pieces), pieces)
    return both.select("doc_id", "n_tokens", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))

