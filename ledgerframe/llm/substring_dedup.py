"""Exact substring deduplication on a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words.  Of the ``GRAM``-word hashes inside a window the
smallest (leftmost on ties) is its fingerprint; equal windows have equal fingerprints at the
same offset, so every repeated window shows as a fingerprint with two occurrences.

1. *Runs.*  Each task turns its documents into sorted immutable runs of (fingerprint,
   content, position), cut into hash buckets.  Equal fingerprints of one task collapse to one
   entry marked as repeated, so a passage in a third of all documents sends one entry a task.
2. *Merge join.*  Documents arrive in batches.  Per bucket, the sorted runs of the index and of
   the batch are merged; occurrences that thereby become repeated are found, old ones
   included.  The same pass writes the merged run, which replaces the old ones (compaction)
   once there are more than ``MOST_RUNS``; a repeated fingerprint is one entry there.
3. *Verification.*  Only windows with a repeated fingerprint are hashed again by two
   independent functions (96 bits), and these hashes are merged in the same way.  Windows
   that occur twice cover the words to remove.

:func:`dedup_substrings` without an index is about one table: its documents go through an
index of their own, ``BATCHES`` batches after each other, and results are for all of them.
With an index it is about a new batch: past batches count as occurrences.  The index then also
keeps the hashes of verified windows, so that of past texts only those are read again whose
fingerprint was the only one of its kind until now.

Contents are keyed by 128 bits (two xxHash64 of the text); rows with equal texts are one
content, all of whose windows are repeated by definition.  Buckets and tasks are so many as
the bytes of text ask for, so a task's memory doesn't grow with the data.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import contents, shared_dir, table, written

WINDOW = 35
GRAM = 12
#: Batches that a table without an index of its own is merged in.
BATCHES = 3
#: Entries that a task holds before it cuts a run.
RUN_ENTRIES = 1 << 18
MOST_RUNS = 2
#: Bytes of text that are copied at a time while windows are verified.
PIECE_BYTES = 2 << 20
#: Bytes of text whose fingerprints share a bucket, and whose words are cut by one task.
BUCKET_BYTES = 8 << 20
#: Buckets that a merging task gets at most (more tasks than ``shuffle.partitions`` then).
TASK_BUCKETS = 16

_FIELDS = (("keys", np.uint64), ("checks", np.uint32), ("ca", np.int64), ("cb", np.int64), ("positions", np.uint32), ("twice", np.bool_))
_NAMES = [n for n, _ in _FIELDS]
RUN_SCHEMA = "bucket int, sure boolean, " + ", ".join(f"{n} binary" for n in _NAMES)
RUN_COLUMNS = ["bucket", "sure", *_NAMES]
Entries = list[np.ndarray]


def _power(n: float) -> int:
    """The least power of two that isn't below ``n``."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def _bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> K._U(32)) * K._U(n)) >> K._U(32)).astype(np.int64)


def fingerprints(hashes: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams, the position of each window's fingerprint, and which windows lie in one text."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams, _ = K.window_hashes(hashes, firsts, gram)
    width = window - gram + 1
    best, have = np.arange(len(grams)), 1

    def nearer(a: np.ndarray, shift: int) -> np.ndarray:
        left, right = a[:-shift], a[shift:]
        return np.where(grams[left] <= grams[right], left, right)

    while 2 * have <= width:
        best, have = nearer(best, have), 2 * have
    if have < width:
        best = nearer(best, width - have)
    last = np.repeat(firsts[1:], np.diff(firsts))[: n - window + 1]
    return grams, best[: n - window + 1], np.arange(n - window + 1) + window <= last


def _merged(parts: list[Entries]) -> tuple[Entries, np.ndarray, np.ndarray]:
    """Entries of sorted runs in one order, each occurrence once; their groups of equal keys; the part of each.

    numpy's stable sort is a merge sort that finds the runs in its input.  An occurrence that
    comes twice (a text that two tasks saw) is one entry; the mark of either holds.
    """
    columns = [np.concatenate(c) for c in zip(*parts)]
    part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(columns[0], kind="stable")
    columns, part = [c[order] for c in columns], part[order]
    keys = columns[0]
    # only rows of equal keys need a closer order
    same = keys[1:] == keys[:-1]
    some = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(some):
        _, checks, ca, cb, positions, _ = (c[some] for c in columns)
        closer = some[np.lexsort((part[some], positions, cb, ca, checks, keys[some]))]
        columns, part = [_put(c, some, c[closer]) for c in columns], _put(part, some, part[closer])
    keys, checks, ca, cb, positions, twice = columns
    key_same = (keys[1:] == keys[:-1]) & (checks[1:] == checks[:-1])
    again = np.append(False, key_same & (ca[1:] == ca[:-1]) & (cb[1:] == cb[:-1]) & (positions[1:] == positions[:-1])) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(np.append(True, ~key_same)) - 1 if len(keys) else np.zeros(0, np.int64)
    if again.any():
        lead = np.flatnonzero(~again)
        marks = np.add.reduceat(twice.astype(np.int64), lead) > 0
        columns = [*(c[lead] for c in columns[:5]), marks]
        group, part = group[lead], part[lead]
    return columns, group, part


def _put(column: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = column.copy()
    out[at] = values
    return out


def _collapsed(columns: Entries, group: np.ndarray) -> tuple[Entries, np.ndarray]:
    """One entry a group, marked if it stands for two occurrences, and the groups so marked."""
    if not len(group):
        return columns, np.zeros(0, bool)
    first = np.append(True, group[1:] != group[:-1])
    many = np.bincount(group) + np.bincount(group, columns[5]) > 1
    return [*(c[first] for c in columns[:5]), many], many


def _run_rows(columns: Entries, buckets: int, sure: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted run, one a bucket; answers (``sure``), which need no merge, are cut evenly."""
    n = len(columns[0])
    if not n:
        return
    if sure:
        # a hot key must not fill a bucket
        starts = np.arange(0, n, 4096)
        ends = np.minimum(starts + 4096, n)
        b = _bucket_of(K.mix(columns[2][starts].view(np.uint64) + K._U(n)), buckets)
    else:
        every = _bucket_of(columns[0], buckets)
        cuts = np.flatnonzero(np.diff(every)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, n)
        b = every[starts]
    none = pa.array([b""] * len(starts), pa.binary())
    packed = [none if sure and name in ("keys", "checks", "twice") else pa.array([c[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()) for name, c in zip(_NAMES, columns)]
    yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array([sure] * len(starts)), *packed], names=RUN_COLUMNS)


class _RunWriter:
    """Collects entries and cuts them into sorted runs."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.parts: list[Entries] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            order = np.argsort(columns[0], kind="stable")
            self.parts.append([c[order] for c in columns])
            self.size += len(order)
        if self.size >= RUN_ENTRIES:
            yield from self.cut()

    def cut(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        columns, group, _ = _merged(self.parts)
        self.parts, self.size = [], 0
        entries, many = _collapsed(columns, group)
        yield from _run_rows(entries, self.buckets)
        # occurrences repeated within this task need no answer; one entry stands for them all
        sure = many[group] & ~columns[5]
        yield from _run_rows([c[sure] for c in columns], self.buckets, True)


def runs(contents: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """Runs of all fingerprints of ``contents`` (columns ``ca``, ``cb``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _RunWriter(buckets)
        for batch in batches:
            ca, cb = (batch.column(k).to_numpy() for k in (0, 1))
            for t in K.slices(batch.column(2)):
                starts, ends, firsts = K.words(t)
                grams, best, inside = fingerprints(K.word_hashes(t.data, starts, ends), firsts, window, gram)
                at = np.unique(best[inside])
                owner = K.owners(firsts)[at]
                yield from out.add(grams[at], np.zeros(len(at), np.uint32), ca[t.first + owner], cb[t.first + owner], (at - firsts[owner]).astype(np.uint32), np.zeros(len(at), bool))
        yield from out.cut()

    return contents.select("ca", "cb", "text").mapInArrow(run, RUN_SCHEMA)


def _unpacked(row: dict) -> Entries:
    return [np.frombuffer(row[name], kind) for name, kind in _FIELDS]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    now, held = None, []
    for batch in batches:
        # packed runs become Python objects one row at a time
        for i in range(batch.num_rows):
            row = {name: batch[name][i].as_py() for name in batch.schema.names}
            if row["bucket"] != now:
                if held:
                    yield now, held
                now, held = row["bucket"], []
            held.append(row)
    if held:
        yield now, held


def _cut_finer(rows: DataFrame, buckets: int) -> DataFrame:
    """Runs of coarser buckets cut anew (bucket numbers are leading bits of the key, so order stays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _run_rows(_unpacked(row), buckets)

    return rows.select(*RUN_COLUMNS).mapInArrow(run, RUN_SCHEMA)


def _pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut at about ``PIECE_BYTES`` of text, so that what is made from one at a time stays small."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy()) // PIECE_BYTES
        cuts = np.flatnonzero(np.diff(size)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)
        # what the pieces left is of no use to the next batch or task
        pa.default_memory_pool().release_unused()


MERGED_SCHEMA = "kind int, a binary, b binary, p binary, " + RUN_SCHEMA
_ANSWER, _ENTRY = 0, 1


def merge_join(old: DataFrame | None, new: DataFrame, buckets: int, compact: bool) -> DataFrame:
    """Answers (packed contents and positions) of ``new`` against ``old`` runs and, if asked for, the merged run.

    Answers are the new occurrences whose key is repeated, and the old ones that were the
    only ones of their key until now.
    """
    rows = new.withColumn("old", F.lit(False))
    if old is not None:
        rows = rows.unionByName(old.withColumn("old", F.lit(True)))

    def answer(ca: np.ndarray, cb: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ca, cb, p)]
        none = [pa.nulls(1, pa.int32()), pa.nulls(1, pa.bool_()), *(pa.nulls(1, pa.binary()) for _ in _NAMES)]
        return pa.RecordBatch.from_arrays([pa.array([_ANSWER], pa.int32()), *blobs, *none], names=["kind", "a", "b", "p", *RUN_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            for r in (r for r in held if r["sure"]):
                yield answer(*(np.frombuffer(r[n], k) for n, k in (("ca", np.int64), ("cb", np.int64), ("positions", np.uint32))))
            held = [r for r in held if not r["sure"]]
            if not held:
                continue
            fresh = np.array([not r["old"] for r in held])
            columns, group, part = _merged([_unpacked(r) for r in held])
            is_new = fresh[part]
            total = np.bincount(group) + np.bincount(group, columns[5])
            before = np.bincount(group, ~is_new) + np.bincount(group, columns[5] & ~is_new)
            came = np.bincount(group, is_new) > 0
            hit = (total > 1)[group] & (is_new | ((before == 1) & came)[group])
            if hit.any():
                yield answer(columns[2][hit], columns[3][hit], columns[4][hit])
            if compact:
                for b in _run_rows(_collapsed(columns, group)[0], buckets):
                    blank = [pa.nulls(b.num_rows, pa.binary())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array([_ENTRY] * b.num_rows, pa.int32()), *blank, *b.columns], names=["kind", "a", "b", "p", *RUN_COLUMNS])

    tasks = max(int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // TASK_BUCKETS)
    return rows.select(*RUN_COLUMNS, "old").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MERGED_SCHEMA)


def _occurrences(answers: DataFrame) -> DataFrame:
    """(ca, cb, position) of packed answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64)), pa.array(np.frombuffer(p, np.uint32).astype(np.int32))], names=["ca", "cb", "position"])

    return answers.select("a", "b", "p").mapInArrow(run, "ca long, cb long, position int")


_FINAL, _TEXT, _RUN = 0, 1, 2
_RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def verify(joined: DataFrame, window: int, gram: int, buckets: int, with_text: bool) -> DataFrame:
    """Final rows of documents without candidates, texts of the others, and runs of candidate windows.

    ``joined`` has doc_id, ca, cb, text, rest, copies, first_id, old and positions (of
    repeated fingerprints, or null).
    """
    rest = joined.schema["rest"].dataType
    kinds = [("kind", pa.int32()), *_RESULT, ("ca", pa.int64()), ("cb", pa.int64()), ("rest", None), ("bucket", pa.int32()), ("sure", pa.bool_()), *((f"run_{n}", pa.binary()) for n in _NAMES)]
    schema = "kind int, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, ca long, cb long, rest {}, bucket int, sure boolean, " + ", ".join(f"run_{n} binary" for n in _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _RunWriter(buckets)
        rest_kind = None

        def step(n: int, **columns) -> pa.RecordBatch:
            made = [columns[name] if name in columns else pa.nulls(n, kind or rest_kind) for name, kind in kinds]
            return pa.RecordBatch.from_arrays([c.cast(k) if k is not None and c.type != k else c for c, (_, k) in zip(made, kinds)], names=[name for name, _ in kinds])

        def as_step(rows: pa.RecordBatch) -> pa.RecordBatch:
            return step(rows.num_rows, kind=pa.array([_RUN] * rows.num_rows), bucket=rows["bucket"], sure=rows["sure"], **{f"run_{n}": rows[n] for n in _NAMES})

        for batch in _pieces(batches, "text"):
            rest_kind = batch["rest"].type
            if not batch.num_rows:
                continue
            rows = {n: batch[n].to_pylist() for n in ("doc_id", "copies", "first_id", "old")}
            some = batch["positions"].is_valid().to_pylist()
            done, final, texts, chosen = [], [], [], []
            for i in range(batch.num_rows):
                copied = rows["copies"][i] > 1
                if not rows["old"][i]:
                    if copied or not some[i]:
                        said = (batch["text"][i].as_py() or "").encode().split()
                        kept = [] if copied and len(said) >= window else said
                        done.append(i)
                        final.append((rows["doc_id"][i], len(said), len(said) - len(kept), _sha(kept), b" ".join(kept).decode() if with_text else None))
                    else:
                        texts.append(i)
                if some[i] and (not copied or rows["old"][i] or rows["doc_id"][i] == rows["first_id"][i]):
                    chosen.append(i)
            if final:
                columns = {name: pa.array(c, kind) for c, (name, kind) in zip(zip(*final), _RESULT)}
                yield step(len(done), kind=pa.array([_FINAL] * len(done)), rest=batch["rest"].take(pa.array(done)), **columns)
            if texts:
                part = batch.take(pa.array(texts))
                yield step(len(texts), kind=pa.array([_TEXT] * len(texts)), **{n: part[n] for n in ("doc_id", "ca", "cb", "text", "rest")})
            if chosen:
                part = batch.take(pa.array(chosen))
                ca, cb = part["ca"].to_numpy(), part["cb"].to_numpy()
                again = part["copies"].to_numpy() > 1
                lists = part["positions"]
                flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                for t in K.slices(part["text"]):
                    starts, ends, firsts = K.words(t)
                    a = K.word_hashes(t.data, starts, ends)
                    _, best, inside = fingerprints(a, firsts, window, gram)
                    if not len(best):
                        continue
                    marked = np.zeros(len(a), bool)
                    own = np.repeat(np.arange(len(t)), np.diff(offs[t.first : t.first + len(t) + 1]))
                    marked[firsts[own] + flat[offs[t.first] : offs[t.first + len(t)]]] = True
                    at = np.flatnonzero(inside & marked[best])
                    b = K.word_hashes(t.data, starts, ends, second=True)
                    one, _ = K.window_hashes(a, firsts, window)
                    two, _ = K.window_hashes(b, firsts, window, second=True)
                    owner = K.owners(firsts)[at]
                    for rows_ in out.add(one[at], (two[at] >> K._U(32)).astype(np.uint32), ca[t.first + owner], cb[t.first + owner], (at - firsts[owner]).astype(np.uint32), again[t.first + owner]):
                        yield as_step(rows_)
        for rows_ in out.cut():
            yield as_step(rows_)

    shape = T.StructType([f if f.name != "rest" else T.StructField("rest", rest) for f in T.StructType.fromDDL(schema.format("string")).fields])
    return joined.mapInArrow(run, shape)


def _part_of(ca: Column, parts: int) -> Column:
    return F.pmod(ca, F.lit(parts)).cast("int")


def _gathered(answers: DataFrame, parts: int) -> DataFrame:
    """Answers of a task together, cut by content: at most one row per task, part and RUN_ENTRIES."""

    def packed(held: list[Entries]) -> pa.RecordBatch:
        a, b, p = (np.concatenate(x) for x in zip(*held))
        part = np.mod(a, parts)
        order = np.argsort(part, kind="stable")
        a, b, p, part = a[order], b[order], p[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(a))
        pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pack(a), pack(b), pack(p)], names=["part", "a", "b", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.append([np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(p, np.uint32)])
                size += len(held[-1][0])
                if size >= RUN_ENTRIES:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return answers.select("a", "b", "p").mapInArrow(run, "part int, a binary, b binary, p binary")


def _cut_words(texts: DataFrame, answers: DataFrame, window: int, parts: int, with_text: bool) -> DataFrame:
    """Remove the covered words from texts that had candidates."""
    columns = ["part", "is_text", "doc_id", "ca", "cb", "text", "rest", "a", "b", "p"]
    blank = {n: F.lit(None).cast("binary") for n in "abp"}
    mine = texts.select(_part_of(F.col("ca"), parts).alias("part"), F.lit(True).alias("is_text"), "doc_id", "ca", "cb", "text", "rest").withColumns(blank)
    both = mine.unionByName(answers.withColumn("is_text", F.lit(False)), allowMissingColumns=True).select(*columns)
    out = T.StructType([*T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, text string").fields, texts.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], None
        for batch in batches:
            rows, made = [], []
            # texts and packed answers become Python objects one row at a time
            large = [batch[n] for n in ("text", "a", "b", "p")]
            for i, (part, is_text, doc_id, ca, cb) in enumerate(zip(*(batch[n].to_pylist() for n in columns[:5]))):
                text, a, b, p = (c[i].as_py() for c in large)
                if part != now:
                    now, held, found = part, [], None
                if not is_text:
                    held.append([np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(p, np.uint32)])
                    continue
                if found is None:
                    found = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)]
                    order = np.argsort(found[0], kind="stable")
                    found, held = [x[order] for x in found], []
                said = (text or "").encode().split()
                low, high = np.searchsorted(found[0], ca, "left"), np.searchsorted(found[0], ca, "right")
                at = np.unique(found[2][low:high][found[1][low:high] == cb]).astype(np.int64)
                kept = said
                if len(at):
                    change = np.zeros(len(said) + 1, np.int64)
                    change[at] += 1
                    change[at + window] -= 1
                    kept = [said[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                rows.append(i)
                made.append((doc_id, len(said), len(said) - len(kept), _sha(kept), b" ".join(kept).decode() if with_text else None))
            if made:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, (_, k) in zip(zip(*made), _RESULT)), batch["rest"].take(pa.array(rows))], names=[*(n for n, _ in _RESULT), "rest"])

    return both.repartition(parts, "part").sortWithinPartitions("part", "is_text").mapInArrow(run, out)


class FingerprintIndex:
    """Runs and texts of past batches under ``path`` (any store that Spark reads).

    ``runs/<name>`` (fingerprints), ``windows/<name>`` (hashes of verified windows) and
    ``texts/<name>`` (contents, in ``text_parts`` folders) are written once and never changed;
    the newest folder of ``manifest`` lists the valid ones and their numbers of buckets.  What
    a batch adds is staged and published in one step at its end, so a failed batch leaves the
    index as it was.  There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, text_parts: int = 256):
        self.spark, self.path, self.text_parts = spark, path.rstrip("/"), text_parts
        self.staged: list[tuple[str, str, int]] | None = None

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        top = path(f"{self.path}/manifest")
        if not fs.exists(top):
            return []
        names = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName()) for p in names if fs.exists(path(f"{p}/_SUCCESS")))

    def entries(self) -> list[tuple[str, str, int]]:
        """(kind, name, buckets) of every valid folder, staged ones included; kinds are run, window and text."""
        if self.staged is not None:
            return self.staged
        versions = self._versions()
        if not versions:
            return []
        return [(r.kind, r.name, r.buckets) for r in self.spark.read.parquet(f"{self.path}/manifest/{versions[-1]}").collect()]

    def publish(self) -> None:
        """Make what is staged valid, all at once."""
        if self.staged is not None:
            version = max(self._versions(), default=0) + 1
            self.spark.createDataFrame(self.staged, "kind string, name string, buckets int").coalesce(1).write.parquet(f"{self.path}/manifest/{version}")
            self.staged = None

    def _rows(self, kind: str, buckets: int) -> DataFrame | None:
        """All runs of a kind, cut into so many buckets."""
        out = None
        for k, name, n in self.entries():
            if k == kind:
                rows = self.spark.read.parquet(f"{self.path}/{kind}s/{name}").select(*RUN_COLUMNS)
                rows = rows if n == buckets else _cut_finer(rows, buckets)
                out = rows if out is None else out.unionByName(rows)
        return out

    def buckets(self, least: int = 1) -> int:
        return max([least, *(n for _, _, n in self.entries())])

    def merge(self, kind: str, new: DataFrame, buckets: int, keep: bool = True) -> DataFrame:
        """Merge-join ``new`` runs with those of the index, stage them for it and return the answers.

        The merged run takes the place of all others once they are more than ``MOST_RUNS``.
        """
        entries = self.entries()
        mine = [e for e in entries if e[0] == kind]
        compact = keep and len(mine) + 1 > MOST_RUNS
        out = written(merge_join(self._rows(kind, buckets), new, buckets, compact), "merged")
        if keep:
            name = uuid.uuid4().hex
            rows = out.where(F.col("kind") == _ENTRY) if compact else new.where("NOT sure")
            rows.select(*RUN_COLUMNS).write.parquet(f"{self.path}/{kind}s/{name}")
            self.staged = [*(e for e in entries if not (compact and e[0] == kind)), (kind, name, buckets)]
        return out.where(F.col("kind") == _ANSWER)

    def compact(self) -> None:
        """Merge all runs of a kind into one now."""
        for kind in ("run", "window"):
            entries = self.entries()
            if sum(e[0] == kind for e in entries) > 1:
                buckets, name = self.buckets(), uuid.uuid4().hex
                rows = merge_join(None, self._rows(kind, buckets), buckets, True).where(F.col("kind") == _ENTRY)
                rows.select(*RUN_COLUMNS).write.parquet(f"{self.path}/{kind}s/{name}")
                self.staged = [*(e for e in entries if e[0] != kind), (kind, name, buckets)]
        self.publish()

    def texts(self, wanted: DataFrame | None = None) -> DataFrame | None:
        """Past texts; of ``wanted`` contents (ca, cb) only, reading no folder without any of them."""
        names = [f"{self.path}/texts/{n}" for k, n, _ in self.entries() if k == "text"]
        if not names:
            return None
        held = self.spark.read.parquet(names[0])
        for n in names[1:]:
            held = held.unionByName(self.spark.read.parquet(n))
        if wanted is not None:
            # at most text_parts numbers
            parts = [r.part for r in wanted.select(_part_of(F.col("ca"), self.text_parts).alias("part")).distinct().collect()]
            held = held.where(F.col("part").isin(parts)).join(wanted, ["ca", "cb"], "left_semi")
        return held.select("ca", "cb", "text")

    def add_texts(self, contents: DataFrame) -> None:
        name = uuid.uuid4().hex
        placed = contents.withColumn("part", _part_of(F.col("ca"), self.text_parts))
        placed.repartition("part").write.partitionBy("part").parquet(f"{self.path}/texts/{name}")
        self.staged = [*self.entries(), ("text", name, 1)]

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _window_runs(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("kind") == _RUN).select("bucket", "sure", *[F.col(f"run_{n}").alias(n) for n in _NAMES])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, index: FingerprintIndex | None = None, with_text: bool = True, carry: tuple[str, ...] = (), batches: int = BATCHES) -> DataFrame:
    """Remove every word that a repeated window covers; one row per row of ``docs``.

    Columns: doc_id, n_words, n_removed, kept_sha256, ``text`` (kept words joined by one
    space; null unless ``with_text``) and ``rest``, a struct of the columns in ``carry``, whose
    values pass unchanged (absent without ``carry``).  Words are split at ASCII white space;
    null texts have none.  Every occurrence goes, the first included.  With ``index``, windows
    of earlier batches count as occurrences too, and the batch is added to the index; results
    are for the new batch alone.  Null and repeated ids are kept; extra columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rest = F.struct(*[docs[f"`{c}`"] for c in carry]) if carry else F.struct(F.lit(None).cast("boolean").alias("none"))
    ca, cb = contents(text)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), ca.alias("ca"), cb.alias("cb"), rest.alias("rest"))
    content = rows.groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.first(F.octet_length("text")).alias("bytes"))
    content = written(content, "contents")
    size = content.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    if index:
        index.staged = None
    held = index or FingerprintIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    buckets = held.buckets(max(_power(size / BUCKET_BYTES), 4))
    mine = written(runs(rows, window, gram, buckets).withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(1 if index else batches))), "runs")
    answers = None
    for k in range(1 if index else batches):
        found = held.merge("run", mine.where(F.col("batch") == k).select(*RUN_COLUMNS), buckets, keep=bool(index) or k + 1 < batches)
        answers = found if answers is None else answers.unionByName(found)
        _release(spark)
    places = _occurrences(answers)
    everything, counts = rows.withColumn("old", F.lit(False)), content.drop("bytes")
    if index:
        places = written(places, "places")
        mentioned = places.select("ca", "cb").distinct().join(content, ["ca", "cb"], "left_anti")
        past, known = index.texts(mentioned), index.texts()
        if past is not None:
            everything = everything.unionByName(past.select(F.lit(None).cast("long").alias("doc_id"), "text", "ca", "cb", F.lit(None).cast(rows.schema["rest"].dataType).alias("rest"), F.lit(True).alias("old")))
            # a text that an earlier batch holds is a copy
            before = known.select("ca", "cb").distinct().withColumn("held", F.lit(1))
            counts = counts.join(before, ["ca", "cb"], "left").select("ca", "cb", (F.col("copies") + F.coalesce("held", F.lit(0))).alias("copies"), "first_id")
            counts = counts.unionByName(mentioned.select("ca", "cb", F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("first_id")))
    small = counts.join(places.groupBy("ca", "cb").agg(F.collect_list("position").alias("positions")), ["ca", "cb"], "left")
    joined = everything.join(small.hint("merge"), ["ca", "cb"]).select("doc_id", "ca", "cb", "text", "rest", "copies", "first_id", "old", F.col("positions").cast("array<int>"))
    steps = written(verify(joined, window, gram, buckets, with_text), "windows")
    if index:
        found = index.merge("window", _window_runs(steps), buckets)
    else:
        held.drop()
        found = merge_join(None, _window_runs(steps), buckets, False)
    cut = _cut_words(steps.where(F.col("kind") == _TEXT), _gathered(found, parts), window, parts, with_text)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "text", *(["rest"] if carry else [])]
    out = steps.where(F.col("kind") == _FINAL).select(*columns).unionByName(cut.select(*columns))
    if index:
        out = written(out, "deduped")
        texts = rows.select("ca", "cb", "text").dropDuplicates(["ca", "cb"])
        index.add_texts(texts if known is None else texts.join(known.select("ca", "cb"), ["ca", "cb"], "left_anti"))
        index.publish()
    return out


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("text")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, unnest(generate_series(1, len(w) - 34)) AS p, w FROM d WHERE len(w) >= 35
), h AS (
  SELECT r, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS h FROM p
), twice AS (
  SELECT h FROM h GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(generate_series(p, p + 34)) AS i FROM h SEMI JOIN twice USING (h)
), word AS (
  SELECT r, unnest(w) AS w, unnest(generate_series(1, len(w))) AS i FROM d
), kept AS (
  SELECT word.r, string_agg(word.w, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
