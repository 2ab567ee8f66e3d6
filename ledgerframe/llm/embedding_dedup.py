"""Embedding near-deduplication with cross-polytope hashing.

A vector is padded to a power of two and rotated by three rounds of random signs and a fast
Hadamard transform; its hash is the nearest signed axis.  ``HASHES`` such hashes name a
bucket of one of ``TABLES`` tables.  Each vector is stored in one bucket per table and looks
into the ``PROBES`` buckets that its runner-up axes make likeliest.  Candidate pairs are
verified by cosine in double precision.  At cosine 0.98 in 64 dimensions a table finds a
pair with probability 0.93, so six tables miss about one pair in 10**7.

Equal vectors are one class.  A bucket is compared tile by tile (``TILE`` vectors a side), so
a bucket with a third of all rows becomes many tasks; a tile returns link counts and a
spanning forest, never its pairs, and counts a pair only where it first meets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import components, own_nodes, table, tasks_for, written

TABLES, HASHES, PROBES = 6, 3, 8
RUNNERS = 4
TILE = 512
LINK = 0.98

_COMBOS = np.array(list(itertools.product(range(RUNNERS), repeat=HASHES)))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v / (m := np.abs(v).max(axis=1, keepdims=True)), axis=1, keepdims=True) / m


def probe_keys(unit_vectors: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Bucket keys (vectors x TABLES x PROBES); the first probe is the own bucket.

    ``salt`` (one number a vector) sets labels and dimensions apart.
    """
    n, dim = unit_vectors.shape
    d = 1 << max(1, int(dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = unit_vectors
    runners = min(RUNNERS, d)
    combos = _COMBOS[(_COMBOS < runners).all(axis=1)]
    probes = min(PROBES, len(combos))
    out = np.zeros((n, TABLES, PROBES), np.uint64)
    for t in range(TABLES):
        axes, gaps = [], []
        for j in range(HASHES):
            signs = np.random.default_rng([t, j, d]).choice([-1.0, 1.0], (3, d))
            y = x
            for s in signs:
                y = _hadamard(y * s) / np.sqrt(d)
            a = np.abs(y)
            order = np.argsort(-a, axis=1, kind="stable")[:, :runners]
            top = np.take_along_axis(a, order, 1)
            axes.append(2 * order + (np.take_along_axis(y, order, 1) < 0))
            gaps.append((top[:, :1] - top) ** 2)
        loss = sum(gaps[j][:, combos[:, j]] for j in range(HASHES))
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        # mixed first: else one table's axis could make up for another table's number
        key = np.broadcast_to(K.mix(K.mix(salt.astype(np.uint64)) ^ K._U(t + 1))[:, None], best.shape)
        for j in range(HASHES):
            key = K.mix(key + np.take_along_axis(axes[j], combos[best, j], 1).astype(np.uint64))
        out[:, t, :probes] = key
        out[:, t, probes:] = key[:, :1]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal dimension: their indices and vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, _matrix(column.take(pa.array(at)))


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a bipartite link matrix connects (nodes may stand on both sides)."""
    edges = []
    rows_open = hit.any(axis=1)
    cols_open = hit.any(axis=0)
    while rows_open.any():
        rows = np.array([np.flatnonzero(rows_open)[0]])
        members = [left[rows]]
        rows_open[rows] = False
        while len(rows):
            cols = np.flatnonzero(hit[rows].any(axis=0) & cols_open)
            cols_open[cols] = False
            members.append(right[cols])
            rows = np.flatnonzero(hit[:, cols].any(axis=1) & rows_open) if len(cols) else cols
            rows_open[rows] = False
            members.append(left[rows])
        nodes = np.unique(np.concatenate(members))
        edges += [(int(nodes[0]), int(x)) for x in nodes[1:]]
    return edges


def _holds(own: np.ndarray, probed: np.ndarray) -> np.ndarray:
    """Whether own[i] is among probed[j], for all i and j: keys are looked up once a distinct value."""
    values, which = np.unique(own, return_inverse=True)
    at = np.minimum(np.searchsorted(values, probed), len(values) - 1)
    found = np.zeros((len(values), len(probed)), bool)
    j, k = np.nonzero(values[at] == probed)
    found[at[j, k], j] = True
    return found[which]


def _compare(bucket: int, rows: list[tuple], link: float) -> tuple[list, list]:
    """Link counts and connecting edges of one tile: stored vectors against probing ones."""
    node, stored, copies = (np.concatenate([r[k] for r in rows]) for k in range(3))
    s, p = np.flatnonzero(stored), np.flatnonzero(~stored)
    if not len(s) or not len(p):
        return [], []
    vectors = unit(np.concatenate([r[4] for r in rows]))
    hit = (vectors[s] @ vectors[p].T >= link) & (node[s][:, None] != node[p][None, :])
    if not hit.any():
        return [], []
    keys = np.concatenate([r[3] for r in rows])
    # a pair counts where it first meets: by table, then the smaller node stored before the larger one stored
    t = np.flatnonzero(keys[s[0], :, 0] == np.uint64(bucket))[0]
    for k in range(t):
        hit &= ~_holds(keys[s, k, 0], keys[p, k])
        hit &= ~_holds(keys[p, k, 0], keys[s, k]).T
    hit &= ~(_holds(keys[p, t, 0], keys[s, t]).T & (node[s][:, None] > node[p][None, :]))
    links = hit.astype(np.float64)
    counts = [*zip(node[s], links @ copies[p].astype(np.float64)), *zip(node[p], links.T @ copies[s].astype(np.float64))]
    return [(int(n), int(c)) for n, c in counts if c], _forest(hit, node[s], node[p])


def _with_keys(classes: DataFrame) -> DataFrame:
    """``classes`` with all bucket keys of every vector (TABLES x PROBES numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                salts = piece["salt"].to_numpy().view(np.uint64)
                packed: list[bytes] = [b""] * piece.num_rows
                for at, vectors in _groups(piece["embedding"]):
                    for i, k in zip(at.tolist(), probe_keys(unit(vectors), salts[at])):
                        packed[i] = k.tobytes()
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(packed, pa.binary())], names=[*piece.schema.names, "keys"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("keys", T.BinaryType())]))


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, TABLES, PROBES)


def _entries(classes: DataFrame) -> DataFrame:
    """(bucket, node, probe) for all vectors; probe 0 is where a vector is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                keys = _unpacked(piece.column(1))
                probe = np.broadcast_to(np.arange(PROBES, dtype=np.int32), keys.shape)
                # short vectors have fewer combinations: no bucket twice
                fresh = np.ones(keys.shape, bool)
                fresh[:, :, 1:] = keys[:, :, 1:] != keys[:, :, :1]
                node = np.broadcast_to(piece.column(0).to_numpy()[:, None, None], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), pa.array(node[fresh]), pa.array(probe[fresh])], names=["bucket", "node", "probe"])

    return classes.select("node", "keys").mapInArrow(run, "bucket long, node long, probe int")


def _links(classes: DataFrame, link: float) -> DataFrame:
    """Rows (node, other, links): counts where ``other`` is null, else connecting edges."""
    entries = written(_entries(classes), "probes")
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("CAST(probe = 0 AS LONG)")).alias("s")).where("s > 0 AND n > 1")
    met = entries.join(buckets, "bucket").withColumns(
        {"rows": F.ceil(F.col("s") / TILE).cast("int"), "cols": F.ceil(F.col("n") / TILE).cast("int")}
    )
    place = F.xxhash64("node", "bucket")
    as_stored = met.where("probe = 0").select("bucket", "node", F.lit(True).alias("stored"), F.pmod(place, "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    as_probing = met.select("bucket", "node", F.lit(False).alias("stored"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(place, "cols").cast("int").alias("j"))
    rows = as_stored.unionByName(as_probing).join(classes.select("node", "copies", "keys", "embedding"), "node")
    rows = rows.select("bucket", "i", "j", "node", "stored", "copies", "keys", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            counts, edges = _compare(int(now[0]) & ((1 << 64) - 1), held, link)
            if counts or edges:
                nodes = [n for n, _ in counts] + [a for a, _ in edges]
                others = [None] * len(counts) + [b for _, b in edges]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array([c for _, c in counts] + [0] * len(edges), pa.int64())], names=["node", "other", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(k).to_numpy() for k in range(3)]
            cut = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)) + 1
            for s, e in zip([0, *cut], [*cut, batch.num_rows]):
                here = tuple(int(k[s]) for k in key)
                if here != now and held:
                    yield from done()
                    held = []
                now = here
                part = batch.slice(s, e - s)
                held.append((part["node"].to_numpy(), part["stored"].to_numpy(zero_copy_only=False), part["copies"].to_numpy(), _unpacked(part["keys"]), _matrix(part["embedding"])))
        if held:
            yield from done()

    tasks = tasks_for(classes.sparkSession, classes.count(), 2048)
    return rows.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "node long, other long, links long")


def near_vectors(vectors: DataFrame, link: float = LINK) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``vectors``.

    Vectors (columns vec_id, embedding, label) link if their labels are equal and not null,
    they have as many dimensions and their cosine is at least ``link``.  Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing and are their
    own component.  Null ids never name a component unless all its ids are null, and aren't
    kept; repeated rows count as vectors of their own; extra columns are ignored.  A ``link``
    below ``LINK`` is refused: the tables are so many as find pairs from there on.
    """
    if link < LINK:
        raise ValueError(f"link must be at least {LINK}")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    salt = F.xxhash64("label", F.size("embedding"))
    # equal vectors of a label are one class, told by 128 bits
    rows = rows.withColumn("key", F.when(F.coalesce(valid, F.lit(False)), F.xxhash64("label", "embedding"))).withColumns({"check": F.xxhash64(F.lit(7), "label", "embedding"), "salt": salt})
    classes = rows.where("key IS NOT NULL").groupBy("key", "check").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("salt").alias("salt"), F.first("embedding").alias("embedding"))
    classes = own_nodes(written(_with_keys(classes), "vectors"))
    found = written(_links(classes, link), "links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("other IS NOT NULL"), "node", "other").withColumnRenamed("component", "root")
    ids = classes.select("node", "key", "check", "low", "copies").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    named = ids.join(lows, "root").join(counts, "node", "left")
    named = named.select("key", "check", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "key", "check").join(named, ["key", "check"], "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT r, vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT r AS x, r AS y FROM v UNION SELECT reach.x, link.b FROM reach JOIN link ON reach.y = link.a
), low AS (
  SELECT reach.x, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.y = v.r GROUP BY reach.x
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON v.r = low.x LEFT JOIN n ON v.r = n.a
"""
