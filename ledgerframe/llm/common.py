"""What the operators share: reading tables, scratch storage, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, made longer until no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set here only if the session names none, as in local tests; on a cluster a folder
    of one machine would not be shared, so the setting is required there.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        set_to = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


#: Tables of this session in the shared folder: their file index (weakly) and path.
_tables: list[tuple[object, str]] = []


def _sweep(spark: SparkSession) -> None:
    """Delete the tables that no plan of this session refers to any more."""
    jvm, kept = spark.sparkContext._jvm, []
    for index, path in _tables:
        if index.get() is not None:
            kept.append((index, path))
            continue
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _tables[:] = kept


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Every plan made from the result holds its file index; once the JVM has collected that,
    a later call deletes the table.
    """
    spark = df.sparkSession
    _sweep(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _tables.append((spark.sparkContext._jvm.java.lang.ref.WeakReference(index), path))
    return out


def contents(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text: two xxHash64 of it."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def own_nodes(classes: DataFrame) -> DataFrame:
    """``classes``, which are told apart by key and check together, with a ``node`` of 64 bits that tells them apart alone.

    The node is the key.  Keys that two classes share by chance (there may be a few among
    10**10) are found by counting and get a hash of key and check.
    """
    double = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("more"))
    if double.isEmpty():
        return classes.withColumn("node", F.col("key"))
    node = F.when(F.col("more"), F.xxhash64("key", "check")).otherwise(F.col("key"))
    return written(classes.join(double, "key", "left").withColumn("node", node).drop("more"), "nodes")


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks of work that AQE can't size by bytes: one for ``each`` rows, at least ``shuffle.partitions``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (columns ``node``, ``component``).

    Each round every class of nodes takes the smallest label that any member hears from a
    neighbour, then the label of the node with that number (pointer jumping): distances to
    the smallest node about double with each round, and labels only fall, so it ends.  Only minima are shuffled
    (combined before the shuffle), joins are plain equi-joins that adaptive execution may
    split, and each round's labels are written: a checkpoint would keep its plan's
    constraints, which double with every round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = written(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    labels = written(labels.select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").groupBy("component").agg(F.min(F.least("component", "heard")).alias("next"))
        near = written(near, "classes")
        if near.where("next < component").isEmpty():
            return labels
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        taken = near.join(jump, "next", "left").select("component", F.coalesce("further", "next").alias("taken"))
        labels = written(labels.join(taken, "component").select("node", F.col("taken").alias("component")), "labels")
