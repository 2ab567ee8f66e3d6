"""Joins that multiply rows: the same results as Spark SQL, and no hot key that holds a task up."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerframe.engine import Engine
from ledgerframe.sources.catalog import Catalog

MANY = 200_000


@pytest.fixture(scope="module")
def many(spark):
    a = spark.createDataFrame([(i, i % 3 if i % 4 else None, f"g{i % 2}", i * 10, i / 2 if i % 5 else None, (2**62, -(2**62), i)[min(i % 7, 2)]) for i in range(60)], "id int, k int, g string, n int, f double, big long")
    b = spark.createDataFrame([(i, i % 4 if i % 3 else None, f"h{i % 3}", i, float(i)) for i in range(40)], "id long, k long, h string, n int, f float")
    c = spark.createDataFrame([(f"h{i % 3}", i) for i in range(9)], "h string, z int")
    for name, df in (("a", a), ("b", b), ("c", c)):
        df.createOrReplaceTempView(name)
    return Engine(Catalog().add("a", a, "id").add("b", b, "id").add("c", c))


def _rows(df):
    return sorted(tuple((v is None, round(v, 6) if isinstance(v, float) else v or 0) for v in r) for r in df.collect())


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        (
            "SELECT a.g, COUNT(*) AS n, SUM(a.n) AS s, AVG(b.f) AS m, MIN(b.n) AS lo, MAX(a.f) AS hi, COUNT(a.f) AS nf, SUM(b.f) AS sf, AVG(a.n) AS an FROM a JOIN b ON a.k = b.k GROUP BY a.g",
            "SELECT a.g, count(*) n, sum(bigint(a.n)) s, avg(double(b.f)) m, min(b.n) lo, max(a.f) hi, count(a.f) nf, sum(double(b.f)) sf, avg(a.n) an FROM a JOIN b ON a.k <=> b.k GROUP BY a.g",
        ),
        (
            "SELECT a.g, b.h, COUNT(*) AS n, SUM(a.n) AS s, AVG(c.z) AS z FROM a JOIN b ON a.k = b.k JOIN c ON c.h = b.h WHERE (a.n < b.f OR c.z > 5) AND b.n < 35 GROUP BY a.g, b.h",
            "SELECT a.g, b.h, count(*) n, sum(bigint(a.n)) s, avg(c.z) z FROM a JOIN b ON a.k <=> b.k JOIN c ON c.h <=> b.h WHERE (a.n < b.f OR c.z > 5) AND b.n < 35 GROUP BY a.g, b.h",
        ),
        ("SELECT COUNT(*) AS n, COUNT(b.h) AS h, SUM(a.n) AS s, AVG(a.f) AS m, MIN(a.g) AS lo FROM a JOIN b ON a.k = b.k WHERE b.n > 1000", "SELECT 0L n, 0L h, bigint(NULL) s, double(NULL) m, string(NULL) lo"),
        ("SELECT b.h, a.g FROM a JOIN b ON a.k = b.k GROUP BY a.g, b.h", "SELECT DISTINCT b.h, a.g FROM a JOIN b ON a.k <=> b.k"),
        (
            "SELECT x.g, COUNT(*) AS n, SUM(y.n) AS s FROM a x JOIN a y ON x.g = y.g JOIN b ON b._key = x._key JOIN b d ON d.k = b.k WHERE x.n < y.n GROUP BY x.g, x.g",
            "SELECT x.g, count(*) n, sum(bigint(y.n)) s FROM a x JOIN a y ON x.g <=> y.g JOIN b ON b.id = x.id JOIN b d ON d.k <=> b.k WHERE x.n < y.n GROUP BY x.g",
        ),
        # the key of a table is no longer unique when an earlier join has repeated it
        (
            "SELECT a.g, COUNT(*) AS n FROM b x JOIN a ON x.k = a._key JOIN b ON b.k = a._key GROUP BY a.g",
            "SELECT a.g, count(*) n FROM b x JOIN a ON x.k = a.id JOIN b ON b.k = a.id GROUP BY a.g",
        ),
    ],
)
def test_multiplying_joins_are_grouped_as_in_sql(spark, many, text, sql):
    got, want = many.query(text), spark.sql(sql)
    assert got.dtypes == want.dtypes and _rows(got) == _rows(want)


def test_sum_over_a_multiplying_join_overflows_only_as_a_result(many):
    assert [r.s for r in many.query("SELECT SUM(a.big) AS s FROM a JOIN b ON a.k = b.k WHERE a._key < 2 AND b.n = 0").collect()] == [2**62]
    assert [r.s for r in many.query("SELECT SUM(x.big) AS s FROM a x JOIN a y ON x.g = y.g WHERE x._key < 2 AND y.n < 40").collect()] == [0]
    with pytest.raises(Exception, match="(?i)overflow"):
        many.query("SELECT SUM(a.big) AS s FROM a JOIN b ON a.k = b.k WHERE a.big > 100").collect()


def test_hot_null_key_is_counted_without_its_pairs(spark):
    """4e10 pairs of NULL keys: before, the job went through them one by one."""
    rows = spark.range(MANY).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).alias("k"), (F.col("id") % 3).alias("g"))
    e = Engine(Catalog().add("a", rows, "id").add("b", rows, "id"))
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        found = e.query("SELECT COUNT(*) AS n, SUM(b.g) AS s FROM a JOIN b ON a.k = b.k").collect()
    finally:
        stop.cancel()
    nulls, loose = MANY * 99 // 100, MANY // 100
    of_nulls = sum(i % 3 for i in range(MANY) if i % 100)
    assert [tuple(r) for r in found] == [(nulls * nulls + loose, nulls * of_nulls + sum(i % 3 for i in range(0, MANY, 100)))]


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("SELECT a._key AS x, b._key AS y FROM a JOIN b ON a.k = b.k", "SELECT a.id x, b.id y FROM a JOIN b ON a.k <=> b.k"),
        ("SELECT a.n, b.h FROM a JOIN b ON b.f = a.f WHERE b.n < 30", "SELECT a.n, b.h FROM a JOIN b ON b.f <=> a.f WHERE b.n < 30"),
        ("SELECT c.z, b.n FROM c JOIN b ON c.h = b.h WHERE c.z < b.n AND c.z > 1", "SELECT c.z, b.n FROM c JOIN b ON c.h <=> b.h WHERE c.z < b.n AND c.z > 1"),
        ("SELECT x._key AS i, y._key AS j, c.z FROM a x JOIN a y ON x.g = y.g JOIN b ON b.k = x.k JOIN c ON c.h = b.h WHERE y.n < 90", "SELECT x.id i, y.id j, c.z FROM a x JOIN a y ON x.g <=> y.g JOIN b ON b.k <=> x.k JOIN c ON c.h <=> b.h WHERE y.n < 90"),
        ("SELECT x.n AS p, a.g, b.n AS q FROM b x JOIN a ON x.k = a._key JOIN b ON b.k = a._key", "SELECT x.n p, a.g, b.n q FROM b x JOIN a ON x.k = a.id JOIN b ON b.k = a.id"),
        ("SELECT a.n, b.h FROM a JOIN b ON a.f = b.h", "SELECT a.n, b.h FROM a JOIN b ON a.f IS NULL AND b.h IS NULL"),
        ("SELECT a.n, b.n AS m FROM a JOIN b ON a.g = b.k", "SELECT a.n, b.n m FROM a JOIN b ON a.g IS NULL AND b.k IS NULL"),
        ("SELECT a.g, b.h, COUNT(*) AS n, SUM(b.n) AS s FROM a JOIN b ON a.k = b.k WHERE a.n < b.f OR b.h = 'h1' GROUP BY a.g, b.h", "SELECT a.g, b.h, count(*) n, sum(bigint(b.n)) s FROM a JOIN b ON a.k <=> b.k WHERE a.n < b.f OR b.h = 'h1' GROUP BY a.g, b.h"),
    ],
)
def test_dealt_joins_have_the_rows_of_sql(spark, many, monkeypatch, text, sql):
    monkeypatch.setattr("ledgerframe.operators.joins.BLOCK_ROWS", 3, raising=False)
    got, want = many.query(text), spark.sql(sql)
    assert got.dtypes == want.dtypes and _rows(got) == _rows(want)


def test_pairs_of_a_hot_key_are_spread_over_tasks(spark, monkeypatch):
    """Without a broadcast one task made all 6 million rows before."""
    monkeypatch.setattr("ledgerframe.operators.joins.BLOCK_ROWS", 64, raising=False)
    rows = [spark.range(n).withColumn("k", (F.col("id") / 10_000).cast("int")) for n in (3000, 2000)]
    e = Engine(Catalog().add("a", rows[0], "id").add("b", rows[1], "id"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = e.query("SELECT a._key AS x, b._key AS y FROM a JOIN b ON a.k = b.k")
        made = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.col("x") + F.col("y")).alias("n")).collect()]
        assert sum(made) == 6_000_000 and max(made) < 0.4 * sum(made)
        assert df.agg(F.sum(F.col("x") * 2000 + F.col("y"))).collect()[0][0] == sum(range(6_000_000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
