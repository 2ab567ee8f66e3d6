"""Golden results of the dialect on the shared fixture."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerframe.engine import Engine, EngineConfig
from ledgerframe.sources.catalog import Catalog

from .fixtures import engine


@pytest.fixture(scope="module")
def sql(spark):
    e = engine(spark)
    return lambda text, **parameters: [tuple(r) for r in e.query(text, parameters).collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return engine(spark, customers=[])


def names(rows):
    return sorted(r[0] for r in rows)


SHOWCASE = (
    "SELECT c.name AS who, c.city AS place, MAX(o.total) AS top, SUM(o.total) AS turnover, COUNT(*) AS n, MIN(o.total) AS bottom, AVG(o.total) AS mean "
    "FROM orders o JOIN customers c ON o.customerId = c._key WHERE o.total > :least AND (c.city = :here OR c.score < :low) "
    "GROUP BY c.name, c.city ORDER BY turnover DESC, who LIMIT 5"
)


def test_showcase_rows_and_types(spark):
    df = engine(spark).query(SHOWCASE, {"here": "London", "low": 25, "least": 0})
    assert [tuple(r) for r in df.collect()] == [("Bob", "Paris", 200, 200, 1, 200, 200.0), ("Alice", "London", 120, 150, 2, 30, 75.0), ("Cara", "London", 5, 5, 1, 5, 5.0)]
    assert [t for _, t in df.dtypes] == ["string", "string", "int", "bigint", "bigint", "int", "double"]


@pytest.mark.parametrize(
    ("where", "who"),
    [
        ("city = 'London'", ["Alice", "Cara"]),
        ("'London' = city", ["Alice", "Cara"]),
        ("city != 'London'", ["Bob", "Dan"]),
        ("city <> 'London'", ["Bob", "Dan"]),
        ("score > 20", ["Cara", "Dan"]),
        ("score >= 20", ["Bob", "Cara", "Dan"]),
        ("score < 20", ["Alice"]),
        ("score <= 20.0", ["Alice", "Bob"]),
        ("score = 10.0", ["Alice"]),
        ("active = TRUE", ["Alice", "Cara"]),
        ("active > false", ["Alice", "Cara"]),
        ("nickname = NULL", ["Alice", "Bob", "Cara"]),
        ("nickname != NULL", ["Dan"]),
        ("nickname = 'D''Angelo'", ["Dan"]),
        ("nickname != 'x'", ["Alice", "Bob", "Cara", "Dan"]),
        ("nickname > 'A'", ["Dan"]),
        ("nickname = nickname", ["Alice", "Bob", "Cara", "Dan"]),
        ("nickname != nickname", []),
        ("NULL = NULL", ["Alice", "Bob", "Cara", "Dan"]),
        ("NULL != NULL", []),
        ("NULL < 1", []),
        ("score = '10'", []),
        ("score != '10'", ["Alice", "Bob", "Cara", "Dan"]),
        ("active = 1", []),
        ("nickname = score", []),
        ("nickname != score", ["Alice", "Bob", "Cara", "Dan"]),
        ("city = 'London' OR city = 'Paris' AND active = false", ["Alice", "Bob", "Cara"]),
        ("(city = 'London' OR city = 'Paris') AND active = false", ["Bob"]),
        ("_key = 'c2'", ["Bob"]),
        ("c._KEY = 'c2' OR C.Name = 'Dan'", ["Bob", "Dan"]),
        ("1 = 1", ["Alice", "Bob", "Cara", "Dan"]),
        ("-5 > score", []),
    ],
)
def test_filters(sql, where, who):
    assert names(sql(f"SELECT c.name FROM customers c WHERE {where}")) == who


def test_parameters_of_every_type(spark, sql):
    assert names(sql("SELECT name FROM customers WHERE score >= :n AND active = :f", n=20, f=True)) == ["Cara"]
    assert names(sql("SELECT name FROM customers WHERE nickname = :none", none=None, unused=3)) == ["Alice", "Bob", "Cara"]
    assert names(sql("SELECT name FROM customers WHERE score = :d", d=Decimal("10.00"))) == ["Alice"]
    days = spark.createDataFrame([(1, datetime(2024, 1, 2)), (2, None)], "id int, at timestamp_ntz").withColumn("instant", F.col("at").cast("timestamp"))
    e = Engine(Catalog().add("days", days, "id"))
    for column in ("at", "instant"):
        assert [r.id for r in e.query(f"SELECT id FROM days WHERE :t < {column}", {"t": datetime(2024, 1, 1)}).collect()] == [1]


def test_labels_and_wildcards(spark):
    e = engine(spark)
    assert e.query("SELECT C.NAME, c.city AS town, COUNT FROM customers c".replace(", COUNT", "")).columns == ["NAME", "town"]
    assert e.query("SELECT * FROM customers C JOIN orders O ON O.customerId = C._key").columns == [
        "c._key", "c.name", "c.city", "c.active", "c.score", "c.nickname", "o._key", "o.customerId", "o.total",
    ]
    assert e.query("SELECT name, *, score AS name FROM customers").columns[:2] == ["name", "customers._key"]
    assert e.query("SELECT name, score AS name FROM customers WHERE score = 10").collect()[0].asDict() == {"name": 10}
    assert e.query("SELECT name AS x, city AS X FROM customers ORDER BY X LIMIT 1").columns == ["x", "X"]


def test_aggregates(sql, empty):
    assert sql("SELECT COUNT(*), SUM(score), AVG(score), MIN(score), MAX(score) FROM customers") == [(4, 100, 25.0, 10, 40)]
    assert sql("SELECT city, SUM(score), AVG(score) FROM customers GROUP BY city ORDER BY sum DESC, avg, city") == [("London", 40, 20.0), ("Rome", 40, 40.0), ("Paris", 20, 20.0)]
    assert sql("SELECT SUM(o.total), AVG(o.total), MIN(o.total), MAX(o.total) FROM customers c JOIN orders o ON c._key = o.customerId WHERE c.city = 'London'") == [(155, 38.75, 0, 120)]
    assert [tuple(r) for r in empty.query("SELECT COUNT(*), SUM(score), AVG(score), MIN(score), MAX(name) FROM customers").collect()] == [(0, None, None, None, None)]
    assert empty.query("SELECT city, COUNT(*) FROM customers GROUP BY city").collect() == []
    assert sql("SELECT COUNT(nickname) AS n, COUNT(*) AS m FROM customers") == [(1, 4)]
    assert sql("SELECT c.city, active, COUNT(*) FROM customers c GROUP BY city, c.active ORDER BY city LIMIT 1") == [("London", True, 2)]
    assert sorted(sql("SELECT city FROM customers GROUP BY city")) == [("London",), ("Paris",), ("Rome",)]
    assert sorted(sql("SELECT nickname, COUNT(*) FROM customers GROUP BY nickname"), key=str) == [("D'Angelo", 1), (None, 3)]
    assert sql("SELECT MIN(active) AS low, MAX(nickname) AS high FROM customers") == [(False, "D'Angelo")]


def test_mixed_numbers_and_overflow(spark):
    values = spark.createDataFrame([("a", 10.0), ("b", 20.5), ("c", None)], "k string, amount double")
    e = Engine(Catalog().add("values", values, "k"))
    assert [tuple(r) for r in e.query("SELECT SUM(amount), AVG(amount) FROM values").collect()] == [(30.5, 15.25)]
    big = spark.createDataFrame([(1, 2**63 - 1), (2, 1)], "k int, n long")
    with pytest.raises(Exception, match="(?i)overflow"):
        Engine(Catalog().add("big", big, "k")).query("SELECT SUM(n) FROM big").collect()


def test_joins(spark, sql):
    assert sql("SELECT c.city, COUNT(*) FROM orders o JOIN customers c ON o.customerId = c._key WHERE o.total > 100 AND (c.city = 'London' OR c.city = 'Paris') GROUP BY c.city ORDER BY city") == [("London", 1), ("Paris", 1)]
    assert sql("SELECT o.total FROM customers c JOIN orders o ON c._key = o.customerId WHERE c.name = 'Alice' ORDER BY total DESC LIMIT 2") == [(120,), (30,)]
    assert sorted(sql("SELECT a.name, b.name AS other FROM customers a JOIN customers b ON b.city = a.city WHERE a._key < b._key")) == [("Alice", "Cara")]
    assert len(sql("SELECT a.name FROM customers a JOIN customers b ON a.nickname = b.nickname")) == 10
    assert len(sql("SELECT a.name FROM customers a JOIN customers b ON a.nickname = b.score")) == 0
    left = spark.createDataFrame([(1, "Ada"), (2, None)], "k int, name string")
    right = spark.createDataFrame([(2, 1, 50), (3, None, 7)], "k long, accountId long, total int")
    e = Engine(Catalog().add("accounts", left, "k").add("bills", right, "k").add("loose", left).add("texts", spark.createDataFrame([("1",), (None,)], "k string")))
    assert [tuple(r) for r in e.query("SELECT a.name, b.total FROM accounts a JOIN bills b ON a._key = b.accountId").collect()] == [("Ada", 50)]
    assert [tuple(r) for r in e.query("SELECT b.total, t.k FROM bills b JOIN texts t ON b.accountId = t.k").collect()] == [(7, None)]


def test_hot_join_key(spark):
    c = spark.createDataFrame([(i, "hot") for i in range(4)], "k int, city string")
    e = Engine(Catalog().add("a", c, "k").add("b", c, "k"))
    assert e.query("SELECT a.k FROM a JOIN b ON a.city = b.city").count() == 16


def test_order_and_limit(sql):
    assert [r[0] for r in sql("SELECT nickname, name FROM customers ORDER BY nickname, name DESC")] == ["D'Angelo", None, None, None]
    assert [r[1] for r in sql("SELECT nickname, name FROM customers ORDER BY nickname DESC, name")] == ["Alice", "Bob", "Cara", "Dan"]
    assert sql("SELECT * FROM customers c ORDER BY c.score DESC LIMIT 1")[0][0] == "c4"
    assert len(sql("SELECT name FROM customers ORDER BY score LIMIT 3")) == 3
    assert sql("SELECT name FROM customers LIMIT 0") == []
    assert len(sql("SELECT name FROM customers LIMIT 2147483647;")) == 4


@pytest.mark.parametrize(
    "text",
    [
        "SELECT", "SELECT name", "SELECT name FROM", "UPDATE customers", "SELECT name customers", "SELECT name FROM customers WHERE", "SELECT name FROM customers WHERE name",
        "SELECT name FROM customers WHERE name LIKE 'a'", "SELECT name FROM customers WHERE name == 'a'", "SELECT name FROM customers WHERE name = 'a", "SELECT name FROM customers LIMIT -1",
        "SELECT name FROM customers LIMIT x", "SELECT name FROM customers LIMIT :n", "SELECT name FROM customers LIMIT 9999999999", "SELECT SUM(*) FROM customers", "SELECT AVG(*) FROM customers",
        "SELECT count FROM customers", "SELECT COUNT(DISTINCT name) FROM customers", "SELECT DISTINCT name FROM customers", "SELECT name FROM customers HAVING name = 'a'", "SELECT name FROM customers ORDER BY COUNT(*)",
        "SELECT name FROM customers LEFT JOIN orders ON customers._key = orders.customerId", "SELECT name FROM customers c JOIN orders o ON c._key > o.customerId",
        "SELECT name FROM customers; SELECT name FROM customers", "SELECT name FROM customers WHERE score = 99999999999999999999", "SELECT name FROM customers WHERE (name = 'a'", "SELECT name n FROM customers",
        "SELECT 1 FROM customers UNION SELECT 1 FROM customers", "SELECT name FROM customers c WHERE score -1 = 3", "SELECT name FROM (customers)",
    ],
)
def test_rejected_text(spark, text):
    with pytest.raises(ValueError):
        engine(spark).query(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT missing FROM customers", "SELECT x.name FROM customers c", "SELECT name FROM nowhere", "SELECT _key FROM customers c JOIN orders o ON c._key = o.customerId", "SELECT name FROM customers WHERE score > 'a'",
        "SELECT name FROM customers WHERE active > 1", "SELECT SUM(name) FROM customers", "SELECT AVG(active) FROM customers", "SELECT name, COUNT(*) FROM customers", "SELECT *, COUNT(*) FROM customers",
        "SELECT name FROM customers GROUP BY city", "SELECT name FROM customers WHERE score = :missing", "SELECT c.name FROM customers c JOIN customers c ON c._key = c._key",
        "SELECT c.name FROM customers c JOIN orders o ON c._key = c.name", "SELECT c.name FROM customers c JOIN orders o ON o._key = o.customerId", "SELECT c.name FROM customers c JOIN orders o ON x.a = o.customerId",
        "SELECT name FROM customers GROUP BY alias", "SELECT name FROM customers LIMIT 0 WHERE x = 1",
    ],
)
def test_rejected_meaning(spark, text):
    with pytest.raises(ValueError):
        engine(spark).query(text)


def test_streaming_scan_and_lookup(spark):
    e = engine(spark)
    assert [r["name"] for r in e.stream("SELECT name FROM customers WHERE score > 15 LIMIT 2")] == ["Bob", "Cara"]
    for bad in ("SELECT name FROM customers ORDER BY name", "SELECT COUNT(*) FROM customers", "SELECT c.name FROM customers c JOIN orders o ON c._key = o.customerId"):
        with pytest.raises(ValueError):
            e.stream(bad)
    assert e.scan("orders", "O").columns == ["O._key", "O.customerId", "O.total"]
    assert e.lookup("orders", "o", "o3") == {"o._key": "o3", "o.customerId": "c2", "o.total": 200}
    assert e.lookup("orders", "o", "none") is None and e.lookup("orders", "o", 3) is None


def test_shards_are_one_table(spark):
    a = spark.createDataFrame([("c1", "Ada", 1)], "id string, name string, n int")
    b = spark.createDataFrame([("c2", 2**40, "Grace")], "id string, n long, name string")
    e = Engine(Catalog().add_shards("t", [a, b], "id"))
    assert e.rows("SELECT COUNT(*), SUM(n), MAX(name) FROM t") == [{"count": 2, "sum": 2**40 + 1, "max": "Grace"}]


def test_catalog_names_and_computed_columns(spark):
    raw = spark.createDataFrame([("c1", "Ada|London"), ("c2", "Bob")], "k string, value string")
    part = F.split("value", r"\|")
    catalog = Catalog().add("People", raw, "k", [("name", part[0]), ("CITY", F.try_element_at(part, F.lit(2))), ("city", F.try_element_at(part, F.lit(2)))])
    e = Engine(catalog)
    assert e.query("SELECT * FROM PEOPLE p").columns == ["p._key", "p.name", "p.city"]
    assert e.rows("SELECT name FROM people WHERE City = NULL") == [{"name": "Bob"}]
    catalog.add("people", raw, "k")
    assert e.query("SELECT * FROM people").columns == ["people._key", "people.k", "people.value"]
    with pytest.raises(ValueError):
        catalog.index("people", "value")
    with pytest.raises(ValueError):
        Catalog().table("people")


def test_config():
    assert EngineConfig().settings()["spark.sql.shuffle.partitions"] == "64"
    assert EngineConfig(spill_dir="/x").settings()["spark.local.dir"] == "/x"
    for bad in ({"shuffle_partitions": 0}, {"memory_rows": 0}, {"spill_dir": " "}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
