"""The driver's queries over the test tables, each with SQL that says the same in DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources.catalog import KEY, Catalog
from .sources.changelog import latest_per_key
from .sources.jsonrows import write_json
from .store import RecordStore
from .streaming.feed import follow, upsert_stream
from .topology import Node, Topology, partition_column

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": None, "events": "event_id", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
}


def computed(name: str) -> list[tuple[str, object]]:
    """Computed columns of the test tables: the data has no NULLs, and money in cents sums exactly."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return {
        "customer": [("nick", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))), ("debt", F.when(F.col("c_acctbal") < 0, F.col("c_nationkey")))],
        "supplier": [("debt", F.when(F.col("s_acctbal") < 0, F.col("s_nationkey")))],
        "orders": [("cents", cents("o_totalprice")), ("year", F.year("o_orderdate"))],
        "lineitem": [("cents", cents("l_extendedprice"))],
        "part": [("size_name", F.col("p_size").cast("string"))],
    }.get(name, [])


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    out = Catalog()
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        out.add(name, df, KEYS[name], [*df.columns, *computed(name)])
    return out


def scratch(spark: SparkSession, name: str) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Case:
    """A statement of the dialect, the tables it needs, and its oracle."""

    sql: str
    tables: tuple[str, ...]
    oracle: str
    parameters: Mapping[str, object] = field(default_factory=dict)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(catalog(spark, sf_dir, *self.tables)).query(self.sql, self.parameters)


_CUSTOMER = "(SELECT *, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS nick, CASE WHEN c_acctbal < 0 THEN c_nationkey END AS debt FROM customer)"
_SUPPLIER = "(SELECT *, CASE WHEN s_acctbal < 0 THEN s_nationkey END AS debt FROM supplier)"
_ORDERS = "(SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, year(o_orderdate) AS year FROM orders)"
_LINES = "(SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"

CASES: dict[str, Case] = {
    "showcase": Case(
        "SELECT o.o_orderpriority AS priority, c.c_mktsegment AS segment, SUM(o.cents) AS turnover, COUNT(*) AS n, MAX(o.cents) AS top, MIN(o.cents) AS bottom, AVG(o.cents) AS mean "
        "FROM orders o JOIN customer c ON o.o_custkey = c._key WHERE o.o_orderstatus != :open AND (c.c_acctbal > :rich OR o.o_totalprice > :big) "
        "GROUP BY o.o_orderpriority, c.c_mktsegment ORDER BY priority, turnover DESC, segment LIMIT 20",
        ("customer", "orders"),
        f"SELECT o_orderpriority AS priority, c_mktsegment AS segment, CAST(sum(cents) AS BIGINT) AS turnover, count(*) AS n, max(cents) AS top, min(cents) AS bottom, avg(cents) AS mean "
        f"FROM customer JOIN {_ORDERS} o ON c_custkey = o_custkey WHERE o_orderstatus <> 'O' AND (c_acctbal > 5000 OR o_totalprice > 200000) "
        "GROUP BY ALL ORDER BY priority, turnover DESC, segment LIMIT 20",
        {"open": "O", "rich": 5000, "big": 200000},
    ),
    "select_columns": Case("SELECT c_name, c.c_acctbal FROM customer c", ("customer",), "SELECT c_name, c_acctbal FROM customer"),
    "select_alias": Case("SELECT c.C_NAME AS who, C_MktSegment FROM customer AS c", ("customer",), 'SELECT c_name AS who, c_mktsegment AS "C_MktSegment" FROM customer'),
    "select_wildcard": Case("SELECT *, n_name AS again FROM nation", ("nation",), 'SELECT n_nationkey AS "nation._key", n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey", n_name AS again FROM nation'),
    "wildcard_join": Case(
        "SELECT * FROM nation N JOIN region r ON N.n_regionkey = r._key", ("nation", "region"),
        'SELECT n_nationkey AS "n._key", n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey", r_regionkey AS "r._key", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey',
    ),
    "label_collapse": Case("SELECT n.n_name AS x, n.n_nationkey, r.r_name AS x FROM nation n JOIN region r ON r._key = n.n_regionkey", ("nation", "region"), "SELECT r_name AS x, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "array_passthrough": Case("SELECT vec_id, embedding FROM embeddings WHERE label = 1", ("embeddings",), "SELECT vec_id, embedding FROM embeddings WHERE label = 1"),
    "filter_eq": Case("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'", ("orders",), "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
    "filter_ne": Case("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus != 'O'", ("orders",), "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
    "filter_lt": Case("SELECT p_partkey FROM part WHERE p_size < 5", ("part",), "SELECT p_partkey FROM part WHERE p_size < 5"),
    "filter_le": Case("SELECT p_partkey FROM part WHERE p_size <= 5", ("part",), "SELECT p_partkey FROM part WHERE p_size <= 5"),
    "filter_gt": Case("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 49.5", ("lineitem",), "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 49.5"),
    "filter_ge": Case("SELECT c_custkey FROM customer WHERE c_acctbal >= -100.25", ("customer",), "SELECT c_custkey FROM customer WHERE c_acctbal >= -100.25"),
    "filter_bool_tree": Case(
        "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey = 4 AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0)", ("customer",),
        "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR (c_nationkey = 4 AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0))",
    ),
    "filter_params": Case("SELECT o_orderkey FROM orders WHERE o_totalprice >= :low AND :high >= o_totalprice", ("orders",), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 2000.5", {"low": 1000, "high": 2000.5, "unused": None}),
    "filter_literal_left": Case("SELECT n_name FROM nation WHERE 7 > n_nationkey AND 1 = 1", ("nation",), "SELECT n_name FROM nation WHERE n_nationkey < 7"),
    "filter_col_col": Case("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = l_quantity", ("lineitem",), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = l_quantity"),
    "filter_is_null": Case("SELECT c_custkey FROM customer WHERE nick = NULL", ("customer",), f"SELECT c_custkey FROM {_CUSTOMER} WHERE nick IS NULL"),
    "filter_null_col_col": Case("SELECT c_custkey FROM customer WHERE debt = nick OR debt = c_nationkey", ("customer",), f"SELECT c_custkey FROM {_CUSTOMER} WHERE debt IS NOT DISTINCT FROM c_nationkey OR (debt IS NULL AND nick IS NULL)"),
    "filter_ne_keeps_null": Case("SELECT c_custkey, nick FROM customer WHERE nick != 'BUILDING'", ("customer",), f"SELECT c_custkey, nick FROM {_CUSTOMER} WHERE nick IS DISTINCT FROM 'BUILDING'"),
    "filter_cross_type": Case("SELECT p_partkey FROM part WHERE size_name = 10 OR p_size != 'abc' AND p_size = 10", ("part",), "SELECT p_partkey FROM part WHERE p_size = 10"),
    "filter_timestamp": Case("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= :day", ("orders",), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'", {"day": datetime(1998, 1, 1)}),
    "key_lookup": Case("SELECT c_name, c_acctbal FROM customer WHERE _key = :id AND c_acctbal > -100000", ("customer",), "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 77", {"id": 77}),
    "limit_zero": Case("SELECT o_orderkey FROM orders LIMIT 0", ("orders",), "SELECT o_orderkey FROM orders LIMIT 0"),
    "join_key": Case("SELECT o._key, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c._key", ("orders", "customer"), 'SELECT o_orderkey AS "_key", c_name FROM orders JOIN customer ON o_custkey = c_custkey'),
    "join_hash": Case("SELECT s.s_name, c.c_name FROM supplier s INNER JOIN customer c ON c.c_nationkey = s.s_nationkey WHERE c.c_acctbal > 9000", ("supplier", "customer"), "SELECT s_name, c_name FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_acctbal > 9000"),
    "join_multi": Case(
        "SELECT r.r_name, COUNT(*) AS lines, SUM(l.cents) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o._key JOIN customer c ON o.o_custkey = c._key JOIN nation n ON c.c_nationkey = n._key JOIN region r ON n.n_regionkey = r._key "
        "WHERE o.o_orderstatus = 'O' GROUP BY r.r_name", ("lineitem", "orders", "customer", "nation", "region"),
        f"SELECT r_name, count(*) AS lines, CAST(sum(cents) AS BIGINT) AS revenue FROM {_LINES} JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' GROUP BY r_name",
    ),
    "join_self": Case("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey WHERE a.n_nationkey < b.n_nationkey", ("nation",), "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_null_keys": Case("SELECT c.c_mktsegment, COUNT(*) AS n FROM customer c JOIN supplier s ON c.debt = s.debt GROUP BY c.c_mktsegment", ("customer", "supplier"), f"SELECT c_mktsegment, count(*) AS n FROM {_CUSTOMER} c JOIN {_SUPPLIER} s ON c.debt IS NOT DISTINCT FROM s.debt GROUP BY c_mktsegment"),
    "join_mixed_width": Case("SELECT p.p_name, b.item_id FROM part p JOIN benchmark b ON p.p_size = b._key", ("part", "benchmark"), "SELECT p_name, item_id FROM part JOIN benchmark ON p_size = item_id"),
    "join_drops_rows": Case("SELECT d.lang, COUNT(*) AS n, SUM(l.quality) AS good FROM documents d JOIN labels l ON d._key = l._key GROUP BY d.lang", ("documents", "labels"), "SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang"),
    "count_star": Case("SELECT COUNT(*) FROM lineitem", ("lineitem",), "SELECT count(*) AS count FROM lineitem"),
    "count_col": Case("SELECT COUNT(nick) AS named, COUNT(*) AS everyone FROM customer", ("customer",), f"SELECT count(nick) AS named, count(*) AS everyone FROM {_CUSTOMER}"),
    "sum_int": Case("SELECT SUM(p_size) FROM part", ("part",), "SELECT CAST(sum(p_size) AS BIGINT) AS sum FROM part"),
    "sum_float": Case("SELECT SUM(l_quantity) AS total FROM lineitem", ("lineitem",), "SELECT sum(l_quantity) AS total FROM lineitem"),
    "avg": Case("SELECT AVG(l_quantity), AVG(l_linenumber) AS line FROM lineitem", ("lineitem",), "SELECT avg(l_quantity) AS avg, avg(l_linenumber) AS line FROM lineitem"),
    "min_max_string": Case("SELECT MIN(c_name) AS first, MAX(nick) AS last FROM customer", ("customer",), f"SELECT min(c_name) AS first, max(nick) AS last FROM {_CUSTOMER}"),
    "min_max_ts": Case("SELECT MIN(o_orderdate), MAX(o_orderdate) FROM orders", ("orders",), "SELECT min(o_orderdate) AS min, max(o_orderdate) AS max FROM orders"),
    "agg_empty": Case("SELECT COUNT(*) AS rows, COUNT(p_size) AS n, SUM(p_size) AS s, MIN(p_name) AS low FROM part WHERE p_size < 0", ("part",), "SELECT count(*) AS rows, count(p_size) AS n, CAST(sum(p_size) AS BIGINT) AS s, min(p_name) AS low FROM part WHERE p_size < 0"),
    "group_one": Case("SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS quantity, MAX(cents) AS top FROM lineitem GROUP BY l_returnflag", ("lineitem",), f"SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, max(cents) AS top FROM {_LINES} GROUP BY l_returnflag"),
    "group_multi": Case("SELECT l_returnflag, l.l_linestatus, AVG(l_quantity) AS mean FROM lineitem l GROUP BY l.l_returnflag, l_linestatus", ("lineitem",), "SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL"),
    "group_null": Case("SELECT nick, COUNT(*) AS n FROM customer GROUP BY nick", ("customer",), f"SELECT nick, count(*) AS n FROM {_CUSTOMER} GROUP BY nick"),
    "group_distinct": Case("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", ("orders",), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "group_subset": Case("SELECT o_orderstatus FROM orders GROUP BY o_orderstatus, o_orderpriority", ("orders",), "SELECT o_orderstatus FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)"),
    "group_join": Case("SELECT n.n_name, o.year, SUM(o.cents) AS total FROM orders o JOIN customer c ON c._key = o.o_custkey JOIN nation n ON n._key = c.c_nationkey GROUP BY n.n_name, o.year", ("orders", "customer", "nation"), f"SELECT n_name, year, CAST(sum(cents) AS BIGINT) AS total FROM {_ORDERS} JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL"),
    "order_nulls_asc_topk": Case("SELECT c_custkey, debt FROM customer ORDER BY debt, c_custkey LIMIT 400", ("customer",), f"SELECT c_custkey, debt FROM {_CUSTOMER} ORDER BY debt ASC NULLS LAST, c_custkey LIMIT 400"),
    "order_nulls_desc_topk": Case("SELECT c_custkey, debt FROM customer ORDER BY debt DESC, c_custkey DESC LIMIT 100", ("customer",), f"SELECT c_custkey, debt FROM {_CUSTOMER} ORDER BY debt DESC NULLS FIRST, c_custkey DESC LIMIT 100"),
    "order_multi_topk": Case("SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice AS price FROM orders o WHERE o_orderkey > 100 ORDER BY o_orderstatus DESC, price, o.o_orderkey LIMIT 100", ("orders",), "SELECT o_orderkey, o_orderstatus, o_totalprice AS price FROM orders WHERE o_orderkey > 100 ORDER BY o_orderstatus DESC, price, o_orderkey LIMIT 100"),
    "order_by_agg_label": Case("SELECT p_brand, COUNT(*) FROM part GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 5", ("part",), "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 5"),
    "order_full": Case("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey", ("supplier",), "SELECT s_suppkey, s_acctbal FROM supplier"),
    "order_unknown_label": Case("SELECT n_name FROM nation ORDER BY n_regionkey", ("nation",), "SELECT n_name FROM nation"),
}


def scan_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(catalog(spark, sf_dir, "region")).scan("region", "r")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = Engine(catalog(spark, sf_dir, "supplier")).lookup("supplier", "s", 7)
    return spark.createDataFrame([(row["s._key"], row["s.s_name"])], "id long, name string")


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine(catalog(spark, sf_dir, "nation")).stream("SELECT _key, n_name FROM nation WHERE n_regionkey = 2")
    return spark.createDataFrame([(r["_key"], r["n_name"]) for r in rows], "key int, name string")


def shard_union_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    shards = [orders.where(F.col("o_orderkey") % 2 == i) for i in range(2)]
    tables = Catalog().add_shards("orders", shards, "o_orderkey")
    return Engine(tables).query("SELECT o_orderstatus, COUNT(*) AS n, MIN(_key) AS low, MAX(_key) AS high FROM orders GROUP BY o_orderstatus")


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = RecordStore.open(spark, scratch(spark, "index"), "long", "c_name string, c_nationkey int")
    store.put_all(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias(KEY), "c_name", "c_nationkey"))
    tables = Catalog().add_store("customer", store).index("customer", "c_nationkey")
    store.compact()
    return Engine(tables).query("SELECT _key, c_name FROM customer WHERE c_nationkey = :nation", {"nation": 5})


def _event_changes(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias(KEY), "event_type", "value", (F.col("event_type") == "error").alias("_deleted"), F.col("event_id").alias("at"))


def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _event_changes(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return latest_per_key(changes, "at").where("NOT _deleted").select(F.col(KEY).alias("user_id"), "event_type", "value")


def log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, a compaction, a third batch: the same records as in one replay."""
    store = RecordStore.open(spark, scratch(spark, "log"), "long", "event_type string, value double")
    changes = _event_changes(spark.read.parquet(f"{sf_dir}/events.parquet"))
    cut = changes.approxQuantile("at", [1 / 3, 2 / 3], 0.01)
    store.append(changes.where(F.col("at") <= cut[0]), order="at")
    store.append(changes.where((F.col("at") > cut[0]) & (F.col("at") <= cut[1])), order="at")
    store.compact()
    store.append(changes.where(F.col("at") > cut[1]), order="at")
    return store.current().select(F.col(KEY).alias("user_id"), "event_type", "value")


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a store, whose change feed is streamed into a second one."""
    record = "event_type string, value double"
    first, second = (RecordStore.open(spark, scratch(spark, "feed"), "long", record) for _ in range(2))
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    upsert_stream(_event_changes(events), first, scratch(spark, "sink"), "events", "at").awaitTermination()
    follow(first, lambda changes, batch: second.append(changes, token=("feed", batch)), scratch(spark, "follow")).awaitTermination()
    return second.current().select(F.col(KEY).alias("user_id"), "event_type", "value")


def upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias(KEY), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    store = RecordStore.open(spark, scratch(spark, "upsert"), "long", "segment string, nation int")
    store.put_all(customers.where("nation < 20"))
    store.put_if_absent(customers.withColumn("segment", F.lit("LATE")))
    store.replace(customers.where("nation = 4").withColumn("segment", F.lit("FOUR")))
    store.remove_all(customers.where("nation = 3").select(KEY))
    store.merge(customers.where("nation IN (3, 5)"), lambda old, new: F.struct(F.concat(old["segment"], F.lit("+"), new["segment"]).alias("segment"), new["nation"].alias("nation")))
    return store.current().select(F.col(KEY).alias("id"), "segment", "nation")


def evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left (keys that were there, and how many) after eviction above 50 keys."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias(KEY), F.col("s_name").alias("name"))
    store = RecordStore.open(spark, scratch(spark, "evict"), "long", "name string").evict_at(50)
    store.put_all(suppliers)
    return store.current().join(suppliers, [KEY, "name"]).agg(F.count(F.lit(1)).alias("n"))


def fnv_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return names.select("c_name", partition_column(F.col("c_name"), 31).alias("partition"))


def owner_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    topology = Topology.evenly(16, [Node("a"), Node("b"), Node("c")]).reassign({1: "a"})
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias(KEY))
    return topology.place(names).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "json")
    write_json(Engine(catalog(spark, sf_dir, "nation")).query("SELECT n_nationkey AS id, n_name AS name FROM nation"), path)
    return spark.read.text(path)


_REPLAYED = "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"
_FNV = "list_reduce(list_prepend(CAST('14695981039346656037' AS HUGEINT), list_transform(generate_series(1, length(c_name)), lambda i: CAST(ascii(substr(c_name, i, 1)) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % CAST('18446744073709551616' AS HUGEINT))"

FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "scan_qualified": (scan_qualified, 'SELECT r_regionkey AS "r._key", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region'),
    "point_lookup": (point_lookup, "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey = 7"),
    "stream_rows": (stream_rows, "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_regionkey = 2"),
    "shard_union_agg": (shard_union_agg, "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_orderstatus"),
    "index_lookup": (index_lookup, 'SELECT c_custkey AS "_key", c_name FROM customer WHERE c_nationkey = 5'),
    "log_replay": (log_replay, _REPLAYED),
    "log_compact": (log_compact, _REPLAYED),
    "change_feed": (change_feed, _REPLAYED),
    "upsert_delete": (
        upsert_delete,
        "SELECT c_custkey AS id, CASE WHEN c_nationkey >= 20 THEN 'LATE' WHEN c_nationkey = 4 THEN 'FOUR' WHEN c_nationkey = 5 THEN c_mktsegment || '+' || c_mktsegment ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer",
    ),
    "evict": (evict, "SELECT CAST(CASE WHEN count(*) > 50 THEN 45 ELSE count(*) END AS BIGINT) AS n FROM supplier"),
    "fnv_partition": (fnv_partition, f"SELECT c_name, CAST({_FNV} % 31 AS INTEGER) AS partition FROM customer"),
    "owner_batches": (owner_batches, f"SELECT CASE WHEN p = 1 THEN 'a' ELSE substr('abc', CAST(p % 3 AS INTEGER) + 1, 1) END AS owner, count(*) AS n FROM (SELECT {_FNV} % 16 AS p FROM customer) GROUP BY 1"),
    "json_sink": (json_sink, "SELECT CAST(to_json({'id': n_nationkey, 'name': n_name}) AS VARCHAR) AS value FROM nation"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**CASES, **{k: f for k, (f, _) in FUNCTIONS.items()}}
ORACLE_SQL: dict[str, str] = {**{k: c.oracle for k, c in CASES.items()}, **{k: sql for k, (_, sql) in FUNCTIONS.items()}}
