"""The record store, its log, feeds, topology and the HTTP front."""

import http.client
import json
import os
import socket
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from ledgerframe import service
from ledgerframe.engine import Engine
from ledgerframe.functions.codecs import UTF8, json_codec
from ledgerframe.functions.hashing import fnv1a
from ledgerframe.functions.parameters import parse_parameter
from ledgerframe.service import serve
from ledgerframe.sources.catalog import KEY, Catalog
from ledgerframe.sources.jsonrows import as_json
from ledgerframe.store import RecordStore
from ledgerframe.streaming.feed import follow, upsert_stream
from ledgerframe.topology import Node, RoutedStore, Topology, partition_column, partition_of


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore.open(spark, str(tmp_path / "store"), "string", "n int")


def content(store):
    return {r[KEY]: r["n"] for r in store.current().collect()}


def put(store, **values):
    store.put_all(store.frame({k: {"n": v} for k, v in values.items()}))


def test_put_get_remove(store):
    assert store.is_empty() and store.get("a") is None and store.get("a", {"n": 0}) == {"n": 0}
    assert store.put("a", n=1) is None and store.put("a", n=2) == {"n": 1}
    assert store.contains_key("a") and store.contains_value({"n": 2}) and not store.contains_value({"n": 1})
    put(store, b=3, c=None)
    assert store.size() == 3 and store.get("c") == {"n": None}
    assert store.remove("a") == {"n": 2} and store.remove("a") is None
    assert not store.remove_all(store.key_frame(["zz"])) and store.remove_all(store.key_frame(["b", "zz"]))
    store.clear()
    assert content(store) == {}


def test_conditional_writes(store):
    put(store, a=1, b=2)
    assert store.put_if_absent(store.frame({"a": {"n": 9}, "c": {"n": 3}})) == 1
    assert store.replace(store.frame({"a": {"n": 5}, "x": {"n": 1}})) == 1
    assert store.replace_if(store.frame({"a": {"n": 6}, "b": {"n": 6}}), store.frame({"a": {"n": 5}, "b": {"n": 0}})) == 1
    assert store.remove_if(store.frame({"b": {"n": 2}, "c": {"n": 0}})) == 1
    assert content(store) == {"a": 6, "c": 3}
    add = lambda old, new: F.struct((old["n"] + new["n"]).alias("n"))
    assert store.merge(store.frame({"a": {"n": 1}, "d": {"n": 4}}), add) == 2
    assert store.compute(store.key_frame(["c", "q"]), lambda old: F.lit(None).cast("struct<n:int>")) == 1
    assert store.replace_all(lambda old: F.struct((old["n"] * 2).alias("n"))) == 2
    assert content(store) == {"a": 14, "d": 8}


def test_compaction_keeps_the_last_state(spark, store, tmp_path):
    put(store, first=1, second=2, third=3)
    put(store, first=10)
    store.remove("second")
    store.compact()
    assert content(store) == {"first": 10, "third": 3}
    put(store, third=4, fourth=5)
    store.vacuum()
    again = RecordStore.open(spark, str(tmp_path / "store"), "string", "n int")
    assert content(again) == {"first": 10, "third": 4, "fourth": 5}
    again.compact()
    again.compact()
    assert content(again) == {"first": 10, "third": 4, "fourth": 5} and content(store) == content(again)
    for v in range(20):
        put(store, only=v)
    assert store.get("only") == {"n": 19}


def test_a_failed_write_leaves_no_trace(spark, store, tmp_path):
    put(store, a=1)
    os.makedirs(tmp_path / "store/log/000000000002-torn")
    (tmp_path / "store/log/000000000002-torn/part-0.parquet").write_bytes(b"\0\0")
    assert content(store) == {"a": 1}
    with pytest.raises(Exception, match="key cannot be null"):
        store.put_all(store.frame({None: {"n": 1}}))
    assert content(store) == {"a": 1}
    put(store, b=2)
    assert content(store) == {"a": 1, "b": 2}


def test_batches_with_an_order_keep_the_last_change(spark, store):
    changes = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 3, 1)], f"{KEY} string, n int, at int")
    store.put_all(changes, order="at")
    assert content(store) == {"a": 2, "b": 3}


def test_eviction(spark, tmp_path):
    store = RecordStore.open(spark, str(tmp_path / "e"), "int", "n int")
    keys = spark.range(200).select(F.col("id").cast("int").alias(KEY), F.lit(1).alias("n"))
    store.put_all(keys)
    store.evict_at(50)
    assert store.size() == 45 and {r[KEY] for r in store.keys().collect()} <= set(range(200))
    store.put_all(keys.where(f"{KEY} < 3"))
    assert store.size() <= 50
    store.evict_at(10)
    assert store.size() == 9
    RecordStore.open(spark, str(tmp_path / "one"), "int", "n int").evict_at(1).put_all(keys.limit(5))
    with pytest.raises(ValueError):
        store.evict_at(0)


def test_listeners_and_feed(spark, store, tmp_path):
    seen = []
    store.on_change(lambda df: seen.append(sorted(r[KEY] for r in df.collect())))
    put(store, a=1, b=2)
    store.remove("a")
    put(store, b=3)
    assert seen == [["a", "b"], ["a"], ["b"]]
    copy = RecordStore.open(spark, str(tmp_path / "copy"), "string", "n int")
    for _ in range(2):
        follow(store, lambda df, batch: copy.append(df, token=("feed", batch)), str(tmp_path / "check")).awaitTermination()
        assert content(copy) == content(store)
        put(store, c=7)
    copy.append(store.frame({"z": {"n": 1}}).withColumn("_deleted", F.lit(False)), token=("feed", 0))
    assert "z" not in content(copy)


def test_upsert_stream(spark, store, tmp_path):
    rows = [("a", 1, False, 1), ("a", 2, False, 2), ("b", 1, False, 3), ("b", None, True, 4)]
    spark.createDataFrame(rows, f"{KEY} string, n int, _deleted boolean, at int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{KEY} string, n int, _deleted boolean, at int").parquet(str(tmp_path / "in"))
    upsert_stream(stream, store, str(tmp_path / "check"), "in", "at").awaitTermination()
    assert content(store) == {"a": 2}


def test_store_tables_follow_writes_and_indexes(spark, store):
    put(store, a=1, b=2)
    catalog = Catalog().add_store("t", store).index("T", "N").index("t", "n")
    e = Engine(catalog)
    assert e.rows("SELECT _key FROM t WHERE n = 2") == [{"_key": "b"}]
    put(store, c=2)
    store.compact()
    assert sorted(r["_key"] for r in e.rows("SELECT _key FROM t WHERE n = 2")) == ["b", "c"]
    assert "EqualTo(n,2)" in e.explain("SELECT _key FROM t WHERE n = 2")
    for bad in ("_key", "missing"):
        with pytest.raises(ValueError):
            catalog.index("t", bad)
    with pytest.raises(ValueError):
        RecordStore.open(spark, "/tmp/x", "string", "_seq long")
    assert RecordStore.memory(spark).is_empty() and RecordStore.strings(spark, store.log.path + "-s").columns == ["value"]


def test_fnv_and_partitions(spark):
    assert fnv1a(b"") == 0xCBF29CE484222325 and fnv1a(b"a") == 0xAF63DC4C8601EC8C
    keys = [f"key-{i}" for i in range(10_000)] + ["", "é漢😀"]
    for p in (31, 16):
        df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", partition_column(F.col("k"), p).alias("p"))
        found = {r.k: r.p for r in df.collect()}
        assert found == {k: partition_of(k, p) for k in keys} and set(found.values()) == set(range(p))
    assert spark.createDataFrame([(None,)], "k string").select(partition_column(F.col("k"), 3).alias("p")).first().p is None
    with pytest.raises(ValueError):
        partition_of("a", 0)


def test_topology():
    a, b, c = Node("a"), Node("b"), Node("c")
    t = Topology.evenly(32, [a, b, c])
    assert t.owner(4) == b and t.partitions == 32
    assert t.reassign({4: "c"}).owner(4) == c and t.owner(4) == b
    assert t.rebalance([a]).owners == ("a",) * 32 and t.with_nodes([a, b, c, Node("d")]).owners == t.owners
    for bad in (
        lambda: Topology.evenly(0, [a]), lambda: Topology.evenly(1, []), lambda: Topology.evenly(2, [a, Node("a")]), lambda: Topology.assigned([a], ["x"]), lambda: Topology.assigned([a], []),
        lambda: t.reassign({99: "a"}), lambda: t.reassign({0: "x"}), lambda: t.with_nodes([a]), lambda: t.owner(-1), lambda: Node(""),
    ):
        with pytest.raises(ValueError):
            bad()


def test_routed_store(spark, tmp_path):
    nodes = [Node(n, str(tmp_path / n)) for n in "ab"]
    routed = RoutedStore(spark, "m", Topology.evenly(8, nodes))
    df = spark.createDataFrame([(f"k{i}", str(i)) for i in range(20)], f"{KEY} string, value string")
    routed.put_all(df)
    assert all(routed.get(f"k{i}") == {"value": str(i)} for i in (0, 7, 19))
    sizes = [s.count() for s in routed.shards()]
    assert sum(sizes) == 20 and all(sizes)
    routed.put("k0", value="x")
    routed.remove_all(df.where(f"{KEY} IN ('k1', 'k2')").select(KEY))
    assert routed.remove("k3") and not routed.remove("k3")
    assert Engine(Catalog().add_shards("m", routed.shards(), KEY)).rows("SELECT COUNT(*) FROM m") == [{"count": 17}]
    with pytest.raises(ValueError):
        routed.topology = Topology.evenly(9, nodes)
    with pytest.raises(ValueError):
        RoutedStore(spark, "a/b", Topology.evenly(1, nodes))


def test_codecs(spark):
    df = spark.createDataFrame([("é漢😀", (1, None)), (None, None)], "s string, r struct<a:int,b:string>")
    for name, codec in (("s", UTF8), ("r", json_codec("a int, b string"))):
        encoded = df.select(codec.encode(F.col(name)).alias("x"))
        assert encoded.dtypes == [("x", "binary")]
        assert [r[0] for r in encoded.select(codec.decode(F.col("x"))).collect()] == [r[name] for r in df.collect()]
    bad = spark.createDataFrame([(b"\xff{",)], "x binary")
    for codec in (UTF8, json_codec("a int")):
        with pytest.raises(Exception):
            bad.select(codec.decode(F.col("x"))).collect()


def test_text_parameters_and_json():
    assert [parse_parameter(t) for t in ("NULL", "True", "-7", "1.50", "1e5", "", "x")] == [None, True, -7, 1.5, "1e5", "", "x"]
    assert as_json({"a": float("nan"), "b": [1, None, "é\n"], "c": b"x"}) == '{"a":"nan","b":[1,null,"é\\n"],"c":"b\'x\'"}'


def call(server, method, path, body=None, headers=None):
    request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method, data=None if body is None else body.encode(), headers=headers or {})
    try:
        with urllib.request.urlopen(request) as r:
            text = r.read().decode()
            return r.status, json.loads(text) if text else None
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read().decode())


def test_http(store):
    put(store, a=1)
    server = serve(Engine(Catalog().add_store("t", store)), {"t": store}, authorize=lambda r: r.headers.get("X-No") is None)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert call(server, "GET", "/health") == (200, {"status": "ok", "stores": {"t": 1}})
        assert call(server, "GET", "/health", headers={"X-No": "1"})[0] == 401
        assert call(server, "PUT", "/stores/t/entries/b%20c", '{"n": 5}') == (204, None)
        assert call(server, "GET", "/stores/t/entries/b%20c") == (200, {"n": 5})
        assert call(server, "PUT", "/stores/t/entries", '{"d": {"n": 6}, "e": {"n": null}}') == (204, None)
        assert call(server, "POST", "/query?low=5", "SELECT _key, n FROM t WHERE n >= :low ORDER BY n") == (200, {"rows": [{"_key": "b c", "n": 5}, {"_key": "d", "n": 6}]})
        assert call(server, "POST", "/stream", "SELECT n FROM t WHERE _key = 'd'") == (200, {"rows": [{"n": 6}]})
        assert call(server, "POST", "/stream", "SELECT COUNT(*) FROM t")[0] == 400
        assert call(server, "GET", "/lookup?table=t&alias=x&key=a") == (200, {"rows": [{"x._key": "a", "x.n": 1}]})
        assert len(call(server, "GET", "/scan?table=t&alias=x")[1]["rows"]) == 4
        assert call(server, "DELETE", "/stores/t/entries", '["d"]') == (204, None)
        assert call(server, "DELETE", "/stores/t/entries/e") == (204, None)
        assert call(server, "DELETE", "/stores/t/entries/e")[0] == 404
        assert call(server, "POST", "/stores/t/compact") == (204, None) and call(server, "POST", "/stores/t/flush") == (204, None)
        assert call(server, "POST", "/query", "SELECT nothing FROM t")[0] == 400
        assert call(server, "GET", "/query")[0] == 405 and call(server, "GET", "/nowhere")[0] == 404 and call(server, "GET", "/scan?table=t")[0] == 400
        assert content(store) == {"a": 1, "b c": 5}
    finally:
        server.shutdown()


def test_http_rows_go_out_in_chunks(spark, monkeypatch):
    """A long answer is never one text."""
    monkeypatch.setattr(service, "CHUNK_CHARS", 100)
    rows = spark.range(500)
    server = serve(Engine(Catalog().add("t", rows)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with socket.create_connection(server.server_address[:2]) as s:
            s.sendall(b"GET /scan?table=t&alias=x HTTP/1.1\r\nHost: h\r\n\r\n")
            head, _, body = b"".join(iter(lambda: s.recv(1 << 16), b"")).partition(b"\r\n\r\n")
        assert b"Transfer-Encoding: chunked" in head and b"Content-Length" not in head
        sizes = [int(line, 16) for line in body.split(b"\r\n")[0:-2:2]]
        assert len(sizes) > 50 and max(sizes) < 200 and sizes[-1] == 0
        assert call(server, "GET", "/scan?table=t&alias=x") == (200, {"rows": [{"x.id": i} for i in range(500)]})
        assert call(server, "POST", "/stream", "SELECT id FROM t WHERE id < 0") == (200, {"rows": []})
    finally:
        server.shutdown()


def test_http_answer_that_fails_late_is_not_whole(spark, monkeypatch):
    def rows(df):
        yield '{"rows":['
        yield '{"a":1}'
        raise RuntimeError("late")

    monkeypatch.setattr(service, "rows_json", rows)
    server = serve(Engine(Catalog().add("t", spark.range(1))))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with pytest.raises(http.client.HTTPException):
            call(server, "GET", "/scan?table=t&alias=x")
    finally:
        server.shutdown()
