"""Mixing sources to target weights, with DataFrame and SQL functions only.

Targets.  Sources in code-point order weigh 5, 2, 1, repeating, and share all words; no
target exceeds ``MOST_PASSES`` times its source, and what is cut off is shared again by
weight until none is above (water filling).

Blocks.  A keyed hash puts a source's documents in order; equal stretches of hashes, of about
``BLOCK_WORDS`` words each, are its blocks.  A source goes in as often as its target holds it
whole, with all blocks; of one more pass the first blocks go in, up to where the target falls.
That place is found from sums of 16-way cells of the hash, level after level, so that no
window and no group ever holds more than 16 cells or about ``POOL`` documents.  In the cell
where the target falls documents go in by hash until one doesn't fit; the rest of the room is
filled with the largest documents that fit, and one more document goes in, or replaces
another, if that comes nearer to the target.

Quotas.  The blocks that go in are an exact count for each source.  A binary tree splits the
counts of all sources among the output shards: at every node the left child's counts are a
multivariate hypergeometric draw, made by halving the list of sources again and again, each
half's share drawn by inversion of a keyed uniform.

Draws.  A keyed bijection (a swap-or-not shuffle) permutes each source's blocks; shards draw
disjoint stretches of the permuted blocks, as long as their quotas.  A document is taken once
for each of its blocks' draws.  Within a shard documents are ordered by another keyed hash.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
SEED = 17
#: Words in a block, about.
BLOCK_WORDS = 32_768
#: By default the tree is as deep as gives shards of at most so many words ...
SHARD_WORDS = 1 << 20
#: ... but has no more than this many levels; larger shards are dealt out in pieces.
TREE_DEPTH = 12
#: Words that a task of the dealt mix gets, about.
TASK_WORDS = 1 << 24
#: Rounds of the swap-or-not shuffle.
ROUNDS = 16
#: A cell of so many documents is searched one by one.
POOL = 512
#: A per-source table of at most so many values is broadcast; a larger one is shuffled.
BROADCAST_VALUES = 1_000_000
#: Levels of cells; the deepest has 16 ** CELLS of them a source.
CELLS = 6
#: Shards in a row of the two-step table of quotas.
_ROW = 64

_WHITE = " \\t\\n\\x0B\\f\\r"


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    cut = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(cut), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(cut, f"[{_WHITE}]+"))).cast("long")


def keyed(seed: int, *parts: Column) -> Column:
    """A keyed 60-bit hash that any SQL engine with MD5 can compute."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int, name: str = "_mix") -> DataFrame:
    """``docs`` with a struct ``name`` of every document's source, size and hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.struct(F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("_size"), keyed(seed, F.col("doc_id"), F.md5(text.cast("binary"))).alias("_hash"))
    return docs.withColumn(name, parts)


def _cell(level: int) -> Column:
    """Digit of the hash's path: 4 bits a level."""
    return F.shiftright("_hash", 60 - 4 * level).bitwiseAND(F.lit(15)).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, docs, target.

    The caps that bind are those of the sources with the smallest cap per weight; with them
    set, the others share the rest by weight.
    """
    per_source = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    cap = MOST_PASSES * F.col("source_size")
    listed = per_source.withColumn("weight", weight).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    listed = listed.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "shared": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # words per weight if this source and those after it are uncapped; the first that fits ends the capped ones
    listed = listed.withColumn("free", F.col("cap") * F.col("shared") >= F.col("weight") * F.col("rest"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rest", "shared"))).over(everything)
    share = level["rest"].cast("double") / level["shared"]
    capped = ~F.max(F.when(F.col("free"), 1).otherwise(0)).over(by_ratio).cast("boolean")
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * share)
    return listed.select("source", "source_size", "docs", target.alias("target"))


def _boundary(cells: DataFrame, by: list[str]) -> DataFrame:
    """Of each source's 16 cells, the first whose running sum reaches the rest, and the sum before it."""
    w = Window.partitionBy(*by).orderBy("cell")
    run = cells.withColumn("upto", F.sum("words").over(w))
    found = run.where(F.col("before") + F.col("upto") >= F.col("rest"))
    first = found.groupBy(*by).agg(F.min(F.struct("cell", "words", "docs", "upto", "before")).alias("c"))
    return first.select(*by, F.col("c.cell").alias("cell"), (F.col("c.before") + F.col("c.upto") - F.col("c.words")).alias("before"), F.col("c.docs").alias("docs"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def passes(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole passes, the path of full cells and the documents picked in the last one.

    A document is in the partial pass if its hash path lies before ``path`` or its hash is in
    ``picked``.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = goals.withColumn("whole", F.least(whole, F.lit(MOST_PASSES)))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    plan = plan.withColumn("rest", F.when((F.col("whole") < MOST_PASSES) & (rest >= 0.5), rest).otherwise(0.0))
    here = plan.select("source", "rest", F.lit(0).cast("long").alias("before"), "docs", F.array().cast("array<int>").alias("path")).where("rest > 0")
    # levels are written, a row a source: in one plan each would hold copies of all before it
    here = written(here, "level")
    small = [here.where(F.col("docs") <= POOL)]
    for level in range(1, CELLS + 1):
        open_ = here.where(F.col("docs") > POOL).withColumnRenamed("source", "s").drop("docs")
        if open_.isEmpty():
            break
        digits = F.array(*[_cell(k) for k in range(1, level)]).cast("array<int>")
        inside = sizes.join(open_, _same("source", "s") & (digits == F.col("path")))
        cells = inside.groupBy("source", "path", "rest", "before", _cell(level).alias("cell")).agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("docs"))
        here = _boundary(cells, ["source", "path", "rest"]).select("source", "rest", "before", "docs", F.concat("path", F.array("cell")).alias("path"))
        here = written(here, "level")
        small.append(here if level == CELLS else here.where(F.col("docs") <= POOL))
    done = functools.reduce(DataFrame.unionByName, small)
    last = done.select(F.col("source").alias("s"), "rest", "before", "path")
    digits = F.array(*[_cell(k) for k in range(1, CELLS + 1)])
    pool = sizes.join(last, _same("source", "s") & (F.slice(digits, F.lit(1), F.size("path")) == F.col("path")))
    # rows that are equal in all that is hashed go together
    pool = pool.groupBy("source", "rest", "before", "path", "_hash").agg(F.sum("_size").alias("words"))
    pool = pool.groupBy("source", "rest", "before", "path").agg(F.sort_array(F.collect_list(F.struct("_hash", "words"))).alias("pool"))
    take = "named_struct('room', a.room - x.words, 'picked', concat(a.picked, array(x)), 'open', a.open)"
    first = f"""aggregate(pool, named_struct('room', rest - before, 'picked', filter(pool, x -> false), 'open', true),
        (a, x) -> if(a.open and x.words <= a.room, {take}, named_struct('room', a.room, 'picked', a.picked, 'open', false)))"""
    left = """transform(array_sort(transform(slice(pool, size(first.picked) + 1, size(pool)), x -> named_struct('order', -x.words, '_hash', x._hash))),
        x -> named_struct('_hash', x._hash, 'words', -x.order))"""
    pool = pool.withColumn("first", F.expr(first)).withColumn("left", F.expr(left))
    pool = pool.withColumn("filled", F.expr(f"aggregate(left, first, (a, x) -> if(x.words <= a.room, {take}, a))"))
    # the one addition or exchange that comes nearest to the target
    miss = "abs(filled.room - u.words + p.words)"
    last = f"""aggregate(array_except(left, filled.picked), named_struct('miss', filled.room, 'add', cast(null as bigint), 'drop', cast(null as bigint)),
        (b, u) -> aggregate(concat(array(named_struct('_hash', cast(null as bigint), 'words', 0L)), filled.picked), b,
            (c, p) -> if({miss} < c.miss, named_struct('miss', {miss}, 'add', u._hash, 'drop', p._hash), c)))"""
    pool = pool.withColumn("last", F.expr(last))
    hashes = F.expr("filter(concat(transform(filled.picked, x -> x._hash), array(last.add)), h -> h is not null and not h <=> last.drop)")
    picked = pool.select(F.col("source").alias("s"), "path", hashes.alias("picked"))
    return plan.join(picked, _same("source", "s"), "left").select("source", "source_size", "target", "whole", "path", "picked")


def _log_factorial(x: str) -> str:
    return f"""if({x} < 16, ln(cast(factorial(cast(least({x}, 20) as int)) as double)),
        ({x} + 0.5) * ln(cast({x} as double)) - {x} + 0.9189385332046727D + 1D / (12 * {x}) - 1D / (360 * pow({x}, 3)) + 1D / (1260 * pow({x}, 5)))"""


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for a hypergeometric draw by inversion of ``uniform``.

    The mass outside ten standard deviations of the mean (below 1e-20) is left out.
    """
    mean = f"({drawn} * {marked} / greatest({total}, 1D))"
    wide = f"(10 * sqrt({mean} * ({total} - {marked}) / greatest({total}, 1D)) + 10)"
    low = f"cast(greatest({drawn} - ({total} - {marked}), 0, floor({mean} - {wide})) as bigint)"
    high = f"cast(least({marked}, {drawn}, ceil({mean} + {wide})) as bigint)"
    p = f"exp({_log_choose(marked, 'k')} + {_log_choose(f'({total} - {marked})', f'({drawn} - k)')} - {_log_choose(total, drawn)})"
    return f"""aggregate(sequence({low}, {high}), named_struct('sum', 0D, 'at', cast(-1 as bigint), 'top', cast(0 as bigint)),
        (b, k) -> named_struct('sum', b.sum + {p}, 'at', if(b.at < 0 and b.sum + {p} >= {uniform}, k, b.at), 'top', k), b -> if(b.at < 0, b.top, b.at))"""


def n_blocks(size: str) -> Column:
    """Bits that name a block of a source: a power of two of blocks."""
    return F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.col(size), F.lit(1)) / F.lit(float(BLOCK_WORDS)))))).cast("int")


def block_counts(plan: DataFrame) -> DataFrame:
    """``plan`` with bits (of a block's name) and blocks, the exact number that goes in."""
    plan = plan.withColumn("bits", n_blocks("source_size"))
    # the block of the last hash that the partial pass may hold
    last = "shiftleft(1L, 60 - 4 * size(path)) * (aggregate(path, 0L, (a, d) -> a * 16 + d) + 1) - 1"
    partial = F.when(F.col("path").isNotNull(), F.expr(f"shiftright({last}, 60 - bits)") + 1)
    return plan.withColumn("blocks", (F.col("whole") * F.expr("shiftleft(1L, bits)") + F.coalesce(partial, F.lit(0))).cast("long"))


def split_tree(plan: DataFrame, seed: int, depth: int) -> DataFrame:
    """source, shard, blocks: exact quotas of every shard; ``plan`` has source and blocks.

    A node is a row with a count for each source; its children get half of its blocks each,
    rounded down on the left.  Which, is drawn for the first half of the sources together,
    then for each half's halves, and so on: as many draws as sources, on lists that double.
    """
    rows = plan.select("source", "blocks")
    node = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "blocks"))).alias("x"))
    node = node.select(F.lit(1).cast("long").alias("node"), F.expr("transform(x, s -> s.source)").alias("sources"), F.expr("transform(x, s -> s.blocks)").alias("q"))
    steps = max(0, (max(1, rows.count()) - 1).bit_length())
    for level in range(depth):
        if level and level % 2 == 0:
            # two levels a plan: the driver would hold the draws of all levels in one, and compile each anew
            node = written(node, "tree")
        if level % 4 == 3:
            node = node.repartition("node")
        # sums over groups of 2 ** k sources, the list padded with zeros
        node = node.withColumn("q", F.expr(f"concat(q, array_repeat(0L, {1 << steps} - size(q)))")).withColumn("t0", F.col("q"))
        for k in range(steps):
            node = node.withColumn(f"t{k + 1}", F.expr(f"transform(sequence(0, {(1 << (steps - k - 1)) - 1}), i -> t{k}[2 * i] + t{k}[2 * i + 1])"))
        node = node.withColumn("took", F.expr(f"array(t{steps}[0] div 2)"))
        for k in range(steps - 1, -1, -1):
            uniform = f"(cast(conv(substring(md5(cast(concat_ws('|', '{seed}', 'tree', cast(node as string), '{k}', cast(i as string)) as binary)), 1, 13), 16, 10) as double) + 0.5D) / 4503599627370496D"
            draw = hypergeometric(f"t{k + 1}[i]", f"t{k}[2 * i]", "took[i]", uniform)
            node = node.withColumn("took", F.expr(f"flatten(transform(sequence(0, {(1 << (steps - k - 1)) - 1}), i -> transform(array({draw}), d -> array(d, took[i] - d))[0]))"))
        right = F.expr("zip_with(q, took, (a, d) -> a - d)")
        sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("took").alias("q")), F.struct(F.lit(1).alias("side"), right.alias("q"))))
        node = node.select("node", "sources", sides.alias("c")).select((F.col("node") * 2 + F.col("c.side")).alias("node"), "sources", F.col("c.q").alias("q"))
    leaf = node.select((F.col("node") - (1 << depth)).cast("int").alias("shard"), F.posexplode("sources").alias("i", "source"), "q")
    return leaf.select("source", "shard", F.expr("q[i]").alias("blocks"))


def mix_plan(sizes: DataFrame, seed: int = SEED, depth: int | None = None, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, int]:
    """One row per source, what :func:`place` needs to decide on a document by itself, and the tree's depth."""
    plan = written(block_counts(passes(sizes, written(targets(sizes, weights), "targets"))), "passes")
    if depth is None:
        words = plan.agg(F.sum("target")).first()[0] or 0
        depth = min(TREE_DEPTH, max(0, math.ceil(math.log2(max(1, words) / SHARD_WORDS))))
    quotas = split_tree(plan, seed, depth).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("quotas"))
    quotas = quotas.withColumnRenamed("source", "s")
    # running sums of the quotas, in rows of _ROW shards, and the last sum of every row
    run = F.expr("aggregate(quotas, cast(array() as array<bigint>), (a, x) -> array_append(a, coalesce(try_element_at(a, -1), 0L) + x.blocks))")
    out = plan.join(quotas, _same("source", "s"), "left").withColumn("run", run).withColumn("ends", F.expr(f"transform(sequence(0, (size(run) - 1) div {_ROW}), i -> slice(run, i * {_ROW} + 1, {_ROW}))"))
    out = out.withColumn("tops", F.expr("transform(ends, e -> element_at(e, -1))")).drop("s", "quotas", "run")
    return written(out.withColumn("keys", round_keys(F.col("blocks"), F.col("source"), seed)), "plan"), depth


def round_keys(n: Column, source: Column, seed: int) -> Column:
    """Of every round of a source's shuffle the key that pairs places below ``n`` and the key of the coins."""

    def key(i: Column) -> Column:
        pairs = F.pmod(F.xxhash64(F.lit(seed), F.lit("key"), source, i), F.greatest(n, F.lit(1).cast("long")))
        return F.struct(pairs.alias("pairs"), F.xxhash64(F.lit(seed), F.lit("bit"), source, i).alias("coins"))

    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), key)


def permuted(block: Column, n: Column, keys: Column) -> Column:
    """The place of ``block`` among ``n`` after a swap-or-not shuffle: a bijection of 0 .. n - 1 for any n."""

    def swap(x: Column, key: Column) -> Column:
        other = F.pmod(key["pairs"] - x, n)
        return F.when(F.xxhash64(key["coins"], F.greatest(x, other)).bitwiseAND(F.lit(1).cast("long")) == 0, x).otherwise(other)

    return F.aggregate(keys, block, swap)


def place(docs: DataFrame, plan: DataFrame, seed: int = SEED, name: str = "_mix") -> DataFrame:
    """``docs`` (from :func:`sized`) with ``name`` as struct of size, source_size, target, copies, taken and places.

    ``places`` has, for each draw, the copy's number, its block's place in the permuted blocks,
    the shard and the place within it.
    """
    held = F.struct("source_size", "target", "whole", "path", "picked", "bits", "blocks", "ends", "tops", "keys").alias("p")
    slim = plan.select(F.col("source").alias("s"), held)
    values = plan.select(F.count(F.lit(1)), F.sum(F.size(F.flatten("ends")) + F.coalesce(F.size("picked"), F.lit(0)) + 16 + 2 * ROUNDS)).first()
    if (values[1] or 0) <= BROADCAST_VALUES:
        slim = F.broadcast(slim)
    key, plan_key = fresh("s", docs.columns), fresh("p", docs.columns)
    slim = slim.withColumnsRenamed({"s": key, "p": plan_key})
    m, p = F.col(name), F.col(plan_key)
    both = docs.join(slim, m["source"].eqNullSafe(F.col(key)), "left")
    digits = F.array(*[F.shiftright(m["_hash"], 60 - 4 * k).bitwiseAND(F.lit(15)).cast("int") for k in range(1, CELLS + 1)])
    depth = F.size(p["path"])
    earlier = (depth > 0) & (F.slice(digits, F.lit(1), F.greatest(depth, F.lit(1))) < p["path"])
    partial = F.coalesce(earlier | F.array_contains(p["picked"], m["_hash"]), F.lit(False))
    copies = p["whole"] + partial.cast("int")
    cell = F.call_function("shiftright", m["_hash"], F.lit(60) - p["bits"])

    # step by step, since a lambda computes again, for every element, what it doesn't get as a value
    def permute(k: Column) -> Column:
        block = (k.cast("long") - 1) * F.call_function("shiftleft", F.lit(1).cast("long"), p["bits"]) + cell
        return F.struct(k.alias("copy"), permuted(block, p["blocks"], p["keys"]).alias("block"))

    def find_row(d: Column) -> Column:
        return F.struct(d["copy"].alias("copy"), d["block"].alias("block"), F.size(F.filter(p["tops"], lambda e: e <= d["block"])).alias("row"))

    def find_shard(d: Column) -> Column:
        shard = d["row"] * _ROW + F.size(F.filter(F.get(p["ends"], d["row"]), lambda e: e <= d["block"]))
        place = F.xxhash64(F.lit(seed), F.lit("place"), m["_hash"], d["copy"])
        return F.struct(d["copy"].alias("copy"), d["block"].alias("block"), shard.cast("int").alias("shard"), place.alias("place"))

    drawn = F.filter(F.sequence(F.lit(1), F.lit(MOST_PASSES + 1)), lambda k: k <= copies)
    for step in (permute, find_row, find_shard):
        drawn = F.transform(drawn, step)
    # a block beyond the last quota would have no shard
    both = both.withColumn(key, F.filter(drawn, lambda d: d["shard"].isNotNull()))
    taken = F.size(key)
    return both.withColumn(name, F.struct(m["_size"].alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), taken.alias("copies"), (taken * m["_size"]).alias("taken"), F.col(key).alias("places"))).drop(key, plan_key)


ADDED = ("size", "source_size", "target", "copies", "taken", "places")


def mix_sources(docs: DataFrame, seed: int = SEED, depth: int | None = None, weights: tuple[int, ...] = WEIGHTS, into: str | None = None) -> DataFrame:
    """Columns of ``docs`` with size, source_size, target, copies, taken and places.

    One row per row of ``docs``; every copy of a document is whole.  Null texts have size 0;
    a null source is a source of its own, after all others; rows equal in id and text are
    taken alike.  The result depends on ids, texts, sources and ``seed`` only; ``depth`` (by
    default from the words and ``SHARD_WORDS``) only deals the draws out to 2 ** depth shards.
    With ``into`` the added columns are fields of one struct of that name, and no column of
    ``docs`` is touched; else columns of ``docs`` that have their names are replaced.
    """
    name = into or fresh("_mix", docs.columns)
    out = written(sized(docs, seed, name), "sized")
    sizes = out.select(f"`{name}`.*")
    out = place(out, mix_plan(sizes, seed, depth, weights)[0], seed, name)
    return out if into else out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED], f"`{name}`.*")


def dealt(docs: DataFrame, seed: int = SEED, depth: int | None = None) -> DataFrame:
    """A row for every draw of the mix, dealt out by shard and shuffled within it; columns of ``docs``.

    A shard is one task, or several if it has more than about ``TASK_WORDS`` words: so many
    tasks as the words ask for, and no fewer than ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    name = fresh("_mix", docs.columns)
    out = written(sized(docs, seed, name), "sized")
    plan, depth = mix_plan(out.select(f"`{name}`.*"), seed, depth)
    words = plan.agg(F.sum("target")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / TASK_WORDS))
    pieces = max(1, math.ceil(tasks / (1 << depth)))
    at = fresh("_at", [*docs.columns, name])
    rows = place(out, plan, seed, name).withColumn(at, F.explode(F.col(name)["places"])).drop(name)
    shard, order = F.col(at)["shard"], F.col(at)["place"]
    rows = rows.repartition(max(tasks, 1 << depth), shard, F.pmod(order, F.lit(pieces))).sortWithinPartitions(shard, order)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "_mix"
    # texts are read once: sizes and hashes are all that is written
    sizes = written(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), SEED, name).select("doc_id", name), "sized")
    mixed = place(sizes, mix_plan(sizes.select(f"{name}.*"))[0])
    return mixed.select("doc_id", *[F.col(name)[c].alias(c) for c in ("size", "source_size", "target", "taken")])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, count(*) AS docs, 3 * sum(size) AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), w AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS shared
  FROM s WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, cap * shared >= weight * rest AS free FROM w
), level AS (
  SELECT CAST(rest AS DOUBLE) / shared AS share FROM f WHERE free ORDER BY cap / weight, rest, shared LIMIT 1
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, docs,
    CASE WHEN bool_or(free) OVER (ORDER BY cap / weight, source NULLS LAST) THEN weight * (SELECT share FROM level) ELSE CAST(cap AS DOUBLE) END AS target
  FROM f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t
), goal AS (
  SELECT *, CASE WHEN whole < 3 AND target - whole * source_size >= 0.5 THEN target - whole * source_size ELSE 0 END AS rest FROM p
), run AS (  -- words up to each document in hash order
  SELECT d.source, d.h, d.size, g.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source WHERE g.rest > 0
), edge AS (
  SELECT source, min(h) AS h FROM run WHERE upto >= rest GROUP BY source
), cell AS (  -- the first level at which the cell of the edge has few documents
  SELECT e.source, e.h, l.level FROM edge e, (SELECT unnest(range(7)) AS level) l JOIN d ON d.source IS NOT DISTINCT FROM e.source AND d.h >> (60 - 4 * l.level) = e.h >> (60 - 4 * l.level)
  GROUP BY e.source, e.h, l.level HAVING count(*) <= 512 OR l.level = 6
), path AS (
  SELECT source, min(level) AS level, arg_min(h >> (60 - 4 * level), level) AS cell FROM cell GROUP BY source
), pool AS (
  SELECT x.source, x.h, x.size, g.rest - (SELECT coalesce(sum(y.size), 0) FROM d y WHERE y.source IS NOT DISTINCT FROM x.source AND y.h >> (60 - 4 * c.level) < c.cell) AS room
  FROM (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h) x JOIN path c ON x.source IS NOT DISTINCT FROM c.source AND x.h >> (60 - 4 * c.level) = c.cell
  JOIN goal g ON x.source IS NOT DISTINCT FROM g.source
), first AS (  -- by hash until one doesn't fit
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) <= room AS fits, row_number() OVER (PARTITION BY source ORDER BY h) AS i FROM pool
), room AS (
  SELECT source, any_value(room) - coalesce(sum(size) FILTER (fits), 0) AS room FROM first GROUP BY source
), rest AS (
  SELECT source, h, size, row_number() OVER (PARTITION BY source ORDER BY size DESC, h) AS i FROM first WHERE NOT fits
), greedy AS (  -- then the largest that fit
  SELECT source, CAST(0 AS BIGINT) AS i, CAST(room AS DOUBLE) AS room, false AS took FROM room
  UNION ALL
  SELECT g.source, r.i, CASE WHEN r.size <= g.room THEN g.room - r.size ELSE g.room END, r.size <= g.room FROM greedy g JOIN rest r ON r.source IS NOT DISTINCT FROM g.source AND r.i = g.i + 1
), filled AS (
  SELECT source, arg_max(room, i) AS room FROM greedy GROUP BY source
), picked AS (
  SELECT source, h, size, 0 AS a, i AS b FROM first WHERE fits
  UNION ALL SELECT r.source, r.h, r.size, 1, r.i FROM rest r JOIN greedy g ON r.source IS NOT DISTINCT FROM g.source AND r.i = g.i WHERE g.took
), unpicked AS (
  SELECT r.* FROM rest r JOIN greedy g ON r.source IS NOT DISTINCT FROM g.source AND r.i = g.i WHERE NOT g.took
), last AS (  -- then one addition or exchange, if it comes nearer
  SELECT u.source, u.h AS added, p.h AS dropped, row_number() OVER (PARTITION BY u.source ORDER BY abs(f.room - u.size + p.size), u.i, p.a, p.b) AS best
  FROM unpicked u JOIN filled f ON u.source IS NOT DISTINCT FROM f.source
  JOIN (SELECT source, h, size, a, b FROM picked UNION ALL SELECT source, NULL, 0, -1, 0 FROM filled) p ON p.source IS NOT DISTINCT FROM u.source
  WHERE abs(f.room - u.size + p.size) < f.room
), chosen AS (
  SELECT p.source, p.h FROM picked p WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.best = 1 AND l.source IS NOT DISTINCT FROM p.source AND l.dropped = p.h)
  UNION SELECT source, added FROM last WHERE best = 1
)
SELECT d.doc_id, d.size, g.source_size, g.target,
  CAST(d.size * (g.whole + CASE WHEN c.h IS NOT NULL OR (x.level > 0 AND d.h >> (60 - 4 * x.level) < x.cell) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN path x ON d.source IS NOT DISTINCT FROM x.source
LEFT JOIN chosen c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""
