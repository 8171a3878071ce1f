"""Reachability over edges ``src, dst``: frontiers joined level by level, the first visit has the least depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.tables import materialised, numbered


def distance(start: DataFrame, edges: DataFrame, depth: int | None, *, key: list[str] | None = None, cut: bool = True, through: Column | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """``[key...], node, depth``: the least number of edges from the start to each node, up to ``depth`` (None: no bound).

    ``start`` has the key columns and ``node``.  With no key the start is one set: each node is visited once, however
    many starts reach it.  A level is expanded only from nodes that no earlier level holds.  Edges and levels are written
    to the shared folder, so each is computed once, and the search ends once a level is empty; ``cut=False`` leaves all
    in one plan, which suits one or two levels.  ``through``, a test of ``node``: nodes that fail are neither returned
    nor expanded (starts are).  ``also``: further columns, made of ``node`` and ``depth`` once however many keys reach it.

    Keys are numbered and walk together, 64 as the bits of a word: a level holds one row for each node and word, and an
    edge is followed once for all keys of a word.  Rows for each key are made at the end.
    """
    key = key or []
    cut = (cut or depth is None) and depth != 0
    kept = materialised if cut else lambda df: df
    hop = kept(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")))
    at = ["node", "word"]
    if key:
        keys = numbered(start.select(*key).distinct(), key).withColumn("number", F.col("number") - 1)
        keys = materialised(keys.select(*key, F.expr("number div 64").alias("word"), F.expr("cast(number % 64 AS int)").alias("bit")))
        mine = keys.select(*(F.col(k).alias(f"__{k}") for k in key), "word", F.expr("shiftleft(1L, bit)").alias("bits"))
        starts = start.join(mine, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]))
    else:
        starts = start.select("node", F.lit(0).cast("long").alias("word"), F.lit(1).cast("long").alias("bits"))
    joined = lambda df: df.groupBy(*at).agg(F.bit_or("bits").alias("bits"))
    front = kept(joined(starts).withColumn("depth", F.lit(0)))
    levels, level = [front], 0
    while depth is None or level < depth:
        level += 1
        step = front.join(hop, "node").select(F.col("next").alias("node"), "word", "bits")
        step = joined(step if through is None else step.where(through))
        was = joined(reduce(DataFrame.unionByName, levels)).withColumnRenamed("bits", "was")
        new = step.join(was, at, "left").select(*at, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("was", F.lit(0).cast("long")))).alias("bits"))
        front = kept(new.where("bits != 0").withColumn("depth", F.lit(level)))
        if cut and front.isEmpty():
            break
        levels.append(front)
    rows = reduce(DataFrame.unionByName, levels).withColumns(also or {})
    more = ["node", "depth", *(also or {})]
    if not key:
        return rows.select(*more)
    members = materialised(keys.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("bit", *key))).alias("members")))
    if members.count() > 1024:
        members = members.hint("merge")  # not to be broadcast, whatever its size on disk
    there = F.filter("members", lambda x: F.call_function("getbit", F.col("bits"), x["bit"]) == 1)
    return rows.join(members, "word").select(*more, F.explode(there).alias("__key")).select(*(F.col(f"__key.{k}").alias(k) for k in key), *more)


def collected(start: DataFrame, calls: DataFrame, uses: DataFrame, depth: int, *, key: list[str]) -> DataFrame:
    """``key..., dst, depth``: targets of ``uses`` at every node within ``depth`` calls, those at the last level included."""
    near = distance(start, calls, depth, key=key)
    found = near.join(uses.select(F.col("src").alias("node"), "dst"), "node")
    return found.groupBy(*key, "dst").agg(F.min("depth").alias("depth"))


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst, depth``: all ancestors of each node (itself at depth 0) and their least depth, cycles included.

    The reach doubles: a pair farther than ``reach`` goes ``reach`` edges and then on, so pairs of just that depth are
    joined with the nearer ones, and only new pairs are written.  A chain of n edges takes log2(n) rounds.  The result
    holds all pairs by nature.
    """
    hop = materialised(edges.select("src", "dst").where("src != dst").distinct().withColumn("depth", F.lit(1)))
    nodes = hop.select(F.col("src").alias("n")).union(hop.select("dst")).distinct()
    known = [hop]
    selves = materialised(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(0).alias("depth")))
    reach = 1
    while True:
        pairs = reduce(DataFrame.unionByName, known)
        far = known[-1].where(F.col("depth") == reach).select("src", F.col("dst").alias("mid"))
        onward = pairs.select(F.col("src").alias("mid"), "dst", F.col("depth").alias("more"))
        longer = far.join(onward, "mid").groupBy("src", "dst").agg((F.min("more") + reach).alias("depth"))
        new = materialised(longer.where("src != dst").join(pairs, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return selves.unionByName(pairs)
        known.append(new)
        reach *= 2


def within_budget(visited: DataFrame, cost: Column, *, key: list[str], budget: int, least: int) -> DataFrame:
    """Rows of a traversal, in order of depth and node for each key, while more than ``least`` of ``budget`` remains.

    Adds ``seq`` and ``spent`` (the cost before the row).  Costs are not negative: so a level before which the budget is
    spent is left out by its sum, and of a level's rows those that it is spent before among a sixty-fourth of them, dealt
    by a hash.  What a key's one task sorts at the end is what the budget buys of each, not all that was visited.
    """
    visited = visited.withColumn("__cost", cost)
    sums = visited.groupBy(*key, "depth").agg(F.sum("__cost").alias("__sum"))
    levels = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    open_ = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(levels), F.lit(0))).where(F.lit(budget) - F.col("__before") > least)
    open_ = open_.select(*(F.col(k).alias(f"__{k}") for k in key), F.col("depth").alias("__depth"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], F.col("depth") == F.col("__depth"))
    dealt = visited.join(open_, same, "left_semi").withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    some = Window.partitionBy(*key, "__salt").orderBy("depth", "node").rowsBetween(Window.unboundedPreceding, -1)
    bought = F.lit(budget) - F.coalesce(F.sum("__cost").over(some), F.lit(0)) > least
    visited, cost = dealt.withColumn("__bought", bought).where("__bought").drop("__salt", "__bought"), F.col("__cost")
    order = Window.partitionBy(*key).orderBy("depth", "node")
    before = F.coalesce(F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return visited.withColumns({"seq": F.row_number().over(order), "spent": before}).where(F.lit(budget) - F.col("spent") > least).drop("__cost")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns))
