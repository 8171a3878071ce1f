"""Depth-first order of graphs without a task per root: lists ranked by pointer doubling, paths compared as arrays.

A depth-first walk with a visited set enters each node by the lexicographically least of its simple paths (paths written
as the places of their edges among their siblings).  A node with a single edge into it has no choice, so such nodes form
trees below *heads*: the roots, and the nodes with several edges into them.  The trees' Euler tours are lists, ranked in
log2(n) rounds of joins; edges into heads are leaves there, which are counted and take no part in the rounds.  Only the choice of the way into each head is made by
comparing paths, and these name heads alone: rounds grow with the number of heads on a path, not with its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.tables import materialised, numbered


def list_ranks(links: DataFrame) -> DataFrame:
    """``item, total, last``: for lists ``item, next, weight`` (next is null at an end), the weights from each item to its
    list's end, itself included, and the item at that end.

    Each round doubles the stretch that an item has summed.  Items of lists that lead into a circle are left out.
    """
    at = materialised(links.select("item", "next", F.col("weight").cast("long").alias("total"), F.col("item").alias("last")))
    done, moving = [at.where("next IS NULL")], at.where("next IS NOT NULL")
    left = moving.count()
    while left:
        ahead = reduce(DataFrame.unionByName, [*done, moving]).select(F.col("item").alias("next"), F.col("next").alias("onward"), F.col("total").alias("more"), F.col("last").alias("far"))
        step = moving.join(ahead, "next").select("item", F.col("onward").alias("next"), (F.col("total") + F.col("more")).alias("total"), F.col("far").alias("last"))
        step = materialised(step)
        done.append(step.where("next IS NULL"))
        moving = step.where("next IS NOT NULL")
        was, left = left, moving.count()
        if was == left:
            break  # on circles nothing ends
    return reduce(DataFrame.unionByName, done).select("item", "total", "last")


def _trees(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by head (``head, node, parent, place``) and, of the edges from a head's tree into another head, the first
    (``head, node, parent, place``).

    The lists hold the events of inner nodes alone: the leaves (edges into heads) that follow an event directly are a run
    that it counts in its weight, and stand in it by their numbers.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(roots.select("root")).distinct()
    marked = nodes.join(into, "node", "left").join(roots.select(F.col("root").alias("node"), F.lit(True).alias("is_root")), "node", "left")
    heads = materialised(numbered(marked.where("is_root OR n IS NULL OR n > 1").select("node"), ["node"]).select("node", (-F.col("number")).alias("item")))
    leaves = edges.join(heads.select(F.col("node").alias("dst"), F.lit(True).alias("is_head")), "dst", "left").withColumn("leaf", F.col("is_head").isNotNull())
    items = numbered(leaves, ["src", "seq", "dst"], F.when(F.col("leaf"), 0).otherwise(1))  # siblings stand next to each other
    items = materialised(items.select(F.col("number").alias("item"), "src", "dst", "leaf", F.col("running").alias("run")))
    inner = items.where("NOT leaf")
    entry = heads.unionByName(inner.select(F.col("dst").alias("node"), "item"))  # one item for each node
    # a run is named by its node and the number of inner items before it
    runs = items.where("leaf").groupBy("src", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.min(F.col("run") - F.when(F.col("leaf"), 0).otherwise(1)).alias("run")
    first = items.groupBy("src").agg(F.min("item").alias("first"), before, F.min(F.when(~F.col("leaf"), F.col("item"))).alias("inside"))
    own = entry.select(F.col("node").alias("src"), "item")
    enter = materialised(own.join(first, "src", "left").join(runs, ["src", "run"], "left"))
    sibling = inner.select("src", (F.col("run") - 1).alias("run"), F.col("item").alias("sib"))
    leave = inner.select("src", "run", "item").join(own.withColumnRenamed("item", "up"), "src").join(sibling, ["src", "run"], "left")
    leave = materialised(leave.join(runs, ["src", "run"], "left"))
    # entering an item is event 2 * item, leaving it is the one after
    n = F.coalesce("n", F.lit(0))
    links = enter.select((2 * F.col("item")).alias("item"), F.coalesce(2 * F.col("inside"), 2 * F.col("item") + 1).alias("next"), (n + 1).alias("weight"))
    links = links.unionByName(leave.select((2 * F.col("item") + 1).alias("item"), F.coalesce(2 * F.col("sib"), 2 * F.col("up") + 1).alias("next"), n.alias("weight")))
    links = links.unionByName(heads.select((2 * F.col("item") + 1).alias("item"), F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("weight")))
    ranks = materialised(list_ranks(links))
    size = ranks.where("item = last - 1").select("last", F.col("total").alias("size"))
    placed = ranks.join(size, "last").select(F.col("item").alias("event"), "last", (F.col("size") - F.col("total")).alias("place"))
    placed = materialised(placed.join(heads.select((2 * F.col("item") + 1).alias("last"), F.col("node").alias("head")), "last").select("event", "head", "place"))
    alone = heads.select(F.col("node").alias("head"), "node", F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.lit(0).cast("long").alias("place"))
    inside = placed.join(inner.withColumn("event", 2 * F.col("item")), "event")
    tree = alone.unionByName(inside.select("head", F.col("dst").alias("node"), F.col("src").alias("parent"), "place"))
    starts = enter.where("first IS NOT NULL").select("src", "run", (2 * F.col("item")).alias("event"), (1 - F.col("first")).alias("shift"))
    starts = starts.unionByName(leave.select("src", "run", (2 * F.col("item") + 1).alias("event"), (-1 - F.col("item")).alias("shift")))
    starts = starts.join(placed, "event").select("src", "run", "head", (F.col("place") + F.col("shift")).alias("shift"))
    across = items.where("leaf").join(starts, ["src", "run"]).select("head", F.col("dst").alias("node"), F.col("src").alias("parent"), (F.col("item") + F.col("shift")).alias("place"))
    across = across.groupBy("head", "node").agg(F.min_by("parent", "place").alias("parent"), F.min("place").alias("place"))
    return materialised(tree), materialised(across)


def preorder(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, node, parent, number``: the nodes that a depth-first walk from each root visits, numbered from 1 as it
    enters them, and the node from which it does.

    ``edges``: src, dst, seq; a node's edges are followed by seq, then dst, and of several to one node the first counts.
    ``roots``: root.  Each root has a visited set of its own.
    """
    one = materialised(edges.where("src != dst").groupBy("src", "dst").agg(F.min("seq").alias("seq")))
    roots = materialised(roots.select("root").where("root IS NOT NULL").distinct())
    tree, across = _trees(one, roots)
    none = F.array().cast("array<bigint>")
    front = materialised(roots.select("root", F.col("root").alias("head"), none.alias("path"), F.lit(None).cast(one.schema["src"].dataType).alias("via")))
    fronts = []
    while not front.isEmpty():
        fronts.append(front)
        step = front.join(across, "head").where("node != root").select("root", F.col("node").alias("head"), F.concat("path", F.array("place")).alias("path"), F.col("parent").alias("via"))
        least = materialised(step.groupBy("root", "head").agg(F.min(F.struct("path", "via")).alias("new")))
        # what is written is small on disk, so its size says little: merged, not broadcast
        met = reduce(DataFrame.unionByName, fronts).join(least.select("root", "head").hint("merge"), ["root", "head"], "left_semi")
        known = met.groupBy("root", "head").agg(F.min("path").alias("was"))
        front = materialised(least.join(known.hint("merge"), ["root", "head"], "left").where("was IS NULL OR new.path < was").select("root", "head", "new.path", "new.via"))
    best = reduce(DataFrame.unionByName, fronts, front).groupBy("root", "head").agg(F.min(F.struct("path", "via")).alias("new")).select("root", "head", "new.*")
    found = best.join(tree, "head").select("root", "node", F.coalesce("parent", F.when(F.col("node") == F.col("head"), F.col("via"))).alias("parent"), F.concat("path", F.array("place")).alias("path"))
    ordered = materialised(numbered(found, ["root", "path"]))
    begins = ordered.groupBy("root").agg((F.min("number") - 1).alias("before"))
    return ordered.join(begins, "root").select("root", "node", "parent", (F.col("number") - F.col("before")).alias("number"))
