"""What generic types bind through inheritance: maps that are composed along paths, each pair of types once."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import closure
from weftline.operators.tables import best_per_key, materialised

TOKEN = re.compile(r"\?\s*(?:extends|super)\s+|[\w$.?]+|[<>,]|\[\]")


@lru_cache(maxsize=65_536)
def parsed(expression: str) -> tuple:
    """A type as (wildcard prefix, name, arguments, dimensions)."""
    tokens, at = TOKEN.findall(expression), 0

    def one() -> tuple:
        nonlocal at
        wild = ""
        if tokens[at].startswith("?") and len(tokens[at]) > 1:
            wild, at = tokens[at], at + 1
        name, args, dims = tokens[at], [], 0
        at += 1
        if at < len(tokens) and tokens[at] == "<":
            while tokens[at] != ">":
                at += 1
                if tokens[at] != ">":
                    args.append(one())
            at += 1
        while at < len(tokens) and tokens[at] == "[]":
            dims, at = dims + 1, at + 1
        return wild, name, tuple(args), dims

    return one()


def written(t: tuple) -> str:
    wild, name, args, dims = t
    return f"{wild}{name}{'<' + ', '.join(map(written, args)) + '>' if args else ''}{'[]' * dims}"


def bound(t: tuple, bindings: dict[str, str]) -> tuple:
    """A variable without arguments gives way to what it is bound to, in whose arguments it is not bound again: a
    variable bound to a type over itself ends there."""
    wild, name, args, dims = t
    if name in bindings and not args:
        b = parsed(bindings[name])
        rest = {k: v for k, v in bindings.items() if k != name}
        return b[0], b[1], tuple(bound(a, rest) for a in b[2]), b[3] + dims
    return wild, name, tuple(bound(a, bindings) for a in args), dims


def substituted(types: Column, bindings: Column) -> Column:
    """A map of types with the variables of another map put in."""

    @F.pandas_udf("map<string,string>")
    def of(values: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([{k: written(bound(parsed(v), dict(b))) for k, v in dict(m).items()} for m, b in zip(values, by, strict=True)], dtype=object)

    return of(types, bindings)


def _core(links: DataFrame) -> DataFrame | None:
    """``child, parent``: what is left of the links once types without parents and types without children are taken off,
    again and again: all circles and the ways between them, or None.  A round costs what is left."""
    left = materialised(links)
    n = left.count()
    while n:
        rest = left.join(left.select(F.col("child").alias("parent")).distinct().hint("merge"), "parent", "left_semi")
        rest = rest.join(left.select(F.col("parent").alias("child")).distinct().hint("merge"), "child", "left_semi")
        left = materialised(rest.select("child", "parent"))
        was, n = n, left.count()
        if was == n:
            return left
    return None


def inherited_bindings(refs: DataFrame, params: DataFrame) -> DataFrame:
    """``child, ancestor, bindings``: what a type's ancestors' variables stand for, in the type's own terms.

    ``refs``: child, seq, parent, args (the types that the child's declaration puts in); ``params``: type, names.  The
    child's references are tried in order of seq: one to the ancestor itself answers, even with nothing; one to another
    type answers if that type binds something of the ancestor.  References to types without params row are passed over,
    and so are those that lie on a circle.

    Types are worked off from the roots down: in a wave are those whose parents are all known, so each pair is made once,
    by a join with its parents' pairs, and the waves are as many as the hierarchy is deep.
    """
    n = F.least(F.size("names"), F.size("args"))
    known = refs.join(params.select(F.col("type").alias("parent"), "names"), "parent")
    direct = F.map_from_arrays(F.slice("names", 1, n), F.slice("args", 1, n))
    edges = known.select("child", "seq", "parent", F.when(n > 0, direct).otherwise(F.create_map().cast("map<string,string>")).alias("direct"))
    edges = materialised(edges.where("child != parent"))
    core = _core(edges.select("child", "parent").distinct())
    if core is not None:
        back = closure(core.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).where("depth > 0").select(F.col("src").alias("parent"), F.col("dst").alias("child"))
        edges = materialised(edges.join(back, ["child", "parent"], "left_anti"))
    waiting = materialised(edges.select("child").distinct())
    found: list[DataFrame] = []
    while not waiting.isEmpty():
        blocked = edges.join(waiting.select(F.col("child").alias("parent")), "parent", "left_semi").select("child").distinct()
        ready = materialised(waiting.join(blocked, "child", "left_anti"))
        here = edges.join(ready, "child", "left_semi")
        empty = F.create_map().cast("map<string,string>")
        at_once = here.select("child", F.col("parent").alias("ancestor"), "seq", F.lit(0).alias("up"), F.col("direct").alias("inner"), empty.alias("by"))
        rows = [at_once]
        if found:
            above = reduce(DataFrame.unionByName, found).where(F.size("bindings") > 0).select(F.col("child").alias("parent"), "ancestor", "bindings")
            rows.append(here.join(above, "parent").select("child", "ancestor", "seq", F.lit(1).alias("up"), F.col("bindings").alias("inner"), F.col("direct").alias("by")))
        first = best_per_key(reduce(DataFrame.unionByName, rows), ["child", "ancestor"], F.struct("seq", "up"))
        found.append(materialised(first.select("child", "ancestor", F.when(F.col("up") == 0, F.col("inner")).otherwise(substituted(F.col("inner"), F.col("by"))).alias("bindings"))))
        waiting = materialised(waiting.join(ready, "child", "left_anti"))
    if not found:
        return edges.select("child", F.col("parent").alias("ancestor"), F.col("direct").alias("bindings"))
    return reduce(DataFrame.unionByName, found)
