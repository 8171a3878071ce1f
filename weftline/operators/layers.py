"""Layers of documents merged leaf by leaf: the last layer wins, lists are taken whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.samples import assembled
from weftline.operators.tables import materialised


def leaves(docs: DataFrame) -> DataFrame:
    """``key, layer, path, json`` of ``docs`` (key, layer, doc as a variant): the scalars, lists and empty objects of each
    document by the names that lead to them.  Each round opens one level of all documents at once."""
    at = docs.select("key", "layer", F.array().cast("array<string>").alias("path"), F.col("doc").alias("v"))
    found = []
    while True:
        at = materialised(at.select("key", "layer", "path", F.to_json("v").alias("json")))
        opens = F.col("json").startswith("{") & (F.col("json") != "{}")
        found.append(at.where(~opens).select("key", "layer", "path", "json"))
        inner = at.where(opens)
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        members = F.from_json("json", "map<string,variant>")
        at = inner.select("key", "layer", "path", F.explode(members).alias("name", "v")).select("key", "layer", F.array_append("path", F.col("name")).alias("path"), "v")


def merged_leaves(docs: DataFrame) -> DataFrame:
    """``key, path, json, layer``: the leaves of each key's layers merged in their order.

    A leaf is hidden by a later one at its own path, by a later scalar or list above it, and by a later object or leaf
    below it (an object takes the place of a scalar).  An empty object hides no members.  Leaves meet by path: each is
    joined with what its own names can meet, never with all of a key's.
    """
    rows = materialised(leaves(docs))
    value = rows.where("json != '{}'")
    # the last layer at which something stands at a path: a value, or an object because of what is below it
    own = value.groupBy("key", "path").agg(F.max("layer").alias("last"))
    above = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", 1, n))
    as_object = rows.where(F.size("path") > 0).select("key", "layer", F.explode(above).alias("path")).union(rows.where("json = '{}'").select("key", "layer", "path"))
    as_object = as_object.groupBy("key", "path").agg(F.max("layer").alias("opened"))
    prefixes = rows.withColumn("up", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))))
    hidden = prefixes.join(own.select("key", F.col("path").alias("up"), "last"), ["key", "up"]).where("last > layer").select("key", "layer", "path").distinct()
    seen = rows.join(hidden, ["key", "layer", "path"], "left_anti").join(as_object, ["key", "path"], "left")
    # a value gives way to a later object, an empty object to any member that is left
    seen = materialised(seen.where("json = '{}' OR opened IS NULL OR opened <= layer").select("key", "path", "json", "layer"))
    last = seen.groupBy("key", "path").agg(F.max_by("json", "layer").alias("json"), F.max("layer").alias("layer"))
    filled = seen.where(F.size("path") > 0).select("key", F.explode(above).alias("path")).distinct()
    return last.where("json != '{}'").unionByName(last.where("json = '{}'").join(filled, ["key", "path"], "left_anti")).select("key", "path", "json", "layer")


def deep_merged(docs: DataFrame) -> DataFrame:
    """``key, json``: each key's layers as one document, its members by name."""
    step = lambda name: F.struct(F.lit(0).alias("seq"), name.alias("name"), F.lit(False).alias("list"))
    return assembled(merged_leaves(docs).select("key", F.transform("path", step).alias("path"), "json"), ["key"])
