"""Greedy batches over long sequences, in several tasks a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.tables import materialised, numbered, spread_join


def greedy(rows: DataFrame, key: str, order: list[str], cost: Column, budget: int) -> DataFrame:
    """``rows`` with ``batch``, from 1 in each key: a new one where the next row would bring it above ``budget``.

    A fold over a key would walk its rows one by one.  Here each row asks where the batch would end if it began there: by
    the number of rows whose running cost (not below zero for any row) is within the budget, counted by one sort of rows
    and questions together.  The true beginnings are those that a key's first row leads to, found by doubling jumps in
    log2(batches) rounds; a last sort counts them.  Sorts and joins are by place, so a key that holds most rows is
    dealt to as many tasks as its size asks for.
    """
    at = materialised(numbered(rows.withColumn("__cost", cost.cast("long")), [key, *order], F.col("__cost")))
    spot = at.select("number", F.col(key).alias("k"), "running", (F.col("running") - F.col("__cost") + budget).alias("full"))
    asked = spot.select(F.col("running").alias("v"), F.lit(0).alias("asks"), "number", "k").unionByName(spot.select(F.col("full").alias("v"), F.lit(1).alias("asks"), "number", "k"))
    counted = numbered(asked.withColumnRenamed("number", "of"), ["v", "asks", "of"], 1 - F.col("asks"))
    ends = counted.where("asks = 1").select(F.col("of").alias("number"), "k", F.greatest(F.col("of") + 1, F.col("running") + 1).alias("next"))
    jumps = ends.join(spot.select(F.col("number").alias("next"), F.col("k").alias("of_key")), "next").where("k <=> of_key").select("number", "next")
    jumps = materialised(jumps)
    starts = materialised(spot.groupBy("k").agg(F.min("number").alias("number")).select("number"))
    parts = [starts]
    while True:
        found = starts.join(jumps, "number").select(F.col("next").alias("number"))
        found = materialised(found)
        if found.isEmpty():
            break
        parts.append(found)
        starts = starts.unionByName(found)
        jumps = materialised(jumps.join(jumps.select(F.col("number").alias("next"), F.col("next").alias("onward")), "next").select("number", F.col("onward").alias("next")))
    marked = at.drop("running", "__cost").withColumnRenamed("number", "place").join(starts.select(F.col("number").alias("place"), F.lit(1).alias("begins")), "place", "left")
    summed = materialised(numbered(marked, ["place"], F.coalesce("begins", F.lit(0))))
    first = summed.groupBy(key).agg((F.min("running") - 1).alias("before"))
    first = first.withColumnRenamed(key, "__key")
    out = spread_join(summed.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\0"))), first.withColumn("__key", F.coalesce(F.col("__key").cast("string"), F.lit("\0"))), "__key")
    return out.select(*rows.columns, (F.col("running") - F.col("before")).cast("int").alias("batch"))
