"""Names resolved by stages in order of priority, and members found through ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.tables import best_per_key, materialised


def resolve(refs: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """``ref, stage, target``: each reference's target by the first stage that answers, else stage and target null.

    A stage has ``ref, target``.  A row with a null target is an answer too (found, and known to be outside): it ends the
    search, so later stages do not guess.  Of several targets in one stage the smallest is taken.
    """
    rows = [s.select("ref", F.lit(k).alias("stage"), "target") for k, s in enumerate(stages, 1)]
    order = F.struct("stage", F.col("target").isNull(), "target")
    found = best_per_key(reduce(DataFrame.unionByName, rows), ["ref"], order)
    return refs.select("ref").distinct().join(found, "ref", "left")


def two_smallest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys..., first, second``: the two smallest distinct values of each key, by two partial aggregates.

    A join of a table with itself on a key would make all pairs of the key's rows.
    """
    first = df.groupBy(*keys).agg(F.min(value).alias("first"))
    rest = df.join(first, keys).where(F.col(value) > F.col("first")).groupBy(*keys).agg(F.min(value).alias("second"))
    return first.join(rest, keys, "left")


def only_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys..., target``: the value of keys that have just one."""
    return df.groupBy(*keys).agg(F.min(value).alias("target"), F.max(value).alias("__last")).where("target = __last").drop("__last")


def inherited_methods(calls: DataFrame, ancestors: DataFrame, methods: DataFrame) -> DataFrame:
    """``type, name, argc, owner, depth``: the methods that calls may mean, on the type or an ancestor.

    ``calls``: type, name, argc (null: any).  ``ancestors``: src, dst, depth.  ``methods``: owner, name, params, varargs.
    A method fits with as many parameters, or with varargs and at least all but one of them.
    """
    up = ancestors.select(F.col("src").alias("type"), F.col("dst").alias("owner"), "depth")
    n, argc = F.col("params"), F.col("argc")
    fits: Column = argc.isNull() | (n == argc) | (F.col("varargs") & (argc >= n - 1))
    return calls.join(up, "type").join(methods, ["owner", "name"]).where(fits).select("type", "name", "argc", "owner", "depth", "params")


def chain(ancestors: DataFrame) -> DataFrame:
    """``src, chain``: a node's ancestors from itself outwards, in order of depth."""
    packed = ancestors.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("depth", "dst"))).alias("x"))
    return packed.select("src", F.col("x.dst").alias("chain"))


def merged_rows(groups: list[DataFrame], key: str, texts: list[str]) -> DataFrame:
    """``key, texts..., source, seq``: rows of groups in order of priority as one row for each key.

    The row's place is that of its first group; each text is the first that is not empty.
    """
    union = reduce(DataFrame.unionByName, [g.withColumn("source", F.lit(k)) for k, g in enumerate(groups)])
    order = F.struct("source", "seq")
    first = [F.coalesce(F.min_by(F.when(F.col(t) != "", F.col(t)), F.when(F.col(t) != "", order)), F.lit("")).alias(t) for t in texts]
    return union.groupBy(key).agg(*first, F.min(order).alias("__at")).select(key, *texts, "__at.source", "__at.seq")


def first_answers(rows: DataFrame, answers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value``: what ``answers`` (key, value) has for the first of the row's ``keys`` that it answers.

    An empty text is no answer.  The keys of a row are looked up together, in one join.
    """
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    numbered = materialised(numbered)
    asked = numbered.select("__row", F.posexplode(F.array(*(F.col(k).cast("string") for k in keys))).alias("__at", "__key")).where("__key IS NOT NULL")
    known = answers.select(F.col("key").alias("__key"), F.col(value)).where(f"{value} IS NOT NULL AND {value} != ''")
    found = best_per_key(asked.join(known, "__key").select("__row", "__at", value), ["__row"], F.struct("__at", value)).select("__row", value)
    return numbered.join(found, "__row", "left").drop("__row")
