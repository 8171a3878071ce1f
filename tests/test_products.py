"""Pairs of rows with the same key: all of them, dealt out, and small where they are written."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import rules, tables


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_products_are_all_pairs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(tables, "LISTED", (3, 2))
    monkeypatch.setattr(tables, "BROADCAST", broadcast)
    # hot keys on either side, keys of one side only, null keys, null values and values that are there twice
    left = [(k, f"a{v}") for k, n in [(1, 50), (2, 1), (3, 4), (5, 7)] for v in range(n)] + [(2, None), (3, "a1"), (None, "a1")]
    right = [(k, v) for k, n in [(1, 40), (2, 9), (3, 1), (4, 2)] for v in range(n)] + [(2, None), (3, 0), (None, 1)]
    left, right = spark.createDataFrame(left, "k long, a string"), spark.createDataFrame(right, "k long, b long")
    got = tables.products(tables.materialised(left), tables.materialised(right), "k", "a", "b")
    want = left.join(right, "k").select("a", "b")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_pairs_without_common_keys(spark):
    left, right = spark.createDataFrame([(1, "x")], "k long, a string"), spark.createDataFrame([(2, "y")], "k long, b string")
    assert tables.products(left, right, "k", "a", "b").count() == 0


def test_rows_of_many_rules_stay_small_where_they_are_written(spark, tmp_path):
    df = spark.range(40).select("id", F.lit("part").alias("kind"), F.lit("large ring").alias("name"))
    asked = spark.range(25_000).select(F.concat(F.lit("part:"), (F.col("id") * 40).cast("string")).alias("rule"), F.lit("part").alias("kind"), F.lit("RING").alias("name"))
    rules.matched(df, asked, key="id", equal=["kind"], like=["name"]).write.parquet(f"{tmp_path}/x")
    got = spark.read.parquet(f"{tmp_path}/x")
    assert got.count() == got.distinct().count() == 1_000_000
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1_500_000


def test_rows_with_the_same_key_meet_a_rule_once_each(spark, monkeypatch):
    df = spark.createDataFrame([(1, "part", "ring"), (1, "part", "ring"), (None, "part", "bolt")], "id long, kind string, name string")
    asked = spark.createDataFrame([("r", "part", "RING"), ("b", None, "bolt")], "rule string, kind string, name string")
    for few in (100_000, 0):
        monkeypatch.setattr(rules, "FEW", few)
        got = rules.matched(df, asked, key="id", equal=["kind"], like=["name"])
        assert sorted(map(tuple, got.collect()), key=repr) == [("b", None), ("r", 1), ("r", 1)]
