"""Tables by name, and the lineage views over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows whose keys one task holds at once, on average, where rows are told apart.
ROWS_A_TASK = 500_000


def tasks(*dfs: DataFrame) -> int:
    """Among how many tasks the rows of these tables are dealt, so that a task's share does not grow with them."""
    return max(1, -(-sum(df.count() for df in dfs) // ROWS_A_TASK))


def distinct_rows(df: DataFrame, n: int) -> DataFrame:
    """Each row once.  Rows are dealt before they are told apart: a task holds the keys of its share, not of a whole split
    or of what little space compressed keys take in a shuffle."""
    return df.repartition(n, *df.columns).distinct()


def node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, kind``: the foreign keys as a property graph, each edge once."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    line = t("lineitem")
    n = tasks(line)
    parts = [
        t("orders").select(node("order", c("o_orderkey")).alias("src"), node("customer", c("o_custkey")).alias("dst"), F.lit("placed_by").alias("kind")),
        distinct_rows(line.select("l_orderkey", "l_partkey"), n).select(node("order", c("l_orderkey")).alias("src"), node("part", c("l_partkey")).alias("dst"), F.lit("contains_part").alias("kind")),
        distinct_rows(line.select("l_partkey", "l_suppkey"), n).select(node("part", c("l_partkey")).alias("src"), node("supplier", c("l_suppkey")).alias("dst"), F.lit("supplied_by").alias("kind")),
        t("customer").select(node("customer", c("c_custkey")).alias("src"), node("nation", c("c_nationkey")).alias("dst"), F.lit("in_nation").alias("kind")),
        t("supplier").select(node("supplier", c("s_suppkey")).alias("src"), node("nation", c("s_nationkey")).alias("dst"), F.lit("in_nation").alias("kind")),
        t("nation").select(node("nation", c("n_nationkey")).alias("src"), node("region", c("n_regionkey")).alias("dst"), F.lit("in_region").alias("kind")),
    ]
    return reduce(DataFrame.unionByName, parts)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qname, kind, name, parent``: one row for each entity."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    row = lambda kind, key, name, parent: [node(kind, c(key)).alias("qname"), F.lit(kind).alias("kind"), name.alias("name"), parent.alias("parent")]
    none = F.lit(None).cast("string")
    return reduce(
        DataFrame.unionByName,
        [
            t("region").select(row("region", "r_regionkey", c("r_name"), none)),
            t("nation").select(row("nation", "n_nationkey", c("n_name"), node("region", c("n_regionkey")))),
            t("customer").select(row("customer", "c_custkey", c("c_name"), node("nation", c("c_nationkey")))),
            t("supplier").select(row("supplier", "s_suppkey", c("s_name"), node("nation", c("s_nationkey")))),
            t("part").select(row("part", "p_partkey", c("p_name"), none)),
        ],
    )


#: The same views for DuckDB, to be put in front of a query.
EDGES_SQL = """edges AS (
 SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'placed_by' AS kind FROM orders
 UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains_part' FROM lineitem
 UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by' FROM lineitem
 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation' FROM supplier
 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'in_region' FROM nation)"""
SYMBOLS_SQL = """symbols AS (
 SELECT 'region:' || r_regionkey AS qname, 'region' AS kind, r_name AS name, NULL AS parent FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'region:' || n_regionkey FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'nation:' || c_nationkey FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'nation:' || s_nationkey FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, NULL FROM part)"""
