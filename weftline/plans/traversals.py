"""Queries that walk the graph, each with its own edges, depth and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans.registry import query
from weftline.sources.tables import EDGES_SQL, edges, node, table

c = F.col
CALLS = ("placed_by", "in_nation", "supplied_by")


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 'customer:' || c_custkey AS root, 'customer:' || c_custkey AS node, 0 AS depth FROM customer
 UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 1 AND e.kind IN {CALLS})
 SELECT root, r_name AS code, min(depth)::INT AS depth FROM r JOIN edges e ON e.src = r.node AND e.kind = 'in_region' JOIN region ON e.dst = 'region:' || r_regionkey GROUP BY ALL""")
def error_reach(spark, d):
    """Codes (regions) that each customer may meet: gathered at every node within one call, the last level's included."""
    e = edges(spark, d)
    start = table(spark, d, "customer").select(node("customer", c("c_custkey")).alias("root"), node("customer", c("c_custkey")).alias("node"))
    catalog = table(spark, d, "region").select(node("region", c("r_regionkey")).alias("dst"), c("r_name").alias("code"))
    found = graph.collected(start, e.where(c("kind").isin(*CALLS)), e.where("kind = 'in_region'"), 1, key=["root"])
    return found.join(catalog, "dst").select("root", "code", "depth")


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 'part:' || p_partkey AS root, 'part:' || p_partkey AS node, 0 AS depth FROM part
 UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 4 AND e.kind IN {CALLS})
 SELECT root, node, depth::INT AS depth, (row_number() OVER (PARTITION BY root ORDER BY depth, node))::INT AS seq FROM (SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL)""")
def rule_reach(spark, d):
    """What each part calls, to depth 4, in the order of a walk level by level."""
    start = table(spark, d, "part").select(node("part", c("p_partkey")).alias("root"), node("part", c("p_partkey")).alias("node"))
    near = graph.distance(start, edges(spark, d).where(c("kind").isin(*CALLS)), 4, key=["root"])
    return near.select("root", "node", "depth", F.row_number().over(Window.partitionBy("root").orderBy("depth", "node")).alias("seq"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 'nation:' || n_nationkey AS root, 'nation:' || n_nationkey AS node, 0 AS depth FROM nation
 UNION SELECT r.root, e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node WHERE r.depth < 2 AND e.src NOT LIKE '%7' AND e.src NOT LIKE 'region:%'),
 m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0),
 s AS (SELECT root, node, depth, coalesce(sum(10 * length(node)) OVER (PARTITION BY root ORDER BY depth, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
 row_number() OVER (PARTITION BY root ORDER BY depth, node) AS seq FROM m)
 SELECT root, node, depth::INT AS depth, seq::INT AS seq, spent::BIGINT AS spent FROM s WHERE 6000 - spent > 200""")
def slice_callees(spark, d):
    """What hangs on each nation, level by level, while more than 200 of 6000 tokens remain; entities that end in 7 are
    skipped, and nothing behind them is walked."""
    start = table(spark, d, "nation").select(node("nation", c("n_nationkey")).alias("root"), node("nation", c("n_nationkey")).alias("node"))
    near = graph.distance(start, graph.reversed_edges(edges(spark, d)), 2, key=["root"], through=~c("node").endswith("7")).where("depth > 0")
    return graph.within_budget(near, 10 * F.length("node"), key=["root"], budget=6000, least=200).select("root", "node", "depth", "seq", "spent")


@query(f"""WITH {EDGES_SQL} SELECT src AS node, 'out' AS direction, dst AS other, kind FROM edges UNION ALL SELECT dst, 'in', src, kind FROM edges""")
def adjacency(spark, d):
    """The edges of every node, out and in."""
    e = edges(spark, d)
    return e.select(c("src").alias("node"), F.lit("out").alias("direction"), c("dst").alias("other"), "kind").union(e.select("dst", F.lit("in"), "src", "kind"))


@query(f"""WITH {EDGES_SQL}, h AS (SELECT src, dst FROM edges WHERE kind IN ('in_nation', 'in_region'))
 SELECT a.src, b.dst FROM h a JOIN h b ON b.src = a.dst""")
def two_hops(spark, d):
    """Adjacency joined with itself: from customers and suppliers to regions."""
    h = edges(spark, d).where(c("kind").isin("in_nation", "in_region")).select("src", "dst")
    return h.select("src", c("dst").alias("via")).join(h.select(c("src").alias("via"), "dst"), "via").select("src", "dst")
