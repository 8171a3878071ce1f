"""Steps whose work must not grow with what is repeated: rows that a step writes or meets are counted."""

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality
from weftline.operators import graph, inheritance, preorder, receivers, rules
from weftline.plans import catalog
from weftline.sources import tables


@pytest.fixture
def seen(monkeypatch):
    """The rows of each table that passes a function of a module."""

    def watch(module, name, take=lambda *a: a[0]):
        sizes, was = [], getattr(module, name)

        def counting(*args, **kw):
            sizes.append(take(*args).count())
            return was(*args, **kw)

        monkeypatch.setattr(module, name, counting)
        return sizes

    return watch


def test_leaves_are_not_ranked(spark, seen):
    sizes = seen(preorder, "list_ranks")
    rows = [(0, 1, 1), (0, 2, 2), *((m, leaf, leaf) for m in (1, 2) for leaf in range(10, 60))]
    got = preorder.preorder(spark.createDataFrame(rows, "src long, dst long, seq long"), spark.createDataFrame([(0,)], "root long"))
    want = [(0, None), (1, 0), *((leaf, 1) for leaf in range(10, 60)), (2, 0)]
    assert [(r.node, r.parent) for r in got.orderBy("number").collect()] == want
    # two events for each of 51 heads and 2 inner nodes; the 100 leaves are in none
    assert sizes == [2 * 53]


def test_same_rules_are_matched_once(spark, seen):
    sizes = seen(rules, "spread_join", lambda many, one, key: one.select(F.explode("rules")))
    df = spark.createDataFrame([(k, "part", "large ring") for k in range(20)], "id long, kind string, name string")
    asked = spark.createDataFrame([(k, "part", "RING") for k in range(30)] + [(99, None, None), (99, None, None)], "rule long, kind string, name string")
    got = rules.matched(df, asked, key="id", equal=["kind"], like=["name"])
    assert got.count() == 20 * 32 and got.distinct().count() == 20 * 31
    assert sizes == [1]


def test_names_of_a_scope_are_met_once(spark, seen):
    sizes = seen(receivers, "best_per_key", lambda df, keys, order: df if keys == ["call"] else df.limit(0))
    calls = spark.createDataFrame([(k, "A", "m", ["p"]) for k in range(5)], "call long, type string, method string, chain array<string>")
    scope = spark.createDataFrame([("m", "p", 3_000_000_000 - r, f"T{r}") for r in range(40)], "method string, name string, rank long, target string")
    none = lambda schema: spark.createDataFrame([], schema)
    got = receivers.receiver_types(calls, scope, none("type string, name string, target string"), none("owner string, name string"), none("type string, name string, target string"), none("type string, seq int, super string"))
    assert {(r.call, r.receiver) for r in got.collect()} == {(k, "T39") for k in range(5)}
    assert max(sizes) == 5


def test_inherited_methods_are_not_broadcast(spark):
    asked = spark.createDataFrame([("A", "m", 0)], "type string, name string, argc int")
    up = spark.createDataFrame([("A", "A", 0), ("A", "B", 1)], "src string, dst string, depth int")
    methods = spark.createDataFrame([("B", "m", "m()", 0, False, True, 0)], "owner string, name string, signature string, params int, varargs boolean, has_body boolean, seq int")
    found = receivers.first_methods(asked, up, methods)
    assert [r.owner for r in found.collect()] == ["B"]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_keys_walk_together(spark, seen):
    sizes = seen(graph, "materialised")
    e = spark.createDataFrame([(f"r{k}", "hub") for k in range(130)] + [("hub", f"n{k}") for k in range(40)] + [("n1", "hub")], "src string, dst string")
    roots = spark.createDataFrame([(f"r{k}", f"r{k}") for k in range(130)], "root string, node string")
    got = graph.distance(roots, e, None, key=["root"], also={"size": F.length("node")})
    want = {(f"r{k}", n, d, len(n)) for k in range(130) for n, d in [(f"r{k}", 0), ("hub", 1), *((f"n{j}", 2) for j in range(40))]}
    assert sorted(map(tuple, got.select("root", "node", "depth", "size").collect())) == sorted(want)
    assert max(sizes[1:]) <= 171  # edges, or 40 nodes for 3 words of keys; not 130 * 40 rows


def test_budget_leaves_out_levels_before_it_sorts(spark):
    rows = [(r, f"n{d}-{k:03}", d) for r in ("a", None) for d in (0, 1, 2) for k in range(1 if d == 0 else 200)]
    got = graph.within_budget(spark.createDataFrame(rows, "root string, node string, depth int"), F.lit(100), key=["root"], budget=1000, least=100)
    want = [("n0-000", 1, 0), *((f"n1-{k:03}", k + 2, 100 * (k + 1)) for k in range(8))]
    for root in ("a", None):
        assert sorted((r.node, r.seq, r.spent) for r in got.where(F.col("root").eqNullSafe(root)).collect()) == want
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_closure_without_circles(spark, monkeypatch):
    def refused(edges):
        raise AssertionError("all pairs are made")

    monkeypatch.setattr(inheritance, "closure", refused)
    refs = spark.createDataFrame([("b", 1, "a", ["X"]), ("c", 1, "b", ["List<T>"])], "child string, seq int, parent string, args array<string>")
    got = inheritance.inherited_bindings(refs, spark.createDataFrame([("a", ["T"]), ("b", ["T"])], "type string, names array<string>"))
    assert {(r.child, r.ancestor): dict(r.bindings) for r in got.collect()} == {("b", "a"): {"T": "X"}, ("c", "b"): {"T": "List<T>"}, ("c", "a"): {"T": "X"}}


def test_all_good_documents_are_learnt_from(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality._good(labels, "doc_id", "quality", False).count() + quality._good(labels, "doc_id", "quality", True).count() == 60_000


def test_tasks_hold_bounded_shares_of_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 1_000, raising=False)
    for name in ("customer", "supplier", "nation", "region", "part", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    # each row twice, and rows without keys: each pair is an edge once, an edge without source counts
    line.union(line).unionByName(line.limit(1).withColumn("l_orderkey", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    e = tables.edges(spark, str(tmp_path)).where(F.col("kind") == "contains_part")
    shares = [r["count"] for r in e.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(shares) < 1_500 and sum(shares) == e.distinct().count()
    every = tables.edges(spark, str(tmp_path))
    want = (every.count(), 25, every.where("src IS NOT NULL").select("src").distinct().count())
    r = catalog.graph_stats(spark, str(tmp_path)).first()
    assert (r.edges, r.region_edges, r.sources) == want
