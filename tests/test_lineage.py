"""The lineage operators: every registered query with SQL against DuckDB, and small cases with known results."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, mismatch
from weftline.functions import text as T
from weftline.operators import graph
from weftline.operators.resolution import inherited_methods, merged_rows, resolve, two_smallest
from weftline.operators.tables import appended, best_per_key, cache_state, diff, numbered, upsert
from weftline.plans import registry as catalog
from weftline.sources.files import matches, source_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    assert mismatch(spark, db, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) is None


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    got = {(r.src, r.dst): r.depth for r in graph.closure(e).collect()}
    assert got["a", "c"] == 2 and got["d", "c"] == 3 and ("a", "d") not in got and len(got) == 13


def test_distance_grows_with_depth(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long")
    start = spark.createDataFrame([(0,), (3,)], "node long")
    assert [graph.distance(start, e, d).count() for d in (0, 1, 2, 3)] == [2, 4, 6, 7]


def test_diff_is_its_own_inverse(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, h string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k long, h string")
    there, back = ({r.k: r.status for r in diff(x, y, "k", "h").collect()} for x, y in ((a, b), (b, a)))
    assert there == {1: "removed", 2: "changed", 3: "unchanged", 4: "added"}
    assert back == {1: "added", 2: "changed", 3: "unchanged", 4: "removed"}
    assert sorted(map(tuple, upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, None), (4, "w")]


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)], "k string, seq int, v string")
    assert {r.k: r.v for r in best_per_key(df, ["k"], F.col("seq")).collect()} == {"a": "x", "b": None}
    assert {r.k: r.v for r in best_per_key(df, ["k"], F.col("seq"), last=True).collect()} == {"a": "y", "b": None}


def test_closure_of_a_long_chain_has_no_bound(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(70)], "src long, dst long")
    got = {(r.src, r.dst): r.depth for r in graph.closure(e).collect()}
    assert len(got) == 71 * 72 // 2 and all(d == b - a for (a, b), d in got.items())


def test_traversal_rules(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "x7"), ("x7", "y"), ("b", "c"), ("c", "a")], "src string, dst string")
    start = spark.createDataFrame([("r", "a")], "root string, node string")
    walked = graph.distance(start, e, None, key=["root"], through=~F.col("node").endswith("7"))
    assert {r.node: r.depth for r in walked.collect()} == {"a": 0, "b": 1, "c": 2}  # skipped nodes are not expanded
    uses = spark.createDataFrame([("b", "E1"), ("c", "E2")], "src string, dst string")
    assert {r.dst: r.depth for r in graph.collected(start, e, uses, 1, key=["root"]).collect()} == {"E1": 1}  # the last level is looked at
    kept = graph.within_budget(walked, F.lit(100), key=["root"], budget=300, least=200)
    assert [r.node for r in kept.orderBy("seq").collect()] == ["a"]


def test_resolution_ends_at_the_first_answer(spark):
    refs = spark.createDataFrame([("a",), ("b",), ("c",)], "ref string")
    one = spark.createDataFrame([("a", None)], "ref string, target string")
    two = spark.createDataFrame([("a", "guess"), ("b", "y"), ("b", "x")], "ref string, target string")
    assert {r.ref: (r.stage, r.target) for r in resolve(refs, [one, two]).collect()} == {"a": (1, None), "b": (2, "x"), "c": (None, None)}
    names = spark.createDataFrame([("n", k) for k in (5, 3, 9, 3)] + [("m", 1)], "name string, k long")
    assert {r.name: (r.first, r.second) for r in two_smallest(names, ["name"], "k").collect()} == {"n": (3, 5), "m": (1, None)}
    calls = spark.createDataFrame([("t", "f", 2), ("t", "g", None)], "type string, name string, argc int")
    up = spark.createDataFrame([("t", "t", 0), ("t", "u", 1)], "src string, dst string, depth int")
    methods = spark.createDataFrame([("t", "f", 1, False), ("u", "f", 3, True), ("u", "g", 4, False)], "owner string, name string, params int, varargs boolean")
    assert sorted((r.name, r.owner, r.params) for r in inherited_methods(calls, up, methods).collect()) == [("f", "u", 3), ("g", "u", 4)]
    rows = lambda *x: spark.createDataFrame(x, "code string, title string, seq long")
    merged = merged_rows([rows(("1", "", 0)), rows(("1", "late", 0), ("2", "b", 1))], "code", ["title"])
    assert {r.code: (r.title, r.source) for r in merged.collect()} == {"1": ("late", 0), "2": ("b", 1)}


def test_missing_roots_keep_files(spark):
    old = spark.createDataFrame([("/a/x", "1"), ("/ab/x", "1"), ("/c/x", "1")], "path string, h string")
    got = {r.path: r.status for r in diff(old, old.where("false"), "path", "h", missing_roots=["/a"]).collect()}
    assert got == {"/a/x": "kept", "/ab/x": "removed", "/c/x": "removed"}


def test_cache_log_and_numbering(spark):
    log = [("k", "put", 1), ("k", "touch", 2), ("k", "put", 3), ("k", "touch", 4), ("k", "touch", 5), ("l", "put", 1), ("l", "clear", 2), ("m", "clear", 1), ("m", "put", 2), ("n", "touch", 1)]
    state = cache_state(spark.createDataFrame(log, "key string, op string, at long"), "key", "op", "at")
    assert {r.key: (r.entry, r.hits, r.last_used) for r in state.collect()} == {"k": (3, 2, 5), "m": (2, 0, 2)}
    df = spark.createDataFrame([(x, x % 3) for x in (5, 3, 8, 1, 9, 2)], "x long, v long").repartition(3)
    assert [(r.x, r.number, r.running) for r in numbered(df, ["x"], F.col("v")).orderBy("x").collect()] == [(1, 1, 1), (2, 2, 3), (3, 3, 3), (5, 4, 5), (8, 5, 7), (9, 6, 7)]
    held = spark.createDataFrame([(4, 1)], "id long, x long")
    assert sorted(map(tuple, appended(held, df.select("x"), "id", ["x"]).collect()))[1:3] == [(5, 1), (6, 2)]
    old, new = spark.createDataFrame([("p", "h", 1)], "path string, h string, at int"), spark.createDataFrame([("p", "h", 2), ("q", "h", 2)], "path string, h string, at int")
    assert sorted(map(tuple, upsert(old, new, ["path"], digest="h").collect())) == [("p", "h", 1), ("q", "h", 2)]


def test_source_files(spark, tmp_path):
    for name, data in (("a/X.java", "\ufeffhé".encode()), ("a/b/Y.java", "سلام".encode("cp1256")), ("a/b/z.txt", b"no"), ("target/W.java", b"skipped")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = source_files(spark, [str(tmp_path)], include=["**/*.java"], exclude=["*/target/*"]).orderBy("path").collect()
    assert [(r.path.rsplit("/", 1)[1], r.source_text) for r in got] == [("X.java", "hé"), ("Y.java", "سلام")]
    assert got[0].sha256 == hashlib.sha256("\ufeffhé".encode()).hexdigest()
    names = spark.createDataFrame([("Main.java",), ("/a/Main.java",), ("a/b.txt",)], "p string")
    assert [r[0] for r in names.select(matches(F.col("p"), ["**/Main.java"])).collect()] == [True, True, False]


def test_calendar_both_ways_and_its_range(spark):
    days = spark.sql("SELECT explode(sequence(DATE '1800-01-01', DATE '2250-01-01', INTERVAL 1 DAY)) AS day").withColumn("j", T.jalali(F.col("day")))
    part = lambda k: F.element_at(F.split("j", "-"), k).cast("int")
    assert days.where(T.gregorian(part(1), part(2), part(3)) != F.col("day")).isEmpty()
    assert days.select("j").distinct().count() == days.count()
    one = spark.range(1)
    assert one.select(T.gregorian(F.lit(1403), F.lit(12), F.lit(30))).first()[0] == datetime.date(2025, 3, 20)
    with pytest.raises(Exception, match="outside"):
        one.select(T.jalali(F.lit(datetime.date(3900, 1, 1)))).collect()
    with pytest.raises(Exception, match="outside"):
        one.select(T.gregorian(F.lit(3178), F.lit(1), F.lit(1))).collect()


def test_texts(spark):
    names = spark.createDataFrame([("myURLName",), ("my_field",)], "n string")
    by = lambda s: [r[0] for r in names.select(T.wire_name(F.col("n"), s)).collect()]
    assert by("UpperCamelCase") == ["MyURLName", "My_field"] and by("LowerCase") == ["myurlname", "my_field"] and by("SnakeCase") == ["my_urlname", "my_field"]
    assert by("nothing of the kind") == by(None) == ["myURLName", "my_field"]
    slugs = spark.createDataFrame([("Mein Projekt/ü_x",), ("..",), (None,)], "n string").select(T.project_slug(F.col("n")), T.slug(F.col("n"))).collect()
    assert [tuple(r) for r in slugs] == [("Mein-Projekt-ü-x", "mein-projekt-x"), ("project", "endpoint"), ("project", "endpoint")]
    replies = ['```json\n{"a": 1}\n```', 'Sure: {"a":[1,2,],"b":{"c":3,}} bye', "none", "{broken", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in replies], "t string").select(F.to_json(T.lenient_json(F.col("t")))).collect()]
    assert got == ['{"a":1}', '{"a":[1,2],"b":{"c":3}}', None, None, None]
    long = ["x" * 100, "a" * 300 + "\n" + "b" * 100, "س" * 300, "short", ""]
    cut = [r[0] for r in spark.createDataFrame([(x,) for x in long], "t string").select(T.truncated(F.col("t"), 100, "!")).collect()]
    assert cut == ["x" * 100, "a" * 300 + "!", "س" * 220 + "!", "short", ""]
    tokens = spark.createDataFrame([(x[:-1],) for x in cut[1:3]], "t string").select(T.estimated_tokens(F.col("t"))).collect()
    assert all(r[0] <= 100 for r in tokens)
    key = spark.range(1).select(T.cache_key(F.lit("3:x"), F.lit("type"), F.lit("h"), F.lit(None).cast("string"))).first()[0]
    assert key == hashlib.sha256(b"3:x|type|h|").hexdigest()


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        T.normalized_path(F.lit("//a//{id:[0-9]+}/b/")).alias("path"), T.slug(F.lit(" A  b! ")).alias("slug"), T.wire_name(F.lit("myFieldName"), "KebabCase").alias("kebab"),
        T.jalali(F.lit(datetime.date(2025, 1, 11))).alias("j1"), T.jalali(F.lit(datetime.date(2026, 3, 21))).alias("j2"), T.jalali(F.lit(datetime.date(2025, 3, 20))).alias("j3"),
        T.estimated_tokens(F.lit("")).alias("t0"), T.estimated_tokens(F.lit("سلام" * 11)).alias("t1"), T.glob(F.lit("GET /a/b/c"), "GET /a/*").alias("g"),
    ).first()
    assert tuple(got) == ("/a/{id}/b", "a-b", "my-field-name", "1403-10-22", "1405-01-01", "1403-12-30", 0, 21, True)
