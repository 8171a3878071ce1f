"""Samples, layers, snapshots, archives and rules against plain code."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.values import coerced, example
from weftline.operators.layers import deep_merged
from weftline.operators.resolution import first_answers
from weftline.operators.rules import matched
from weftline.operators.samples import samples
from weftline.operators.snapshots import Archive, Conflict, Snapshots
from weftline.operators.tables import listed
from weftline.sources.files import outermost


def test_samples_equal_a_plain_recursion(spark):
    rnd = random.Random(3)
    fields = {t: [(k, f"f{rnd.randint(0, 9)}\"é", rnd.choice(["1", '"x"', "true", None]), rnd.choice([None, None, "a", "b", "c", "d", "gone"]), rnd.random() < 0.3) for k in range(rnd.randint(1, 4))] for t in "abcd"}

    def made(t, depth, around):
        if t not in fields:
            return {}
        out = {}
        for _, name, sample, nested, many in fields[t]:
            v = json.loads(sample or "null") if nested is None else {} if depth >= 5 or nested in around else made(nested, depth + 1, around | {nested})
            out[name] = [v] if many else v
        return out

    rows = [(t, *f) for t, fs in fields.items() for f in fs]
    df = spark.createDataFrame(rows, "type string, seq int, name string, sample string, nested string, list boolean")
    got = {r.root: json.loads(r.json) for r in samples(spark.createDataFrame([(t,) for t in "abcde"], "root string"), df).collect()}
    assert got == {t: made(t, 0, set()) for t in "abcde"}


def test_members_stand_in_their_order(spark):
    df = spark.createDataFrame([("t", 2, "b", "1", None, False), ("t", 1, "z", None, "u", True), ("u", 1, "t", None, "t", False)], "type string, seq int, name string, sample string, nested string, list boolean")
    assert samples(spark.createDataFrame([("t",)], "root string"), df).first().json == '{"z":[{"t":{"z":[{}],"b":1}}],"b":1}'


def test_deep_merge_equals_a_plain_fold(spark):
    rnd = random.Random(9)

    def doc(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice([1, "x", None, [1, {"a": 2}], {}, True, "q\"é"])
        return {rnd.choice("abc"): doc(depth - 1) for _ in range(rnd.randint(0, 3))}

    def merge(base, over):
        out = dict(base)
        for k, v in over.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
        return out

    rows, want = [], {}
    for key in range(60):
        layers = [{rnd.choice("abc"): doc(3) for _ in range(rnd.randint(0, 3))} for _ in range(rnd.randint(1, 5))]
        rows += [(key, n, json.dumps(x)) for n, x in enumerate(layers)]
        want[key] = {}
        for x in layers:
            want[key] = merge(want[key], x)
    df = spark.createDataFrame([*rows, (0, 99, None)], "key long, layer int, doc string").select("key", "layer", F.parse_json("doc").alias("doc"))
    assert {r.key: json.loads(r.json) for r in deep_merged(df).collect()} == want


def test_versions_are_whole_or_not_there(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    assert s.newest() == 0
    with pytest.raises(LookupError):
        s.read()
    assert s.replace(spark.range(3)) == 1 and s.replace(spark.range(5), label="b") == 2
    spark.range(99).write.parquet(f"file://{tmp_path}/t/rows/halfway")  # a writer that died before its marker
    assert s.newest() == 2 and s.read().count() == 5 and s.read(1).count() == 3
    with pytest.raises(Conflict):
        s.replace(spark.range(7), after=1)  # the same step run twice
    assert s.read().count() == 5
    # two markers for one version: all readers take the same
    for token, n in (("b" * 32, 8), ("a" * 32, 9)):
        spark.range(n).write.parquet(f"file://{tmp_path}/t/rows/{token}")
        spark.range(1).selectExpr("3L AS version", f"'{token}' AS token", f"{n}L AS rows", "0.0D AS created_at", "'' AS label").coalesce(1).write.json(f"file://{tmp_path}/t/markers/{token}")
    assert s.read().count() == 9


def test_archive_tells_what_changed(spark, tmp_path):
    a = Archive(spark, f"file://{tmp_path}/a")
    docs = lambda rows: spark.createDataFrame(rows, "id string, digest string")
    assert a.entries().count() == 0
    a.add(docs([("x", "1"), ("y", "1")]), created_at=1.0, label="first")
    a.add(docs([("x", "2"), ("z", "1")]), created_at=2.0)
    got = [tuple(r) for r in a.entries().collect()]
    assert got == [(2, 2.0, "", 2, 1, 1, 1), (1, 1.0, "first", 2, 0, 0, 0)]
    assert sorted((r.id, r.version) for r in a.entries_of(docs([("x", ""), ("y", "")])).collect()) == [("x", 1), ("x", 2), ("y", 1)]


def test_rules_find_what_filters_find(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice(["t", "m", None]), rnd.choice(["Blue widget", "red WIDGET", "x", None, "bolt é"]), rnd.choice("pqr")) for k in range(200)]
    rules = [(k, rnd.choice(["t", "m", "none", None]), rnd.choice(["p", None]), rnd.choice(["widget", "BLUE", "id", "É", "zzz", None, ""])) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, kind string, name string, file string")
    got = {(r.rule, r.id) for r in matched(df, spark.createDataFrame(rules, "rule long, kind string, file string, name string"), key="id", equal=["kind", "file"], like=["name"]).collect()}
    fits = lambda want, has: want is None or want == has
    assert got == {(r, i) for r, kind, file, name in rules for i, k, n, f in rows if fits(kind, k) and fits(file, f) and (name is None or n is not None and name.lower() in n.lower())}


def test_examples_are_coerced_or_made_up(spark):
    cases = [
        ("true", "Boolean", None, "true"), ('"FALSE"', "Boolean", None, "false"), ("1", "Boolean", None, None), ("true", "Int", None, None), ('"1,000"', "Long", None, "1000"), ("1.0", "Int", None, None),
        ("2.0", "Double", None, "2"), ('"2.5"', "BigDecimal", None, "2.5"), ('"x"', "Double", None, None), ("12", "String", None, '"12"'), ("false", "String (Base64)", None, '"False"'), ("[1]", "String", None, None),
        ('{"a":1}', "Map<String, Int>", None, '{"a":1}'), ('"a"', "Map", None, None), ("[1]", "List<Int>", None, "[1]"), ("null", "Other", None, None), ('""', "String", None, None), ("5", "Other", None, "5"),
        ('"A"', "E", ["A", "B"], '"A"'), ('"C"', "E", ["A", "B"], None), (None, "Int", None, None), ('"q\\"é"', "String", None, '"q\\"é"'),
    ]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(cases)], "k int, v string, t string, names array<string>, want string")
    got = {r.k: r.got for r in df.select("k", coerced(F.col("v"), F.col("t"), F.col("names")).alias("got")).collect()}
    assert got == {k: x[3] for k, x in enumerate(cases)}
    made = [("totalAmount", "Long", "100000"), ("pageSize", "Int", "1"), ("rate", "Double", "19"), ("ok", "Boolean", "true"), ("birthDate", "String", '"1400/11/11 - 06:11:16"'), ("transactionId", "String", '"T-1"'), ("userId", "String", '"12081651201"'), ("x", "File", '"<binary>"'), ("x", "Odd", '"string"')]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(made)], "k int, n string, t string, want string")
    none = F.lit(None)
    got = {r.k: r.got for r in df.select("k", example(F.col("n"), F.col("t"), none.cast("string"), none.cast("array<string>"), "T-1").alias("got")).collect()}
    assert got == {k: x[2] for k, x in enumerate(made)}
    first = df.limit(1).select(example(F.col("n"), F.lit("E"), none.cast("string"), F.array(F.lit("A"), F.lit("B")), "T-1")).first()[0]
    assert first == '"A"'


def test_lists_and_roots(spark):
    df = spark.createDataFrame([("a", k) for k in range(50, 0, -1)] + [("b", 1)], "k string, v int")
    assert {r.k: (r.n, r.first) for r in listed(df, ["k"], "v", ["v"], 3).collect()} == {"a": (50, [1, 2, 3]), "b": (1, [1])}
    assert outermost(["/a/b", "/a", "/ab", "/a/", "/c/d"]) == ["/a", "/ab", "/c/d"]
    rows = spark.createDataFrame([(1, "x", "y"), (2, "none", "y"), (3, None, "empty"), (1, "x", "y")], "id int, k1 string, k2 string")
    found = first_answers(rows, spark.createDataFrame([("x", "X"), ("y", "Y"), ("empty", "")], "key string, note string"), ["k1", "k2"], "note")
    assert sorted((r.id, r.note) for r in found.collect()) == [(1, "X"), (1, "X"), (2, "Y"), (3, None)]
