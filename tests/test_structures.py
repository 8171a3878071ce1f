"""Pre-order, inherited bindings, constants, batches and calls against plain walks."""

import random
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.operators.batches import greedy
from weftline.operators.constants import constant_refs, expanded
from weftline.operators.inheritance import inherited_bindings, parsed, written
from weftline.operators.preorder import list_ranks, preorder
from weftline.operators.receivers import call_targets, receiver_types, visible_fields

sys.setrecursionlimit(10_000)


def walked(edges, root):
    out, seen = [], set()
    kids = defaultdict(dict)
    for s, d, q in edges:
        kids[s][d] = min(q, kids[s].get(d, q))

    def go(n, parent):
        seen.add(n)
        out.append((root, n, parent, len(out) + 1))
        for _, d in sorted((q, d) for d, q in kids[n].items()):
            if d not in seen:
                go(d, n)

    go(root, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_preorder_equals_a_plain_walk(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 24), rnd.randint(0, 24), rnd.randint(0, 3)) for _ in range((20, 40, 70)[seed])] + [(100, 0, 1), (100, 1, 0), (101, 102, 0), (102, 101, 0), (103, 104, 0), (104, 103, 0)]
    roots = [100, 3, 101, 999]
    df = spark.createDataFrame(edges, "src long, dst long, seq int")
    got = sorted(map(tuple, preorder(df, spark.createDataFrame([(r,) for r in [*roots, 3, None]], "root long")).collect()), key=str)
    assert got == sorted((x for r in roots for x in walked(edges, r)), key=str)


def test_preorder_of_a_long_chain(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("seq"))
    got = preorder(chain, spark.createDataFrame([(0,)], "root long"))
    assert got.where("number = node + 1 AND (parent = node - 1 OR node = 0)").count() == n + 1 == got.count()


def test_lists_on_circles_are_left_out(spark):
    links = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, None, 1), (4, 5, 1), (5, 4, 1), (6, 4, 1)], "item long, next long, weight int")
    assert sorted(map(tuple, list_ranks(links).collect())) == [(1, 3, 3), (2, 2, 3), (3, 1, 3)]


def test_types_are_read_and_written():
    for t in ("A", "a.B<C, D<E[]>>[][]", "Map<?, ? extends T>", "? super X<Y>"):
        assert written(parsed(t)) == t


def plain_bindings(refs, params):
    direct = defaultdict(list)
    for c, q, p, a in refs:
        if p in params:
            direct[c].append((q, p, dict(zip(params[p], a))))
    reach = {}

    def above(t, seen):
        for _, p, _ in direct[t]:
            if p not in seen:
                seen.add(p)
                above(p, seen)
        return seen

    reach = {t: above(t, set()) for t in list(direct)}
    for c in list(direct):
        direct[c] = sorted((x for x in direct[c] if x[1] != c and c not in reach.get(x[1], ())), key=lambda x: x[0])

    def put(t, b):
        wild, name, args, dims = t
        if name in b and not args:
            w = parsed(b[name])
            rest = {k: v for k, v in b.items() if k != name}
            return w[0], w[1], tuple(put(x, rest) for x in w[2]), w[3] + dims
        return wild, name, tuple(put(x, b) for x in args), dims

    def find(c, anc):
        for _, p, d in direct[c]:
            if p == anc:
                return d
            inner = find(p, anc)
            if inner:
                return {k: written(put(parsed(v), d)) for k, v in inner.items()}
        return {}

    has = lambda c, anc: any(p == anc for _, p, _ in direct[c]) or any(find(p, anc) for _, p, _ in direct[c])
    return {(c, a): find(c, a) for c in list(direct) for a in params if has(c, a)}


@pytest.mark.parametrize("seed", range(2))
def test_bindings_equal_a_plain_recursion(spark, seed):
    rnd = random.Random(seed)
    names = [f"t{k}" for k in range(14)]
    params = {t: rnd.sample(["T", "U", "V"], rnd.randint(0, 3)) for t in names}
    types = ["T", "U", "List<T>", "Map<U, V[]>", "T[]", "int", "Set<List<V>>", "? extends T"]
    refs = []
    for k, t in enumerate(names):
        for q in range(rnd.randint(0, 3)):
            p = rnd.choice(names) if rnd.random() < 0.1 else names[rnd.randint(0, k)]  # a few circles
            refs.append((t, q, p if rnd.random() < 0.95 else "outside", [rnd.choice(types) for _ in range(rnd.randint(0, 3))]))
    got = inherited_bindings(spark.createDataFrame(refs, "child string, seq int, parent string, args array<string>"), spark.createDataFrame(list(params.items()), "type string, names array<string>"))
    assert {(r.child, r.ancestor): r.bindings for r in got.collect()} == plain_bindings(refs, params)


def test_bindings_of_no_references(spark):
    got = inherited_bindings(spark.createDataFrame([], "child string, seq int, parent string, args array<string>"), spark.createDataFrame([("a", ["T"])], "type string, names array<string>"))
    assert got.count() == 0


def test_constants_equal_a_plain_evaluation(spark):
    rnd = random.Random(1)
    parts = {}
    for k in range(60):
        parts[k] = [(None, rnd.randint(max(0, k - 4), k - 1)) if k and rnd.random() < 0.5 else (rnd.choice(["a", "b", "", "/"]), None) for _ in range(rnd.randint(1, 3))]
    parts |= {100: [("x", None), (None, 101)], 101: [(None, 100)], 102: [(None, None)], 103: [(None, 100), (None, 1)], 104: [(None, 0)]}
    for k in range(105, 125):
        parts[k] = [(None, k - 1)]

    def value(k, trail=()):
        if k in trail or k not in parts:
            return None
        out, depth = "", 0
        for lit, ref in parts[k]:
            many = len(parts[k]) > 1
            if lit is not None:
                x, d = lit, int(many)
            else:
                below = value(ref, (*trail, k))
                if below is None:
                    return None
                x, d = below[0], below[1] + 1 + many
            out, depth = out + x, max(depth, d)
        return (out, depth) if depth <= 12 else None

    rows = [(k, n, lit, ref) for k, p in parts.items() for n, (lit, ref) in enumerate(p)]
    got = {r.const: None if r.value is None else (r.value, r.depth) for r in expanded(spark.createDataFrame(rows, "const long, pos int, literal string, ref long")).collect()}
    assert got == {k: value(k) for k in parts} and sum(v is None for v in got.values()) > 5


def test_constant_names_by_stages(spark):
    refs = [(1, "A", "X"), (2, "A", "Y"), (3, "A", "Z"), (4, "A", "B.Z"), (5, "A", "no.Z"), (6, "A", "Q"), (7, "A", "W")]
    consts = [("a.x", "A", "X"), ("b.x", "B", "X"), ("b.y", "B", "Y"), ("c.y", "C", "Y"), ("b.z", "B", "Z"), ("c.w", "C", "W")]
    imports = [("A", 1, "C", "Y"), ("A", 2, "B", None), ("A", 3, "C", "V")]
    got = constant_refs(
        spark.createDataFrame(refs, "ref long, owner string, name string"), spark.createDataFrame(consts, "const string, owner string, name string"),
        spark.createDataFrame(imports, "owner string, seq int, from_type string, member string"), spark.createDataFrame([("A", "B", "B")], "owner string, name string, type string"),
    )
    assert {r.ref: r.const for r in got.collect()} == {1: "a.x", 2: "c.y", 3: "b.z", 4: "b.z", 5: None, 6: None, 7: None}


def test_greedy_batches_of_long_keys(spark):
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]), k, rnd.choice([0, 1, 5, 9, 40])) for k in range(800)]
    got = {(r.key, r.pos): r.batch for r in greedy(spark.createDataFrame(rows, "key string, pos int, tok long").repartition(6), "key", ["pos"], F.col("tok"), 30).collect()}
    want, state = {}, {}
    for key, pos, tok in sorted(rows, key=lambda r: r[1]):
        acc, batch = state.get(key, (0, 0))
        acc, batch = (tok, batch + 1) if batch == 0 or acc + tok > 30 else (acc + tok, batch)
        state[key] = acc, batch
        want[key, pos] = batch
    assert got == want


def test_receiver_chains(spark):
    e = spark.createDataFrame([("Sub", "Base")], "src string, dst string")
    up = graph.closure(e)
    fields = visible_fields(up, spark.createDataFrame([("Base", "repo", "Repo"), ("Sub", "odd", None), ("Base", "odd", "Repo")], "owner string, name string, target string"))
    fields = fields.unionByName(spark.createDataFrame([("Repo", "db", "Db")], "type string, name string, target string"))
    s = "call long, type string, method string, chain array<string>"
    calls = [
        (1, "Sub", "m", []), (2, "Sub", "m", ["this"]), (3, "Sub", "m", ["this", "repo", "db"]), (4, "Sub", "m", ["repo"]), (5, "Sub", "m", ["super", "x"]),
        (6, "Sub", "m", ["()"]), (7, "Sub", "m", ["p", "db"]), (8, "Sub", "m", ["odd"]), (9, "Sub", "m", ["Status", "ACTIVE"]), (10, "Sub", "m", ["Outer", "Inner", "X", "db"]),
        (11, "Sub", "m", ["unknown", "x"]), (12, "Sub", "n", ["p"]), (13, "Sub", "m", None), (14, "Sub", "m", ["repo", "none"]), (15, "Base", "m", ["super"]),
    ]
    scope = spark.createDataFrame([("m", "p", 1, "Db"), ("m", "p", 0, "Repo"), ("m", "Status", 9, None)], "method string, name string, rank int, target string").where("target IS NOT NULL")
    names = spark.createDataFrame([("Sub", "Status", "Status"), ("Sub", "Outer.Inner", "Repo"), ("Sub", "Outer.Inner.X", "Db"), ("Sub", "unknown", "Db")], "type string, name string, target string")
    constants = spark.createDataFrame([("Status", "ACTIVE"), ("Repo", "X")], "owner string, name string")
    supers = spark.createDataFrame([("Sub", 2, "Other"), ("Sub", 1, "Base")], "type string, seq int, super string")
    got = {r.call: r.receiver for r in receiver_types(spark.createDataFrame(calls, s), scope, fields, constants, names, supers).collect()}
    assert got == {1: "Sub", 2: "Sub", 3: "Db", 4: "Repo", 5: "Base", 6: None, 7: "Db", 8: None, 9: "Status", 10: "Db", 11: None, 12: None, 13: "Sub", 14: None, 15: None}


def test_call_targets(spark):
    up = graph.closure(spark.createDataFrame([("ImplA", "Api"), ("ImplB", "Api"), ("Low", "ImplA"), ("Bare", "Top"), ("Leaf", "Top")], "src string, dst string"))
    m = [
        ("Api", "run", "run(x)", 1, False, False, 0), ("ImplA", "run", "run(x)", 1, False, True, 0), ("ImplB", "run", "run(x...)", 1, True, True, 0), ("ImplB", "run", "run(x)", 1, False, False, 1),
        ("Leaf", "go", "go()", 0, False, True, 0), ("Util", "help", "help(a...)", 1, True, True, 0), ("More", "help", "help()", 0, False, True, 0),
    ]
    methods = spark.createDataFrame(m, "owner string, name string, signature string, params int, varargs boolean, has_body boolean, seq int")
    up = up.unionByName(spark.createDataFrame([("Util", "Util", 0), ("More", "More", 0)], "src string, dst string, depth int"))
    imports = spark.createDataFrame([("X", 1, "More", "other"), ("X", 2, "Util", None), ("X", 3, "More", "help")], "type string, seq int, owner string, member string")
    calls = [(1, "X", "Api", False, "run", 1), (2, "X", "Low", False, "run", 1), (3, "X", "Top", False, "go", 0), (4, "X", None, True, "help", 0), (5, "X", None, True, "run", 1), (6, "X", None, False, "run", 1), (7, "X", "Api", False, "run", 2), (8, "ImplB", None, True, "run", 3)]
    got = {(r.call, r.target, r.impl) for r in call_targets(spark.createDataFrame(calls, "call long, type string, receiver string, own boolean, name string, argc int"), up, methods, imports).collect()}
    assert got == {
        (1, "Api#run(x)", False), (1, "ImplA#run(x)", True), (1, "ImplB#run(x...)", True), (2, "ImplA#run(x)", False), (3, "Leaf#go()", True),
        (4, "Util#help(a...)", False), (7, "ImplB#run(x...)", True), (8, "ImplB#run(x...)", False),
    }
