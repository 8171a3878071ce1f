"""Names of types, edges and fields against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.operators.declarations import PRIMITIVES, all_fields, first_edges, resolve_types, type_edges


def plain(name, owner, extra, types, imports, supers, builtins):
    chain, t = [], owner
    while t:
        chain.append(t)
        t = types[t]["outer"]
    tvars = {p for t in chain for p in types[t]["params"]} | set(extra or ())
    pkg, file = types[owner]["package"], types[owner]["file"]
    by_name = lambda n: sorted(q for q in types if types[q]["name"] == n)

    def simple(n):
        if n in tvars:
            return "typevar", None
        for enc in chain:
            for q in (f"{enc}.{n}", *(f"{s}.{n}" for _, s in sorted(x for x in supers.get(enc, [])))):
                if q in types:
                    return "project", q
            if types[enc]["name"] == n:
                return "project", enc
        mine = sorted((x for x in imports if x[0] == file and not x[3]), key=lambda x: x[1])
        for _, _, i, _, wild in mine:
            if not wild and i.rsplit(".", 1)[-1] == n:
                return ("project", i) if i in types else ("builtin" if n in builtins else "external", None)
        q = f"{pkg}.{n}" if pkg else n
        if q in types:
            return "project", q
        for _, _, i, _, wild in mine:
            if wild and f"{i}.{n}" in types:
                return "project", f"{i}.{n}"
        if n in builtins:
            return "builtin", None
        found = by_name(n)
        for some in (found, [q for q in found if q.rsplit(".", 1)[0] == pkg], [q for q in found if q.startswith((pkg.split(".")[0] if pkg else "") + ".")]):
            if len(some) == 1:
                return "guessed", some[0]
        return "external", None

    if not name or name == "?" or name in PRIMITIVES:
        return "builtin", None
    if name in tvars:
        return "typevar", None
    if name in types:
        return "project", name
    if "." not in name:
        return simple(name)
    head, rest = name.split(".", 1)
    kind, q = simple(head)
    if kind in ("project", "guessed"):
        return ("project", f"{q}.{rest}") if f"{q}.{rest}" in types else ("external", None)
    found = [q for q in by_name(name.rsplit(".", 1)[-1]) if q.endswith("." + name)]
    return ("project", found[0]) if found else ("external", None)


@pytest.mark.parametrize("seed", range(2))
def test_names_equal_a_plain_search(spark, seed):
    rnd = random.Random(seed)
    types = {}
    for _ in range(30):
        pkg = rnd.choice(["a", "a.x", "b", ""])
        n = f"T{rnd.randint(0, 9)}"
        q = f"{pkg}.{n}" if pkg else n
        types[q] = dict(name=n, package=pkg, outer=None, file=q, params=rnd.choice([[], ["K"]]))
        for _ in range(rnd.randint(0, 2)):
            m = f"N{rnd.randint(0, 3)}"
            types[f"{q}.{m}"] = dict(name=m, package=pkg, outer=q, file=q, params=rnd.choice([[], ["V"]]))
    types["far.away.Solo"] = dict(name="Solo", package="far.away", outer=None, file="far", params=[])
    names = list(types)
    imports = [(rnd.choice(names), k, rnd.choice([*names, "out.T1", "out.String", "a", "b", "a.x", rnd.choice(names)]), rnd.random() < 0.1, False) for k in range(60)]
    imports = [(f, k, i, s, i in ("a", "b", "a.x") or rnd.random() < 0.2) for k, (f, _, i, s, _) in enumerate(imports)]
    supers = {t: [(k, rnd.choice(names)) for k in range(rnd.randint(0, 2))] for t in names}
    words = ["T1", "T2", "T3", "N1", "N2", "K", "V", "M", "String", "int", "?", "", "T4.N1", "x.T5", "a.T1", "a.x.T2.N0", "no.Such", "T7", "T8", "K.N1", "String.N2", "N0", "Solo"]
    refs = [(k, rnd.choice(names), rnd.choice(words), rnd.choice([None, ["M"], []])) for k in range(400)]
    got = resolve_types(
        spark.createDataFrame(refs, "ref long, owner string, name string, params array<string>"),
        spark.createDataFrame([(q, t["name"], t["package"], t["outer"], t["file"], t["params"]) for q, t in types.items()], "qname string, name string, package string, outer string, file string, params array<string>"),
        spark.createDataFrame(imports, "file string, seq int, name string, static boolean, wildcard boolean"),
        spark.createDataFrame([(t, k, s) for t, x in supers.items() for k, s in x], "type string, seq int, super string"),
        spark.createDataFrame([("String",)], "simple string"),
    ).collect()
    assert len(got) == len(refs)
    want = {r: plain(n, o, e, types, imports, supers, {"String"}) for r, o, n, e in refs}
    assert {r.ref: (r.kind, r.target) for r in got} == want
    assert {k for k, _ in want.values()} == {"builtin", "typevar", "project", "guessed", "external"}


def test_edges_of_references_and_the_first_of_each(spark):
    uses = spark.createDataFrame([(1, "m", "returns", 5, "a.Out"), (2, "m", "returns", 2, "Out"), (3, "m", "returns", 3, "T"), (4, "m", "returns", 1, "T"), (5, "m", "returns", 0, "int")], "ref long, src string, kind string, seq int, name string")
    means = spark.createDataFrame([(1, "external", None), (2, "external", None), (3, "project", "p.T"), (4, "guessed", "p.T"), (5, "builtin", None)], "ref long, kind string, target string")
    got = sorted(map(tuple, first_edges(type_edges(uses, means)).collect()))
    assert got == [("m", "ext:Out", "returns", 2, None), ("m", "p.T", "returns", 1, True)]


def test_base_fields_stand_first(spark):
    up = graph.closure(spark.createDataFrame([("C", "B"), ("B", "A"), ("C", "I")], "src string, dst string"))
    fields = spark.createDataFrame([("A", 0, "id", False), ("A", 1, "name", False), ("B", 0, "name", False), ("C", 0, "x", False), ("C", 1, "S", True), ("I", 0, "y", False)], "owner string, pos int, name string, static boolean")
    kinds = spark.createDataFrame([("A", "class"), ("B", "class"), ("C", "class"), ("I", "interface")], "qname string, kind string")
    got = sorted((r.number, r.name, r.owner) for r in all_fields(up, fields, kinds).where(F.col("type") == "C").collect())
    assert got == [(1, "id", "A"), (2, "name", "B"), (3, "x", "C")]
