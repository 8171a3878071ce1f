"""Calls share what they may run below a type: right on any graph, and not written once for each call or signature."""

import random

import pytest

from weftline.operators import graph, receivers

SCHEMA = "call long, type string, receiver string, own boolean, name string, argc int"
METHODS = "owner string, name string, signature string, params int, varargs boolean, has_body boolean, seq int"


def plain(calls, up, methods, imports):
    """Straight from the definition, call by call."""
    above, below = {}, {}
    for src, dst, depth in up:
        above.setdefault(src, []).append((depth, dst))
        if depth:
            below.setdefault(dst, []).append(src)

    def own(owner, name, argc):
        fit = [(m[6], m[2], m[5]) for m in methods if m[:2] == (owner, name) and (m[3] == argc or m[4] and argc >= m[3] - 1)]
        return min(fit)[1:] if fit else None

    def first(t, name, argc):
        return next(((o, *x) for _, o in sorted(above.get(t, [])) if (x := own(o, name, argc))), None)

    out = set()
    for call, t, receiver, self, name, argc in calls:
        at = t if self else receiver
        x = first(at, name, argc)
        if x:
            out.add((call, f"{x[0]}#{x[1]}", False))
            if not x[2]:
                out |= {(call, f"{u}#{y[0]}", True) for u in below.get(x[0], []) if (y := own(u, name, argc)) and y[1]}
        elif self:
            y = next((y for k, _, o, member in sorted(imports, key=lambda i: i[1]) if k == at and member in (None, name) and (y := first(o, name, argc))), None)
            out |= {(call, f"{y[0]}#{y[1]}", False)} if y else set()
        else:
            out |= {(call, f"{y[0]}#{y[1]}", True) for u in below.get(at, []) if (y := first(u, name, argc))}
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_targets_on_any_graph(spark, most):
    """Trees, and graphs with several supertypes and circles, where a type inherits from what is not below the receiver."""
    r = random.Random(most)
    edges = [(f"t{k}", f"t{r.randrange(k if most == 1 else 14)}") for k in range(1, 14) for _ in range(r.randint(1, most))]
    e = graph.closure(spark.createDataFrame(edges, "src string, dst string"))
    methods = [(f"t{r.randrange(14)}", r.choice("fg"), f"s{k}", r.randrange(3), r.random() < 0.3, r.random() < 0.5, k) for k in range(12)]
    imports = [(f"t{k}", s, f"t{r.randrange(14)}", r.choice([None, "f"])) for k in range(14) for s in (1, 2)]
    calls = [(k, f"t{r.randrange(14)}", r.choice([None, *(f"t{j}" for j in range(14))]), r.random() < 0.3, r.choice("fg"), r.randrange(4)) for k in range(150)]
    got = receivers.call_targets(spark.createDataFrame(calls, SCHEMA), e, spark.createDataFrame(methods, METHODS), spark.createDataFrame(imports, "type string, seq int, owner string, member string"))
    got = [tuple(x) for x in got.select("call", "target", "impl").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(calls, [tuple(x) for x in e.collect()], methods, imports)


def test_types_that_inherit_share_one_set(spark, monkeypatch):
    """Of 40 types with own calls each inherits a method without a body, which 30 types below have bodies for: 30 targets
    are kept, not 40 times 30."""
    written, was = [], receivers.materialised

    def counting(df):
        out = was(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(receivers, "materialised", counting)
    e = graph.closure(spark.createDataFrame([(f"u{k}", "top") for k in range(40)] + [(f"b{k}", "top") for k in range(30)], "src string, dst string"))
    methods = [("top", "f", "f()", 0, False, False, 0)] + [(f"b{k}", "f", "f()", 0, False, True, 0) for k in range(30)]
    monkeypatch.setattr(receivers, "spread_join", lambda many, one, key: written.append(sum(len(x.targets) if "targets" in one.columns else 1 for x in one.collect())) or many.join(one, key))
    calls = spark.createDataFrame([(k, f"u{k}", None, True, "f", 0) for k in range(40)], SCHEMA)
    got = receivers.call_targets(calls, e, spark.createDataFrame(methods, METHODS), spark.createDataFrame([], "type string, seq int, owner string, member string"))
    assert got.count() == got.distinct().count() == 40 * 31
    assert max(written) <= 80
