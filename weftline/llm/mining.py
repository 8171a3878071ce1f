"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

With one more coordinate, the root of the greatest squared norm less its own, all rows have the same norm; a query has 0
there.  The squared distance of a query from a row is then a constant less twice their inner product, so a window of
scores is an annulus of distances, and the highest score the nearest row.

A tree fitted on a bounded sample deals all rows to leaves, and a leaf's rows in blocks by their hash; the bounds of a
leaf are those of all its rows.  A block holds a tree of its own, over which each query goes nearest first inside the
annulus, and stops once it has k rows nearer than all that is left.  A query looks into one block of its own leaf first;
what it finds there rules out leaves by their bounds, and goes with it to the other blocks.  A block's queries are dealt
in bounded chunks, so no task holds more than a block and a chunk.  Every row is indexed and results are exact: scores
are whole numbers, bounds have some slack.  Data without structure rule out little: then each query meets each block.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; of rows with
the same id one counts, the least by label and vector; shorter vectors are filled with zeros; an empty table gives no
rows; other columns are not read.  A score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import materialised

#: Below this squared norm, doubles hold all scores exactly.
EXACT = 2.0**52


def quantised(rows: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """Rows with a label and a vector of finite numbers; ``vec``: the floor of each component times ``scale``."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("label").isNotNull() & v.isNotNull()).where(finite)
    return kept.select("vec_id", "label", F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


@dataclass
class Tree:
    """Vantage points, and for each leaf the points on its path with the least and greatest distance of its rows."""

    points: np.ndarray  # vantage points, without their added coordinate
    path: np.ndarray  # [leaf, depth]: index of a point
    low: np.ndarray
    high: np.ndarray

    def bounds(self, q: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest distance that a leaf's rows may have from a query; ``span``: its constant."""
        if not len(self.points):
            return np.zeros(len(self.path)), np.full(len(self.path), np.inf)
        d = np.sqrt(np.maximum((span - 2 * (self.points @ q)).astype(float), 0))[self.path]
        return np.maximum(np.maximum(d - self.high, self.low - d).max(1), 0), (d + self.high).min(1)


def _norms(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1) if len(x) else np.zeros(0)


def _distances(x: np.ndarray, added: np.ndarray, k: int, top: float) -> np.ndarray:
    """Of rows from the k-th of them, in the space with the added coordinate."""
    return np.sqrt(np.maximum((2 * top - 2 * (x @ x[k] + added * added[k])).astype(float), 0))


def _split(x: np.ndarray, top: float, rows: int, deepest: int = 60) -> tuple[list[int], list]:
    """Vantage points (indexes), and for each leaf its rows and its path of (point, least, greatest distance).

    Halves are by rank, so equal rows are dealt to both sides.
    """
    added = np.sqrt(np.maximum((top - _norms(x)).astype(float), 0))
    points, leaves, todo = [], [], [(np.arange(len(x)), [])]
    while todo:
        at, path = todo.pop()
        if len(at) <= rows or len(path) >= deepest:
            leaves.append((at, path))
            continue
        far = _distances(x[at], added[at], 0, top)
        k = int(at[int(far.argmax())])  # a point at the edge
        d = np.sqrt(np.maximum((2 * top - 2 * (x[at] @ x[k] + added[at] * added[k])).astype(float), 0))
        order = d.argsort(kind="stable")
        half = len(at) // 2
        points.append(k)
        for part in (order[:half], order[half:]):
            todo.append((at[part], [*path, (len(points) - 1, float(d[part].min()), float(d[part].max()))]))
    return points, leaves


def grown(x: np.ndarray, top: float, rows: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree over ``x`` (its greatest squared norm at most ``top``) with leaves of up to ``rows`` rows, and those."""
    points, leaves = _split(x, top, rows)
    depth = max([1, *(len(p) for _, p in leaves)])
    path, low, high = (np.full((len(leaves), depth), fill, kind) for fill, kind in ((0, int), (0.0, float), (np.inf, float)))
    for n, (_, p) in enumerate(leaves):
        for j, (k, lo, hi) in enumerate(p):
            path[n, j], low[n, j], high[n, j] = k, lo, hi
    return Tree(x[points], path, low, high), [at for at, _ in leaves]


def nearest_first(tree: Tree, q: np.ndarray, span: float, inner: float, outer: float) -> Iterator[tuple[float, int]]:
    """Leaves that reach into the annulus, by their least distance."""
    least, most = tree.bounds(q, span)
    for n in np.argsort(least, kind="stable"):
        if least[n] > outer:
            return
        if most[n] >= inner:
            yield float(least[n]), int(n)


def _number(vectors, dims: int, top: float) -> np.ndarray:
    """A matrix of whole numbers, filled with zeros: as doubles where those are exact, else as Python's."""
    out = np.zeros((len(vectors), dims), np.float64 if top < EXACT else object)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v if top < EXACT else [int(x) for x in v]
    return out


class Block:
    """Some rows under a tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, top: float, rows: int):
        self.tree, leaves = grown(x, top, rows)
        self.leaves = [(ids[at], labels[at], x[at]) for at in leaves]
        self.top = top

    def best(self, q: np.ndarray, own: int, label, asks: list[tuple[int | None, int | None]], k: int, same: bool) -> list[list[tuple[int, int]]]:
        """For each window of scores (low, high; None: open) the first k rows as (score, id)."""
        span = float((q * q).sum() + self.top)
        slack = 1e-6 * (span**0.5 + 1)
        distance = lambda score: max(span - 2 * score, 0.0) ** 0.5
        scores: dict[int, np.ndarray] = {}
        out = []
        for low, high in asks:
            inner = 0.0 if high is None else distance(high) - slack
            outer = float("inf") if low is None else distance(low) + slack
            found: list[tuple[int, int]] = []
            for least, n in nearest_first(self.tree, q, span, inner, outer):
                if len(found) == k and least > distance(-found[-1][0]) + slack:
                    break  # all that is left is farther
                ids, labels, x = self.leaves[n]
                s = scores[n] if n in scores else scores.setdefault(n, x @ q)
                fits = ((labels == label) if same else (labels != label)) & (ids != own)
                floor = low if len(found) < k else -found[-1][0]
                fits &= (s >= floor) if floor is not None else True
                fits &= (s <= high) if high is not None else True
                if fits.any():
                    found = sorted([*found, *((-int(a), int(b)) for a, b in zip(s[fits], ids[fits], strict=True))])[:k]
            out.append([(-a, b) for a, b in found])
        return out


@dataclass
class Index:
    """All rows in blocks (``vec_id, label, vec, leaf, part``), the tree that dealt them and the parts of each leaf."""

    rows: DataFrame
    tree: Tree
    parts: list[int]
    top: float
    dims: int
    leaf_rows: int

    def leaf(self, vec: Column) -> Column:
        return _leaf_of(self.tree, self.top, self.dims)(vec)["leaf"]


def _leaf_of(tree: Tree, top: float, dims: int):
    """Each row's leaf, by the path whose radii it fits, and its distances along that path."""

    @F.pandas_udf("leaf int, d array<double>")
    def leaf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            x = _number(vectors, dims, top)
            if not len(x) or not len(tree.points):
                yield pd.DataFrame({"leaf": np.zeros(len(x), np.int32), "d": [[0.0]] * len(x)})
                continue
            added = lambda y: np.sqrt(np.maximum((top - _norms(y)).astype(float), 0))
            d = np.sqrt(np.maximum((2 * top - 2 * (x @ tree.points.T + np.outer(added(x), added(tree.points)))).astype(float), 0))
            at = d[:, tree.path]  # the leaf whose shells are the nearest on the whole: none but bounds depend on it
            off = np.maximum(np.maximum(at - tree.high, tree.low - at), 0).sum(2)
            n = off.argmin(1)
            yield pd.DataFrame({"leaf": n.astype(np.int32), "d": list(np.take_along_axis(d, tree.path[n], 1))})

    return leaf


def indexed(rows: DataFrame, *, sample_rows: int = 4096, most_leaves: int = 64, block_rows: int = 2048, leaf_rows: int = 128) -> Index:
    """The index of ``rows`` (vec_id, label, vec); its upper tree is fitted on the ``sample_rows`` rows of least hash."""
    vec = F.col("vec").cast("array<bigint>")
    one = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", vec.alias("vec"))).alias("r")).select("vec_id", "r.*")
    one = materialised(one.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    size = one.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("top"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dims")).first()
    sample = one.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec").collect()
    top = float(size.top) * (1 + 1e-9)
    x = _number([r.vec for r in sample], size.dims, top)
    leaves = 1
    while leaves < most_leaves and leaves * block_rows < size.n:
        leaves *= 2
    tree, _ = grown(x, top, -(-len(sample) // leaves) if sample else 1)
    dealt = materialised(one.select("vec_id", "label", "vec", _leaf_of(tree, top, size.dims)(F.col("vec")).alias("p")).select("vec_id", "label", "vec", "p.*"))
    depth = tree.path.shape[1]
    ends = [f(F.col("d")[j]).alias(f"{name}{j}") for j in range(depth) for name, f in (("low", F.min), ("high", F.max))]
    parts = [0] * len(tree.path)
    for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).collect():
        parts[r.leaf] = -(-r.n // block_rows)
        tree.low[r.leaf] = [r[f"low{j}"] for j in range(depth)]
        tree.high[r.leaf] = [r[f"high{j}"] for j in range(depth)]
    if not len(tree.points):
        tree.low[:], tree.high[:] = 0.0, np.inf
    n_parts = F.element_at(F.array(*(F.lit(max(1, p)) for p in parts)), F.col("leaf") + 1)
    part = F.pmod(F.xxhash64("vec_id"), n_parts).cast("int")
    return Index(dealt.select("vec_id", "label", "vec", "leaf", part.alias("part")), tree, parts, top, size.dims, leaf_rows)


ASKS = "array<struct<ask: bigint, low: bigint, high: bigint>>"


def _looked_up(index: Index, routed: DataFrame, k: int, same: bool, chunks: int) -> DataFrame:
    """``anchor_id, ask, vec_id, score``: the first k rows of each (query, block) of ``routed`` (with leaf, part)."""
    top, dims, leaf_rows = index.top, index.dims, index.leaf_rows
    routed = routed.withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).cast("int"))
    keys = ["leaf", "part", "chunk"]
    blocks = index.rows.join(routed.select(*keys).distinct(), ["leaf", "part"]).select("vec_id", "label", "vec", *(F.col(c).alias(f"b_{c}") for c in keys))
    id_type = index.rows.schema["vec_id"].dataType.simpleString()

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            block = Block(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _number(rows["vec"], dims, top), top, leaf_rows)
            for own, label, vec, asks in zip(queries["anchor_id"], queries["label"], _number(queries["vec"], dims, top), queries["asks"], strict=True):
                windows = [(a["low"], a["high"]) for a in asks]
                for a, found in zip(asks, block.best(vec, own, label, windows, k, same), strict=True):
                    out += [(own, a["ask"], i, s) for s, i in found]
        return pd.DataFrame(out, columns=["anchor_id", "ask", "vec_id", "score"])

    return blocks.groupBy(*(f"b_{c}" for c in keys)).cogroup(routed.groupBy(*keys)).applyInPandas(search, f"anchor_id {id_type}, ask bigint, vec_id {id_type}, score bigint")


def first_rows(index: Index, queries: DataFrame, k: int, *, same: bool, chunk: int = 4096) -> DataFrame:
    """``anchor_id, ask, vec_id, score, rank``: for each of a query's ``asks`` (windows of scores) its first k rows.

    ``queries``: anchor_id, label, vec, asks.  Rows of the ``same`` label or of another; higher scores first, then
    smaller ids; never the query itself.
    """
    tree, top, dims, parts = index.tree, index.top, index.dims, index.parts
    n_parts = F.element_at(F.array(*(F.lit(max(1, p)) for p in parts)), F.col("leaf") + 1)
    home = queries.withColumn("leaf", index.leaf(F.col("vec"))).withColumn("part", F.pmod(F.xxhash64("anchor_id"), n_parts).cast("int"))
    home = materialised(home)
    chunks = max(1, -(-home.count() // chunk))
    near = materialised(_looked_up(index, home, k, same, chunks))
    full = near.groupBy("anchor_id", "ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    full = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("ask", "floor"))).alias("floors"))
    raised = home.join(full, "anchor_id", "left").withColumn(
        "asks",
        F.transform("asks", lambda a: F.struct(a["ask"].alias("ask"), F.greatest(a["low"], F.coalesce(F.col("floors")[a["ask"]], a["low"])).alias("low"), a["high"].alias("high"))),
    )

    @F.pandas_udf("array<int>")
    def reached(vectors: pd.Series, asks: pd.Series) -> pd.Series:
        out = []
        for q, windows in zip(_number(vectors, dims, top), asks, strict=True):
            span = float((q * q).sum() + top)
            slack = 1e-6 * (span**0.5 + 1)
            least, most = tree.bounds(q, span)
            reach = np.zeros(len(least), bool)
            for a in windows:
                inner = 0.0 if a["high"] is None else max(span - 2 * a["high"], 0.0) ** 0.5 - slack
                outer = np.inf if a["low"] is None else max(span - 2 * a["low"], 0.0) ** 0.5 + slack
                reach |= (least <= outer) & (most >= inner)
            out.append(np.flatnonzero(reach).astype(np.int32))
        return pd.Series(out, dtype=object)

    wide = raised.select("anchor_id", "label", "vec", "asks", F.col("leaf").alias("l0"), F.col("part").alias("p0"), F.explode(reached("vec", "asks")).alias("leaf"))
    every = F.element_at(F.array(*(F.lit(p) for p in parts)), F.col("leaf") + 1)
    wide = wide.where(every > 0).withColumn("part", F.explode(F.sequence(F.lit(0), every - 1))).where("leaf != l0 OR part != p0").drop("l0", "p0")
    found = near.unionByName(_looked_up(index, wide, k, same, chunks))
    order = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, **options) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: vec_id, label, vec (whole numbers).  For each anchor and each of its first ``positives`` other rows of the
    same label, the first ``k`` rows of another label whose score is ``low`` to ``high`` percent of the positive's.
    """
    index = indexed(rows, **options)
    anchors = index.rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    open_ended = F.lit(None).cast("bigint")
    asked = anchors.withColumn("asks", F.array(F.struct(F.lit(0).cast("bigint").alias("ask"), open_ended.alias("low"), open_ended.alias("high"))))
    near = materialised(first_rows(index, asked, positives, same=True).select("anchor_id", F.col("rank").cast("bigint").alias("ask"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    rest = "pmod(positive_score, 100L)"  # taken apart, so that percentages of large scores do not overflow
    of = lambda percent, up: f"{percent} * ((positive_score - {rest}) div 100) + ({percent} * {rest} + {up}) div 100"
    windows = near.selectExpr("anchor_id", "ask", f"{of(low, 99)} AS low", f"{of(high, 0)} AS high").where("low <= high")
    windows = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("ask", "low", "high"))).alias("asks"))
    found = first_rows(index, anchors.join(windows, "anchor_id"), k, same=False)
    out = found.join(near, ["anchor_id", "ask"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
