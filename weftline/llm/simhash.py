"""SimHash near-duplicates: fingerprints, and links within a Hamming distance by a Gray-order hierarchical index.

1. Fingerprint: bit b is set if it is set in over half of the XXH64 values (seed 42) of the text's word shingles.
2. Distinct fingerprints are sorted by Gray rank and cut, at quantiles, into blocks of about ``capacity``.  A block's
   node has the bits that all below it share; the nodes (24 bytes for each block) are broadcast, and each block is
   routed to those blocks only from which its node differs in ``allowed`` bits or fewer.
3. A task searches one block in another.  There the index goes on: nodes of neighbours, each with the bits that it
   shares beyond its parent.  Groups of neighbouring queries go down from the top, add up the differences in each
   node's own bits and leave out a node, with all below it, once the sum passes what is allowed.  What is left is
   compared bit by bit.  A task returns a spanning forest of its links, not pairs.
4. Components by large-star and small-star rounds over these links, then joined back to the documents.

A key never makes all pairs of its group: copies are one fingerprint, and within a block the search is by node.
A ball of radius 4 has few fingerprints beside the number of documents that a group of near copies may hold, since
near copies differ in few bits.

``near_duplicates`` finds links within ``radius`` bits of one fingerprint; the search is exact.  ``similar`` finds texts
whose sets of shingles have a Jaccard similarity of ``permille`` or more: ``WORDS`` independent fingerprints each make
an index, in which the allowed differences grow with the number of bits compared (``LOOSE``), so that upper nodes prune
early; candidates are near in all fingerprints together.  Candidates are not returned as pairs: each task returns a
spanning forest of its own, their components (clusters) are dealt out again with the sets of hashed shingles, and the
tasks compare within a cluster and return spanning forests of what is alike.

Defined results: a null or wordless text has fingerprint zero and links like any other; repeated rows each get a row;
a null id stands in no minimum, and a component of null ids only has a null component id; ``similar`` keeps all columns
but ones named ``__row`` or ``__s``, which give way to its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialised, salted_join, small

#: A-Z lower case; the white space that ends words becomes blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Independent fingerprints of a text in ``similar``.
WORDS = 6
#: In ``similar``: differences allowed among d bits of nodes are 1.5 + d * LOOSE; at similarity 0.8 the mean is 0.152 d.
LOOSE = 0.15
#: In ``similar``: differences allowed in one whole fingerprint (0.998 of pairs at similarity 0.8), and in all of them
#: together, in 1/1000 of their bits (0.998 of pairs).
NARROW, WIDE = 18, 205
#: In ``similar``: a cluster has a part for each ``PART`` rows, up to ``PARTS``; a row meets each part of its cluster, so it
#: is sent ``PARTS`` times at most.  More parts only where one would hold more than ``MOST_ROWS`` rows or ``MOST_HASHES``.
PART, PARTS, MOST_ROWS, MOST_HASHES = 128, 24, 1 << 14, 1 << 20


def votes(h: np.ndarray) -> np.ndarray:
    """For each column of ``h`` (64-bit words) and each bit, in how many rows it is set.

    Three words of one weight become one of this weight and one of twice the weight (a full adder on all bits), until
    at most two words of each weight are left to unpack.
    """
    columns = h.shape[1]
    total, weight = np.zeros((columns, 64), np.int64), 1
    while len(h):
        carried = [h[:0]]
        while len(h) > 2:
            m = len(h) // 3
            a, b, c = h[:m], h[m : 2 * m], h[2 * m : 3 * m]
            x = a ^ b
            carried.append((a & b) | (c & x))
            h = np.concatenate([x ^ c, h[3 * m :]])
        for row in h:
            total += weight * np.unpackbits(np.ascontiguousarray(row).view(np.uint8).reshape(columns, 8), axis=1, bitorder="little").astype(np.int64)
        h = np.concatenate(carried)
        weight *= 2
    return total


def _majority(total: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * total > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: str | None, size: int = 4) -> int:
    import xxhash

    words = [w for w in (text or "").encode().translate(FOLD).split(b" ") if w]
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    first, last = starts[:n], ends[size - 1 :]
    total = np.zeros((1, 64), np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory on very long texts
        total += votes(np.array([digest(body[a:b], 42) for a, b in zip(first[k : k + (1 << 16)].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)], "<u8")[:, None])
    return int(_majority(total, n)[0])


def fingerprints(text: Column, size: int = 4) -> Column:
    """The fingerprint of each whole text, its bits as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).astype(np.int64))

    return of(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _shared(values: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of values: the mask of the bits that all have alike, and these bits."""
    starts = np.arange(0, len(values), run)
    ones, any_one = np.bitwise_and.reduceat(values, starts), np.bitwise_or.reduceat(values, starts)
    mask = ~(ones ^ any_one)
    return mask, ones & mask


class GrayIndex:
    """Nodes over values in Gray order, from the top down: each level's (own bits' mask, bits).

    A node's own bits are those that all below it share and not all below its parent.
    """

    LEAF, FAN = 16, 4

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        runs = [self.LEAF]
        while runs[-1] < len(values):
            runs.append(runs[-1] * self.FAN)
        self.levels = []
        above = np.zeros(1, np.uint64)
        for run in reversed(runs):
            mask, bits = _shared(self.values, run)
            self.levels.append((mask & ~np.repeat(above, self.FAN)[: len(mask)], bits))
            above = mask

    def near(self, other: GrayIndex, allowed: np.ndarray, groups: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (leaf group of self, leaf group of other) that no node between them rules out.

        ``allowed[d]``: the differences allowed among d bits compared.
        """
        mask, bits = _shared(self.values, self.LEAF)
        for begin in range(0, len(mask), groups):
            q = np.arange(begin, min(begin + groups, len(mask)))
            node, far, seen = (np.zeros(len(q), np.int64) for _ in range(3))
            for level, (own, shared) in enumerate(other.levels):
                if level:
                    q, node = np.repeat(q, self.FAN), (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                    far, seen = np.repeat(far, self.FAN), np.repeat(seen, self.FAN)
                    there = node < len(own)
                    q, node, far, seen = q[there], node[there], far[there], seen[there]
                both = own[node] & mask[q]
                far = far + np.bitwise_count((shared[node] ^ bits[q]) & both)
                seen = seen + np.bitwise_count(both)
                left = far <= allowed[seen]
                q, node, far, seen = q[left], node[left], far[left], seen[left]
            yield q, node

    def pairs(self, other: GrayIndex, allowed: np.ndarray, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in self and other of the values that differ in ``allowed[64]`` bits or fewer; within self, each pair once."""
        span = np.arange(self.LEAF)
        for q, node in self.near(other, allowed):
            if other is self:
                q, node = q[q <= node], node[q <= node]
            for k in range(0, len(q), at_once):
                a = q[k : k + at_once, None] * self.LEAF + span
                b = node[k : k + at_once, None] * self.LEAF + span
                x, y = self.values[np.minimum(a, len(self.values) - 1)], other.values[np.minimum(b, len(other.values) - 1)]
                hit = np.flatnonzero(np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= allowed[64])
                r, i, j = hit // self.LEAF**2, hit // self.LEAF % self.LEAF, hit % self.LEAF
                a, b = a[r, i], b[r, j]
                kept = (a < len(self.values)) & (b < len(other.values))
                if other is self:
                    kept &= a < b
                yield a[kept], b[kept]


def exactly(radius: int) -> np.ndarray:
    return np.full(65, radius)


class Forest:
    """Union-find over 0 .. n - 1; ``add`` returns which of the pairs joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        while True:  # flat, so that most pairs of one tree are told in one step
            up = self.root[self.root]
            if (up == self.root).all():
                break
            self.root = up
        apart = np.flatnonzero(self.root[a] != self.root[b])
        kept = []
        root = self.root
        for k, x, y in zip(apart.tolist(), a[apart].tolist(), b[apart].tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append(k)
        return np.array(kept, np.int64)


def _forest(a: GrayIndex, b: GrayIndex, ids_a: np.ndarray, ids_b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    shift = 0 if a is b else len(ids_a)
    forest = Forest(len(ids_a) + (len(ids_b) if shift else 0))
    out = [(ids_a[:0], ids_b[:0])]
    for x, y in a.pairs(b, exactly(radius)):
        x, y = a.order[x], b.order[y]
        kept = forest.add(x, y + shift)
        out.append((ids_a[x[kept]], ids_b[y[kept]]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _blocks(rows: DataFrame, columns: list[str], capacity: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` once for each of the fingerprint columns, as ``k, block, ...``; and the nodes of the blocks.

    The bounds of the blocks are quantiles of the Gray rank: a few numbers for each ``capacity`` rows.  A few blocks there
    are always (``least``), so that the work is dealt out and the rows that routing makes do not grow faster than the input.
    """
    n = rows.count()
    blocks = max(least, -(-n // capacity))

    @F.pandas_udf("long")
    def rank(fp: pd.Series) -> pd.Series:
        return pd.Series(gray_rank(fp.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    bounds = [np.zeros(0, np.int64)] * len(columns)
    if n and blocks > 1:
        at = [j / blocks for j in range(1, blocks)]
        got = rows.select(*(rank(c).alias(c) for c in columns)).agg(*(F.percentile_approx(c, at, max(10_000, 20 * blocks)).alias(c) for c in columns)).first()
        bounds = [np.unique(np.array(got[c], np.int64)) for c in columns]

    @F.pandas_udf("array<int>")
    def placed(*fps: pd.Series) -> pd.Series:
        places = [np.searchsorted(b, gray_rank(x.to_numpy(np.int64).view(np.uint64)).view(np.int64), "right") for x, b in zip(fps, bounds, strict=True)]
        return pd.Series(list(np.stack(places, 1).astype(np.int32)))

    dealt = rows.withColumn("__at", placed(*columns) if n and blocks > 1 else F.array(*(F.lit(0) for _ in columns)))
    dealt = dealt.select("*", F.posexplode("__at").alias("k", "block")).drop("__at")
    word = F.element_at(F.array(*columns), F.col("k") + 1)
    nodes = dealt.groupBy("k", "block").agg(F.bit_and(word).alias("ones"), F.bit_or(word).alias("any"))
    return dealt, nodes


def _routes(nodes: DataFrame, allowed: np.ndarray) -> DataFrame:
    """``k, s, t``: the pairs of blocks (s <= t) that their nodes do not rule out."""
    nodes = materialised(nodes)
    table = nodes.toPandas()  # 24 bytes for each block of fingerprints
    by_k = {}
    for k, part in table.groupby("k"):
        ones, any_one = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("ones", "any"))
        by_k[k] = (part["block"].to_numpy(), ~(ones ^ any_one), ones)
    shared = nodes.sparkSession.sparkContext.broadcast(by_k)

    @F.pandas_udf("array<int>")
    def partners(k: pd.Series, block: pd.Series, ones: pd.Series, any_one: pd.Series) -> pd.Series:
        out = []
        for kk, s, x, y in zip(k, block, ones.to_numpy(np.int64).view(np.uint64), any_one.to_numpy(np.int64).view(np.uint64), strict=True):
            at, mask, bits = shared.value[kk]
            both = mask & ~(x ^ y)
            far, seen = np.bitwise_count((bits ^ x) & both), np.bitwise_count(both)
            out.append(at[(far <= allowed[seen]) & (at >= s)].astype(np.int32))
        return pd.Series(out, dtype=object)

    return nodes.select("k", F.col("block").alias("s"), F.explode(partners("k", "block", "ones", "any")).alias("t"))


def _searched(rows: DataFrame, columns: list[str], allowed: np.ndarray, capacity: int, least: int, search: Callable[[int, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``search(k, one block, the other)`` for each pair of blocks that is not ruled out, in a task of its own."""
    dealt, nodes = _blocks(rows, columns, capacity, least)
    routes = materialised(_routes(nodes, allowed))
    one = dealt.withColumnRenamed("block", "s").join(routes, ["k", "s"]).withColumn("side", F.lit(0))
    two = dealt.withColumnRenamed("block", "t").join(routes.where("s != t"), ["k", "t"]).withColumn("side", F.lit(1))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        a, b = pdf[side == 0], pdf[side == 1]
        return search(int(pdf["k"].iloc[0]), a, b if len(b) else a)

    return one.unionByName(two).groupBy("k", "s", "t").applyInPandas(task, schema)


def hamming_links(fps: DataFrame, radius: int = 4, capacity: int = 1 << 20) -> DataFrame:
    """``a, b``: links that join all distinct values of ``fp`` within ``radius`` of one another."""

    def search(k: int, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        x = one["fp"].to_numpy(np.int64)
        a = GrayIndex(x.view(np.uint64))
        y, b = (x, a) if two is one else (two["fp"].to_numpy(np.int64), GrayIndex(two["fp"].to_numpy(np.int64).view(np.uint64)))
        p, q = _forest(a, b, x, y, radius)
        return pd.DataFrame({"a": p, "b": q})

    return _searched(fps.select("fp"), ["fp"], exactly(radius), capacity, 16, search, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node of each component, by alternating large-star and small-star rounds."""
    ordered = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = materialised(ordered(links))
    for _ in range(most_rounds):
        n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        if n == nodes and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break  # stars only: each node has one link, to a root that has none
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialised(ordered(small.union(down.select("a", F.col("m").alias("b")))))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4, capacity: int = 1 << 20) -> DataFrame:
    """``doc_id, fp (long), component_id`` of each document."""
    marked = materialised(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), size).alias("fp")))
    fps = materialised(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialised(components(hamming_links(fps, radius, capacity)))
    # most components are one fingerprint; the others are summed up by root and joined back
    others = roots.select("node", "root").union(roots.select("root", "root").distinct())
    others = fps.join(others, F.col("fp") == F.col("node")).select("fp", "least", "root")
    named = salted_join(others, others.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = fps.join(named.select("fp", "component_id", F.lit(True).alias("many")), "fp", "left")
    named = named.select("fp", F.when(F.col("many"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return salted_join(marked, named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- by the similarity of shingle sets --------------------------------------------------------------------------------

#: Odd multipliers that make further hash values of a shingle from its XXH64 value.
MIX = (np.arange(1, WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, size: int) -> set[bytes]:
    words = [w for w in (text or "").encode().translate(FOLD).split(b" ") if w]
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def hashes(text: str | None, size: int) -> np.ndarray:
    """The hashed set of shingles, sorted."""
    import xxhash

    return np.array(sorted({xxhash.xxh64_intdigest(x, 42) for x in shingles(text, size)}), "<u8")


def signature(text: str | None, size: int) -> tuple:
    """The digest of the set of shingles, its size, and its fingerprints as signed longs."""
    h = hashes(text, size)
    total = np.zeros((WORDS, 64), np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)]
        more = part[:, None] * MIX
        more ^= more >> np.uint64(32)
        more *= MIX
        total += votes(np.concatenate([part[:, None], more ^ (more >> np.uint64(29))], 1))
    return (hashlib.blake2b(h.tobytes(), digest_size=16).hexdigest(), len(h), *_majority(total, len(h)).view(np.int64).tolist())


NAMES = [f"w{k}" for k in range(WORDS)]


def _near(w: np.ndarray, v: np.ndarray, m: np.ndarray, n: np.ndarray, permille: int) -> np.ndarray:
    """Whether sets of sizes m and n, with fingerprints w and v by columns, may be alike."""
    far = sum((np.bitwise_count(x ^ y).astype(np.int64) for x, y in zip(w, v, strict=True)), np.zeros(len(n), np.int64))
    return (np.minimum(m, n) * 1000 >= np.maximum(m, n) * permille) & (far <= 64 * WORDS * WIDE // 1000)


def _candidates(items: DataFrame, permille: int, capacity: int) -> DataFrame:
    """``a, b`` (rows of items): links that join all candidates."""
    allowed = np.floor(1.5 + np.arange(65) * LOOSE)
    allowed[64] = NARROW

    def search(k: int, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        sides = (one,) if two is one else (one, two)
        w = [np.ascontiguousarray(x[NAMES].to_numpy(np.int64).view(np.uint64).T) for x in sides]
        index = [GrayIndex(x[k]) for x in w]
        n = [x["n"].to_numpy(np.int64) for x in sides]
        row = np.concatenate([x["row"].to_numpy(np.int64) for x in sides])
        shift = 0 if two is one else len(one)
        forest = Forest(len(row))
        found = [np.zeros((2, 0), np.int64)]
        for p, q in index[0].pairs(index[-1], allowed):
            p, q = index[0].order[p], index[-1].order[q]
            left = _near(w[0][:, p], w[-1][:, q], n[0][p], n[-1][q], permille)
            if left.any():
                both = np.stack([p[left], q[left] + shift])
                found.append(row[both[:, forest.add(*both)]])
        a, b = np.concatenate(found, 1)
        return pd.DataFrame({"a": a, "b": b})

    return _searched(items.select("row", "n", *NAMES), NAMES, allowed, capacity, 4, search, "a long, b long")


def _alike(pdf: pd.DataFrame, permille: int) -> pd.DataFrame:
    """``a, b`` (rows): a spanning forest of the rows alike in each cluster, or in two parts (sides 0 and 1) of one."""
    pdf = pdf.sort_values(["cluster", "side"], kind="stable")
    n, row, cluster, side = (pdf[c].to_numpy(np.int64) for c in ("n", "row", "cluster", "side"))
    w = np.ascontiguousarray(pdf[NAMES].to_numpy(np.int64).view(np.uint64).T)
    values, ids = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in pdf["hashes"]]), return_inverse=True)
    begins = np.cumsum(n) - n
    held = np.zeros(len(values), bool)
    label = np.arange(len(pdf))  # of the tree of each row
    out = [np.zeros((2, 0), np.int64)]
    bounds = np.append(np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1)), len(pdf))
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        two = first + int(np.searchsorted(side[first:last], 1))
        for p in range(first, two):
            q = np.arange(p + 1 if two == last else two, last)
            q = q[label[q] != label[p]]
            q = q[_near(w[:, p : p + 1], w[:, q], n[p], n[q], permille)]
            if not len(q):
                continue
            mine = ids[begins[p] : begins[p] + n[p]]
            held[mine] = True
            ends = np.cumsum(n[q])
            theirs = ids[np.arange(ends[-1]) + np.repeat(begins[q] - ends + n[q], n[q])]
            both = np.add.reduceat(held[theirs], ends - n[q], dtype=np.int64)
            held[mine] = False
            q = q[1000 * both >= permille * (n[p] + n[q] - both)]
            trees, at = np.unique(label[q], return_index=True)
            out.append(np.stack([np.full(len(at), row[p]), row[q[at]]]))
            inside = label[first:last]
            inside[np.isin(inside, trees)] = label[p]
    a, b = np.concatenate(out, 1)
    return pd.DataFrame({"a": a, "b": b})


def _members(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """``row, cluster, parts`` of each item that has a candidate."""
    roots = materialised(components(candidates))
    members = roots.select(F.col("node").alias("row"), F.col("root").alias("cluster")).union(roots.select("root", "root").distinct())
    members = materialised(members.join(items.select("row", "n"), "row"))
    over = lambda c, most: F.ceil(c / F.lit(most))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("h"))
    parts = F.greatest(F.least(over(F.col("m"), PART), F.lit(PARTS)), over(F.col("m"), MOST_ROWS), over(F.col("h"), MOST_HASHES))
    return salted_join(members, sizes.select("cluster", parts.cast("int").alias("parts")), "cluster")


def _sound(marked: DataFrame, members: DataFrame, text: str, size: int, permille: int) -> DataFrame:
    """``a, b`` (rows): links that join all members of a cluster that are alike.

    Clusters of one part go to buckets; of others, each pair of parts goes to a task.
    """

    @F.pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([hashes(t, size).tobytes() for t in texts], dtype=object)

    rows = marked.select(F.col("__row").alias("row"), "__s.n", *(f"__s.{c}" for c in NAMES), F.col(text).alias("body"))
    rows = rows.join(small(members.drop("n")), "row").withColumn("hashes", hashed("body")).drop("body")
    buckets = max(64, -(-(members.where("parts = 1").agg(F.sum("n")).first()[0] or 0) // MOST_HASHES))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    met = rows.withColumn("part", part).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    alone = F.col("parts") == 1
    dealt = met.select(
        "row", "cluster", "n", *NAMES, "hashes",
        F.when(alone, F.pmod(F.xxhash64("cluster"), F.lit(buckets))).otherwise(F.col("cluster")).alias("g"),
        F.when(alone, -1).otherwise(F.least("part", "met")).alias("s"),
        F.when(alone, -1).otherwise(F.greatest("part", "met")).alias("t"),
        (F.col("part") > F.col("met")).cast("int").alias("side"),
    )
    return dealt.groupBy("g", "s", "t").applyInPandas(lambda pdf: _alike(pdf, permille), "a long, b long")


def similar(docs: DataFrame, *, text: str = "text", size: int = 5, permille: int = 800, capacity: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with a key ``__row``, as a written table, and ``__row, __component`` of each: rows linked by a
    Jaccard similarity of ``permille`` or more of their sets of shingles, or by a chain of such.  Rows with equal sets
    are one item.

    Items that candidates join, directly or by a chain, are a cluster; its items are compared with one another in tasks
    that return links of a spanning forest, so that neither search makes a row for each pair.  Null and wordless texts are
    one item; ids play no part.  Texts are not shuffled, hashed sets only of items that have candidates.
    """

    @F.pandas_udf("item string, n long, " + ", ".join(f"{w} long" for w in NAMES))
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([signature(t, size) for t in texts], columns=["item", "n", *NAMES])

    marked = materialised(docs.withColumns({"__row": F.monotonically_increasing_id(), "__s": signed(F.col(text))}))
    items = marked.groupBy(F.col("__s.item").alias("item")).agg(F.min("__row").alias("row"), *(F.first(f"__s.{c}").alias(c) for c in ("n", *NAMES)))
    items = materialised(items)
    members = materialised(_members(items, _candidates(items.where("n > 0"), permille, capacity)))
    roots = materialised(components(_sound(marked, members, text, size, permille)))
    named = items.join(roots, F.col("row") == F.col("node"), "left").select("item", F.coalesce("root", "row").alias("__component"))
    rows = salted_join(marked.select("__row", F.col("__s.item").alias("item")), named, "item").select("__row", "__component")
    return marked.drop("__s"), rows
