"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become words joined by single blanks, with a blank at either end, as UTF-8 bytes; a window of a benchmark item is
``size`` consecutive words in the same form, or the whole item if it has fewer.  A window occurs where its bytes do,
since blanks bound it.  ``WindowSearch`` keeps for windows of similar length: a shift table from blocks of bytes to how
far the search may move on, buckets of windows by the last block of their shortest common length, and compares windows
of the bucket byte for byte.

The windows are a table, each once with the ids of its items, made on the executors and written to the shared folder.
They are cut by hash into slices of about ``slice_windows`` windows, however large the benchmark or one of its items is.
One slice at a time is read, broadcast and searched for in all documents, and given up before the next: driver and
workers hold one slice (some 300 bytes a window), and documents are read once for each slice.  The findings of several
slices are written, and merged by a key of the row.

Defined results: a null text or item has no words; an item without words has no windows; a document without words is
clean; of items with a null id no id is listed, though their windows count as hits; items with the same id count as one.
Each row is judged alone, whatever its id and however many slices there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialised

#: Bytes that separate words become blanks, A-Z lower case; all others stand for themselves.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FOUND = "n_words long, spans array<long>, items array<string>"


def folded(text: str | None) -> bytes:
    words = (text or "").encode().translate(FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


class WindowSearch:
    """``windows``: bytes of a window to the ids of its items."""

    def __init__(self, windows: dict[bytes, tuple[str, ...]], block: int = 4):
        self.windows = windows
        self.classes = []
        by_length: dict[int, list[bytes]] = {}
        for w in windows:
            by_length.setdefault(len(w).bit_length(), []).append(w)
        for patterns in by_length.values():
            least = min(map(len, patterns))
            width = min(block, least)
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, list[bytes]] = {}
            for w in patterns:
                for end in range(width, least + 1):
                    at = w[end - width : end]
                    shift[at] = min(shift.get(at, least), least - end)
                buckets.setdefault(w[least - width : least], []).append(w)
            # a bucket is told further apart by the first bytes, so that a common ending costs one look-up
            heads = {k: self._by_head(v, least) for k, v in buckets.items()}
            self.classes.append((least, width, least - width + 1, shift, heads))

    @staticmethod
    def _by_head(patterns: list[bytes], least: int) -> dict[bytes, list[bytes]]:
        out: dict[bytes, list[bytes]] = {}
        for w in patterns:
            out.setdefault(w[:least], []).append(w)
        return out

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Start and bytes of each occurrence of a window."""
        n = len(text)
        for least, width, most, shift, heads in self.classes:
            end = least
            while end <= n:
                block = text[end - width : end]
                step = shift.get(block, most)
                if step:
                    end += step
                    continue
                start = end - least
                for w in heads[block].get(text[start:end], ()):
                    if text.startswith(w, start):
                        yield start, w
                end += 1

    def search(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Number of words; hit stretches of words as start, end, start, end, ...; ids of the items found."""
        body = folded(text)
        if not body:
            return 0, [], []
        found = sorted(self.occurrences(body))
        spans: list[int] = []
        items: set[str] = set()
        done = word = 0
        for start, w in found:
            word += body.count(b" ", done, start)  # words before this place
            done = start
            end = word + w.count(b" ") - 1
            if spans and word <= spans[-1]:
                spans[-1] = max(spans[-1], end)
            else:
                spans += (word, end)
            items.update(self.windows[w])
        return body.count(b" ") - 1, spans, sorted(items)


def windows_of(text: str | None, size: int) -> list[bytes]:
    words = folded(text).split()
    return list({b" " + b" ".join(words[k : k + size]) + b" " for k in range(max(1, len(words) - size + 1) if words else 0)})


def windows(benchmark: DataFrame, *, item_id: str = "item_id", item_text: str = "text", size: int = 10, slice_windows: int = 200_000) -> tuple[DataFrame, int]:
    """``w`` (bytes), ``items`` (sorted ids as text) and ``slice`` of each distinct window, and the number of slices."""

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([windows_of(t, size) for t in texts], dtype=object)

    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body")).distinct()
    each = items.select("item", F.explode(cut("body")).alias("w")).groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    table = materialised(each)
    slices = max(1, -(-table.count() // slice_windows))
    return table.withColumn("slice", F.pmod(F.xxhash64("w"), F.lit(slices))), slices


def _finder(search) -> Column:
    """``search``: broadcast of a WindowSearch."""

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([search.value.search(t) for t in texts], columns=["n_words", "spans", "items"])

    return find


def _search(table: DataFrame, k: int):
    """A broadcast search for the windows of one slice."""
    found = table.where(F.col("slice") == k).select("w", "items").collect()
    return table.sparkSession.sparkContext.broadcast(WindowSearch({bytes(r["w"]): tuple(r["items"]) for r in found}))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, slice_windows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, each judged alone."""
    table, slices = windows(benchmark, item_id=item_id, item_text=item_text, size=size, slice_windows=slice_windows)
    for k in range(slices):
        search = _search(table, k)
        docs = docs.where(F.size(_finder(search)(F.col(text))["spans"]) == 0)
        if slices > 1:
            docs = materialised(docs)
            search.destroy()
    return docs


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, slice_windows: int = 200_000) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items (sorted), spans (hit words, start and end in turn)`` of each document."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    table, slices = windows(benchmark, item_id=item_id, item_text=item_text, size=size, slice_windows=slice_windows)
    if slices == 1:
        merged = each.select("doc_id", _finder(_search(table, 0))("body").alias("f")).select("doc_id", "f.*")
    else:
        each = materialised(each.withColumn("row", F.monotonically_increasing_id()))  # the key must be the same for each slice
        parts = []
        for k in range(slices):
            search = _search(table, k)
            parts.append(materialised(each.select("row", "doc_id", _finder(search)("body").alias("f")).select("row", "doc_id", "f.*")))
            search.destroy()
        union = reduce(DataFrame.unionByName, parts)
        lists = union.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

        @F.pandas_udf("array<long>")
        def joined(rows: pd.Series) -> pd.Series:
            return pd.Series([merged_spans(r) for r in rows], dtype=object)

        merged = lists.select("doc_id", "n_words", joined("s").alias("spans"), "items")
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def merged_spans(lists: Iterable[Iterable[int]]) -> list[int]:
    """Stretches (start, end, start, end, ...) of several lists as one; those that touch become one."""
    out: list[int] = []
    for a, b in sorted((int(x[k]), int(x[k + 1])) for x in lists for k in range(0, len(x), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out
