"""Substring dedup by content-defined chunks: a gear rolling hash cuts texts, equal chunks are found by digest.

A cut follows a byte where chosen bits of the gear hash of the last ``WINDOW`` bytes are zero, so an insertion shifts
cuts only nearby.  Cuts closer than ``least`` bytes to the one before are left out.  Where no cut comes within ``most``
bytes, the last of the places with the smallest hash becomes one: in a stretch that repeats one word or phrase, which
has no zero bits or has them in every period, such cuts fall on the same letter whatever stands before.  No cut falls
inside a character.

Texts are chunked once, under a row key that is written with the chunks.  A chunk whose digest (128 bits) occurs in two
or more rows is common.  Common chunks that follow each other make a run; only runs of ``run_words`` words or more count
as shared, which a passage of over 50 words leaves after its ragged ends: a lone chunk, or a common phrase, is left
alone.  Of the rows that hold a shared chunk the one with the smallest id (of rows with the same id one and the same for
all chunks) keeps it, all others lose it (``removed`` gives the places).

Digests are counted by partial aggregates and joined back by digest and salt, so that a digest that a third of all rows
hold is dealt to several tasks.  No group is gathered but a row's own chunks.

Defined results: null and empty texts have no chunks; chunks repeated in one row alone are not shared; each row is a
document of its own, whatever its id: repeated rows share all they hold, and one of them keeps it; rows with a null id
keep a chunk only where no row with an id holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialised, salted_join, small
from weftline.llm.spans import once, pieces, stretch
from weftline.operators.tables import numbered

WINDOW = 16


def gear_table() -> np.ndarray:
    """A 16-bit value for each byte, by the SplitMix64 rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint16)


GEAR = gear_table()


def cuts(data: bytes, least: int, most: int, bits: int) -> list[int]:
    """Ends of the chunks."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    g = GEAR[b]
    h = g.copy()
    for k in range(1, min(WINDOW, n)):
        h[k:] += g[:-k] << np.uint16(k)
    inner = np.append(b[1:] & 0xC0 == 0x80, False)  # the next byte continues a character
    h[inner] = 0xFFFF
    places = np.flatnonzero(h >> np.uint16(WINDOW - bits) == 0) + 1
    out, last = [], 0
    for p in [*places.tolist(), n]:
        while p - last > most:
            last += most - int(h[last + least - 1 : last + most][::-1].argmin())
            out.append(last)
        if p - last >= least or p == n and p > last:
            out.append(p)
            last = p
    return out


def chunked(text: str | None, least: int, most: int, bits: int) -> tuple[np.ndarray, ...]:
    """Of each chunk the digest (two longs), its end in code points, and the number of words that begin in it."""
    import xxhash

    data = (text or "").encode()
    if not data:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    ends = cuts(data, least, most, bits)
    digest = xxhash.xxh3_128_digest
    halves = np.frombuffer(b"".join([digest(data[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]), "<i8").reshape(-1, 2)
    b = np.frombuffer(data, np.uint8)
    blank = (b == 32) | (b >= 9) & (b <= 13)
    begins = np.append(0, np.cumsum(~blank & np.append(True, blank[:-1])))
    stops = np.cumsum(b & 0xC0 != 0x80)[np.array(ends) - 1]
    return halves[:, 0], halves[:, 1], stops.astype(np.int32), np.diff(begins[[0, *ends]]).astype(np.int32)


def chunks(text: Column, least: int, most: int, bits: int, at_once: int = 500) -> Column:
    """``a, b`` (digest), ``stop`` and ``words`` of the chunks, in order, as parallel arrays; few rows in memory at a time."""

    @F.pandas_udf("a array<long>, b array<long>, stop array<int>, words array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for j in range(0, len(texts), at_once):
                rows = [chunked(t, least, most, bits) for t in texts.iloc[j : j + at_once]]
                yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(("a", "b", "stop", "words"))})

    return of(text)


def _long_runs(stop: np.ndarray, words: np.ndarray, at: np.ndarray | None, kept: np.ndarray | None, run_words: int) -> tuple:
    """From the places of the common chunks (and whether this row keeps them): what ``repeats`` returns of a row."""
    n_chars = int(stop[-1]) if len(stop) else 0
    if at is None or not len(at):
        return 0, 0, n_chars, 0, [], []
    order = np.argsort(at)
    at, kept = at[order], kept[order]
    run = np.cumsum(np.diff(at, prepend=at[0]) > 1)
    size = np.bincount(run, words[at]).astype(np.int64)
    shared = size[run] >= run_words
    at, lost = at[shared], ~kept[shared]
    stops = stop[at[lost]]
    starts = np.where(at[lost] > 0, stop[at[lost] - 1], 0)
    return int(len(at)), int(lost.sum()), n_chars - int((stops - starts).sum()), int(size.max()), starts.tolist(), stops.tolist()


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 16, most: int = 96, bits: int = 5, run_words: int = 28) -> DataFrame:
    """``doc_id, n_shared, n_removed, chars_kept, longest_run_words, repeats, removed`` of each row.

    ``n_shared`` and ``n_removed`` count chunks of long runs; ``longest_run_words`` is the longest run of common chunks.
    """
    cut = docs.select(F.col(doc_id).alias("doc_id"), chunks(F.col(text), least, most, bits).alias("c"))
    cut = materialised(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "c.*"))
    # rows numbered by id (nulls last, rows of one id apart), so that the row that keeps a chunk is the least number
    turn = materialised(numbered(cut.select("row", "doc_id"), [F.col("doc_id").isNull(), "doc_id", "row"]).select(F.col("row").alias("of"), F.col("number").alias("turn")))
    cut = cut.join(small(turn), F.col("row") == F.col("of")).select("doc_id", F.col("turn").alias("row"), "a", "b", "stop", "words")
    each = cut.select("row", F.posexplode(F.arrays_zip("a", "b")).alias("at", "d")).select("row", "at", "d.a", "d.b")
    common = each.groupBy("a", "b").agg(F.min("row").alias("keeper"), F.max("row").alias("hi")).where("keeper != hi").select("a", "b", "keeper")
    hits = salted_join(each, common, ["a", "b"])
    found = hits.groupBy("row").agg(F.collect_list(F.struct("at", (F.col("row") == F.col("keeper")).alias("kept"))).alias("x"))
    found = found.select(F.col("row").alias("of"), F.col("x.at").alias("at"), F.col("x.kept").alias("kept"))

    @F.pandas_udf("n_shared long, n_removed long, chars_kept long, longest_run_words long, start array<int>, stop array<int>")
    def judged(stop: pd.Series, words: pd.Series, at: pd.Series, kept: pd.Series) -> pd.DataFrame:
        rows = [_long_runs(*r, run_words) for r in zip(stop, words, at, kept, strict=True)]
        return pd.DataFrame(rows, columns=["n_shared", "n_removed", "chars_kept", "longest_run_words", "start", "stop"])

    lengths = cut.select("row", "doc_id", "stop", "words").join(found, F.col("row") == F.col("of"), "left")
    out = lengths.select("doc_id", judged("stop", "words", "at", "kept").alias("j")).select("doc_id", "j.*")
    removed = F.arrays_zip(F.col("start"), F.col("stop")).cast("array<struct<start:int,stop:int>>").alias("removed")
    return out.select("doc_id", "n_shared", "n_removed", "chars_kept", "longest_run_words", (F.col("n_shared") > 0).alias("repeats"), removed)


def without(text: Column, removed: Column) -> Column:
    """The text without the removed stretches (ascending, apart)."""
    stops = F.concat(F.array(F.lit(0)), removed["stop"])
    starts = F.concat(removed["start"], F.array(F.char_length(text)))
    return once(pieces(text), lambda parts: F.array_join(F.zip_with(stops, starts, lambda a, b: stretch(parts, a, b)), ""))
