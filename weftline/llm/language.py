"""Language ID by compression: one zstandard raw-content dictionary per language, the smallest encoding wins.

The dictionaries are learnt from labelled training documents: of each language whole texts in the order of their hashes
(equal texts once), as many as fit into ``dictionary_bytes``, the one bound of the fit; longer texts are passed over.
Candidates are chosen by the share of a language's bytes that the bound is, so no language is sorted.  A dictionary for
each language is sent to all tasks, at most ``most_languages`` (more raise an error).  Prediction reads every whole
text, in blocks of ``block_bytes`` so that the dictionary, not the text's own past, decides.  Texts are lower-cased and
what is no letter becomes single blanks.

The score of a text is the softmax of minus its bits per byte, sharpened by ``sharpness``.  ``rejected`` is true where
the best two languages are closer than ``margin`` (a share of the best size): the prediction stands, but is not sure.

Defined results: null texts and texts without letters get ``und`` with score 0, as all do if nothing is learnt; of
languages that encode to the same size the first by name wins; rows with a null label are not learnt from; only the text
and label columns are read.  More than ``most_languages`` languages are an error: their dictionaries are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = re.compile(r"[\W\d_]+")
PREDICTED = "lang_pred string, score double, margin double, rejected boolean"


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        import zstandard as zstd

        self.languages = sorted(dictionaries)
        self.by_language = []
        for k in self.languages:
            d = zstd.ZstdCompressionDict(dictionaries[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_language.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes, block: int) -> np.ndarray:
        parts = [data[k : k + block] for k in range(0, len(data), block)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.by_language], float)


def plain(text: str) -> str:
    """Lower-case letters, all else as single blanks."""
    return OTHER.sub(" ", text.lower())


def judge(c: Compressors, text: str | None, block: int, margin: float, sharpness: float) -> tuple[str, float, float, bool]:
    if text is None or not c.languages or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0, True
    data = plain(text).encode()
    sizes = c.sizes(data, block)
    order = np.argsort(sizes, kind="stable")
    best = order[0]
    gap = float((sizes[order[1]] - sizes[best]) / sizes[best]) if len(order) > 1 else 1.0
    odds = np.exp(-sharpness * (sizes - sizes[best]) / max(len(data), 1))
    return c.languages[best], float(round(1 / odds.sum(), 6)), round(gap, 6), gap < margin


def learn(train: DataFrame, *, text: str = "text", lang: str = "lang", dictionary_bytes: int = 160_000, most_languages: int = 500) -> dict[str, bytes]:
    """The dictionary of each language."""
    t = F.col(text)
    rows = train.where(t.isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), t.alias("text"), F.octet_length(t).alias("size"), F.xxhash64(t).alias("h"))
    rows = rows.where(F.col("size").between(1, dictionary_bytes))
    totals = rows.groupBy("lang").agg(F.sum("size").alias("all")).limit(most_languages + 1).toPandas()
    if len(totals) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    # twice the share that the bound is of all bytes: copies count once below, and what does not fit is left out
    shares = train.sparkSession.createDataFrame([(k, min(1.0, (2 * dictionary_bytes + 200_000) / n)) for k, n in zip(totals["lang"], totals["all"].tolist(), strict=True)], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    drawn = drawn.groupBy("lang", "h").agg(F.min("size").alias("size"), F.min("text").alias("text"))
    so_far = F.sum("size").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    kept = drawn.withColumn("so_far", so_far).where(F.col("so_far") <= dictionary_bytes)
    out: dict[str, bytes] = {}
    for r in kept.orderBy("lang", "h").select("lang", "text").collect():
        out[r["lang"]] = out.get(r["lang"], b"") + plain(r["text"]).encode() + b" "
    return {k: v for k, v in out.items() if len(v) >= 8}


def predict(text: Column, dictionaries: dict[str, bytes], *, block_bytes: int = 4_096, margin: float = 0.02, sharpness: float = 40.0, level: int = 3) -> Column:
    """``struct<lang_pred, score, margin, rejected>`` of each whole text."""

    @F.pandas_udf(PREDICTED)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Compressors(dictionaries, level)
        for texts in batches:
            yield pd.DataFrame([judge(c, t, block_bytes, margin, sharpness) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return judged(text)
