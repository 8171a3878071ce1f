"""A corpus pipeline of five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, pieces, pii, quality, simhash
from weftline.llm.common import materialised, small, table
from weftline.llm.queries import piece_model


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = quality.judged(docs, table(spark, sf_dir, "labels"), prefix="__q_")
    # a filter would be pushed below the steps that make __q_kept and repeat them; an exploded one-element array is not
    return judged.select(*docs.columns, F.explode(F.when(F.col("__q_kept"), F.array(F.lit(1)))).alias("__q_one")).drop("__q_one")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (0.8 of their five-word shingles shared, or linked by such) one row stays, that with the
    smallest id; a row without an id only if its group has none."""
    marked, rows = simhash.similar(docs)
    near = materialised(marked.select("__row", "doc_id", F.xxhash64("text").alias("h")).join(rows, "__row"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "__row")
    first = near.groupBy("__component").agg(F.min_by("__row", order).alias("__row"))
    gone = materialised(near.select("__row").join(first.select("__row"), "__row", "left_anti"))
    return marked.join(small(gone), "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text."""
    text = pii.redacted(F.col("text"), F.col("__pii_spans"))
    found = pii.personal_data(docs, prefix="__pii_").withColumn("text", text)
    changed = {"n_chars": F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return found.withColumns(changed).select(*docs.columns) if changed else found.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and the text that they decode to."""
    coded = docs.select("doc_id", "lang", "source", pieces.round_trip(F.col("text"), piece_model()).alias("p"))
    return coded.select("doc_id", "lang", "source", F.size("p.ids").cast("long").alias("n_tokens"), "p.ids", "p.text")


STAGES = [
    ("quality rules", keep_good),
    ("simhash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact),
    ("sentencepiece", tokenize),
]
#: Hashed likelihood ratios, fingerprints and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialised(docs)
    return docs
