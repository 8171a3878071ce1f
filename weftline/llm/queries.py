"""The queries ``opN_<name>`` over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import alignment, chunks, decontaminate, language, mining, pieces, pii, quality, secret_scan, sharding, simhash, spans, toxicity, urls
from weftline.llm.common import held_out, joined, table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pieces.encode_digests(F.col("text"), piece_model()).alias("p")).select("doc_id", "p.*")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language.learn(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language.predict(F.col("text"), known).alias("p")).select("doc_id", "held_out", "p.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    df = quality.judged(docs, table(spark, sf_dir, "labels"), prefix="q_")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")
    return df.select("doc_id", *(F.col(f"q_{n}").alias(n) for n in names))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined("items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _counted(docs: DataFrame, kinds: tuple[str, ...], prefix: str, *more: Column) -> DataFrame:
    """How many spans of each base kind, the digest of the base spans and all spans."""
    counts = [F.size(f"{prefix}{k}").cast("long").alias(f"n_{k}") for k in kinds]
    return docs.select("doc_id", *counts, F.sha2(spans.said(F.col(f"{prefix}base")), 256).alias("base_sha256"), spans.said(F.col(f"{prefix}spans")).alias("spans"), *more)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _counted(pii.personal_data(docs), pii.BASE, "pii_", joined(F.transform("pii_spans.score", lambda s: s.cast("string"))).alias("scores"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _counted(secret_scan.secrets(docs), secret_scan.BASE, "secret_")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


RULES = [urls.Rule(*x) for x in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES)


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(table(spark, sf_dir, "documents")).drop("removed")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    weights = toxicity.fit(docs, labels)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.scores(F.col("text"), weights, spark).alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 16)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mining.quantised(table(spark, sf_dir, "embeddings"), "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), byte_tokenizer(), piece_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_language, op3_quality, op4_decontaminate, op5_pii, op6_urls, op7_simhash, op8_chunks, op9_toxicity, op10_secrets, op11_sharding, op12_hard_negatives, op13_alignment)
}
WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: SQL where it can express a whole result: windows joined by their text, for each length of window.
ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": f"""WITH b AS (SELECT item_id::VARCHAR AS item, {WORDS_SQL} AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS x FROM b WHERE len(w) > 0),
 d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM bw),
 places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
 h AS (SELECT r, i, p.n AS n, item FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM places) p JOIN bw USING (n, x)),
 hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
 it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op12_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
 QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3""",
}
