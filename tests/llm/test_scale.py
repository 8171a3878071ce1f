"""Long texts, keepers of any id and samples of any size."""

import random
import time

from pyspark.sql import functions as F

from weftline.llm import chunks, pii, spans, toxicity


def test_stretches_of_a_text_taken_apart(spark):
    t = "aé🙂b" * 1500
    places = [(0, 0), (0, 1), (1023, 1025), (1024, 2048), (10, 5000), (5999, 6000), (6000, 6000), (3, 3)]
    df = spark.createDataFrame([(t, [{"a": a, "b": b} for a, b in places])], "t string, p array<struct<a:int,b:int>>")
    got = df.select(F.transform("p", lambda x: spans.stretch(spans.pieces(F.col("t")), x["a"], x["b"])).alias("x")).first().x
    assert got == [t[a:b] for a, b in places]


def test_redaction_is_linear(spark):
    n = 40_000
    df = spark.createDataFrame([(1, "mail a.b@c.org, " * n)], "doc_id long, text string")
    began = time.time()
    got = pii.personal_data(df).select(pii.redacted(F.col("text"), F.col("pii_spans")).alias("r"), F.size("pii_email").alias("n"), F.col("pii_email")[0]["score"].alias("s")).first()
    assert got.r == "mail [email], " * n and got.n == n and got.s == 1.0
    assert time.time() - began < 60  # a scan from the text's start for each span took minutes


def test_removal_of_many_stretches(spark):
    t = "".join(chr(97 + k % 26) for k in range(50_000))
    cut = [{"start": k, "stop": k + 3} for k in range(5, 49_000, 10)]
    df = spark.createDataFrame([(t, cut)], "t string, removed array<struct<start:int,stop:int>>")
    gone = {i for x in cut for i in range(x["start"], x["stop"])}
    assert df.select(chunks.without(F.col("t"), F.col("removed"))).first()[0] == "".join(c for i, c in enumerate(t) if i not in gone)


def test_the_smallest_id_keeps_whatever_its_type(spark):
    rnd = random.Random(8)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    for kind, ids, keeper in (("string", ["b", "a", "d", "c"], "a"), ("string", [None, "z", "y", None], "y"), ("long", [10, 9, 100, None], 9), ("string", [None, None], None)):
        df = spark.createDataFrame([(i, passage) for i in ids], f"doc_id {kind}, text string").repartition(3)
        got = [(r.doc_id, r.n_removed) for r in chunks.repeats(df).collect()]
        assert sum(n == 0 for _, n in got) == 1 and [i for i, n in got if n == 0] == [keeper]
    df = spark.createDataFrame([("a", passage), ("a", passage), ("a", passage)], "doc_id string, text string").repartition(3)
    assert sorted(r.n_removed > 0 for r in chunks.repeats(df).collect()) == [False, True, True]


def test_toxic_share_does_not_hang_on_the_sample(spark):
    rnd = random.Random(12)
    kind, mean = [f"word{k}" for k in range(300)], ["nasty", "vile", "awful", "stupid", "hate"]
    rows = []
    for k in range(3300):
        toxic = k % 10 == 0
        words = [rnd.choice(kind) for _ in range(20)]
        for _ in range(3 if toxic else rnd.random() < 0.1):
            words[rnd.randrange(20)] = rnd.choice(mean)
        rows.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    held = df.where("doc_id % 3 = 0")
    share = {}
    for n in (400, 6_000):
        model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id % 3 != 0").select("doc_id", "toxic"), sample_docs=n, rounds=3)
        got = held.select("toxic", toxicity.scores(F.col("text"), model, spark).alias("s")).collect()
        share[n] = sum(r.s >= 0.3 for r in got) / len(got), sum(r.s for r in got) / len(got)
    assert all(abs(mean - 0.1) < 0.05 and 0.06 < flagged < 0.16 for flagged, mean in share.values()), share
