"""The near-duplicate stage of the corpus pipeline against brute force."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import pieces, simhash
from weftline.llm.queries import piece_model


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(s, t):
    x, y = shingles(s), shingles(t)
    return x == y or 10 * len(x & y) >= 8 * len(x | y)


def test_one_row_of_each_group_of_near_copies(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    rows = []
    for base in range(12):
        words = [word() for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 3, 4, 5, 8, 12):  # similarities from 0.95 down to 0.5
            w = list(words)
            for k in rnd.sample(range(5, 195), edits):
                w[k] = "edited" + word()
            rows.append((len(rows), " ".join(w)))
    rows += [(0, rows[0][1]), (0, "same id, another text altogether"), (None, rows[8][1]), (None, "only null ids hold this"), (None, "Only null  ids hold this"), (500, None), (501, " "), (502, "two words"), (503, "two words")]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and alike(rows[a][1], rows[b][1]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root[k], []).append(i)
    want = sorted((min((i for i in g if i is not None), default=-1) for g in groups.values()))
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "").collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == want
    assert len(got) < len(rows) - 50


def test_near_copies_that_stay_apart_make_no_row_for_each_pair(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    words = [word() for _ in range(200)]

    def edited(w, k):
        return [word() + "x" if i in at else x for at in [set(rnd.sample(range(200), k))] for i, x in enumerate(w)]

    copies = [edited(words, 4) for _ in range(400)]  # two of them have a similarity of about 0.7
    copies += [edited(w, 1) for w in copies[:40]] + [edited(w, 2) for w in copies[:20]]
    rows = [(k, " ".join(w)) for k, w in enumerate(copies)]
    root = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    written = []
    real = simhash.materialised

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialised", counted)
    marked, found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    groups = {}
    for r in marked.join(found, "__row").collect():
        groups.setdefault(r["__component"], set()).add(r.doc_id)
    want = {}
    for k, r in enumerate(root):
        want.setdefault(r, set()).add(k)
    assert sorted(map(min, groups.values())) == sorted(want) and sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert len(want) > 300 and max(written) <= 24 * len(rows)  # there are 105,570 pairs


def test_pieces_are_made_from_arrow_slices(spark):
    coded = pieces.round_trip(F.col("text"), piece_model(), at_once=3)
    texts = [None, "", "one two", "中文🙂 ï", *(f"row {k} of\nmany" for k in range(20))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").coalesce(1).select("k", "text", coded.alias("p"))
    # 251: over Arrow arrays; a pandas UDF holds all texts of a batch as Python strings
    assert re.search(r"ArrowEvalPython .*, 251\n", df._jdf.queryExecution().executedPlan().toString())
    c = pieces.coder(piece_model())
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.p.ids) == c.library.encode(r.text or "") and r.p.text == (r.text or "")
