"""The training-data operators against brute force on small fixtures, and their defined edge cases."""

import hashlib
import inspect
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import chunks, decontaminate, language, pieces, pii, quality, secret_scan, simhash, spans, toxicity, urls
from weftline.llm.queries import RULES, piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q_n_words string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    out = [None, "", " \n\t ", "one", "x " * 400, "a b c d " * 60 + "\nline\nline\n \nline", "word " * 30_000]
    for _ in range(80):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 150))]
        out.append("".join(w + rnd.choice([" ", " ", ", ", "\n", "#* "]) for w in words))
    out += out[10:14]  # repeated texts
    near = out[20].split()
    for k in range(6):
        out.append(" ".join([*near[:k], "changed", *near[k + 1 :]]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k != 3 else None, t, None, None, None, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_pieces_equal_the_library(docs, texts):
    c = pieces.coder(piece_model())
    odd = [*texts, "▁a ▁", "<s> </s> <0x0A>", "中文🙂 \u0000 ï", "aab" * 2_000, "  two  blanks "]
    for t in odd:
        assert c.encode(t) == c.library.encode(t or "")
    for n in range(300):
        t = "".join(random.Random(n).choice("ab ▁\nthe,.é0") for _ in range(40))
        assert c.encode(t) == c.library.encode(t)
    got = docs.select("text", pieces.encode_digests(F.col("text"), piece_model()).alias("p")).collect()
    for r in got:
        ids = c.library.encode(r.text or "")
        assert r.p.n_tokens == len(ids)
        assert r.p.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.p.decoded_sha256 == hashlib.sha256(c.library.decode(ids).encode() if ids else b"").hexdigest()


def test_longest_pieces_that_fit_are_not_walked_again(monkeypatch):
    c = pieces.PieceCoder(piece_model())
    walked, was = [], c.backtracked
    monkeypatch.setattr(c, "backtracked", lambda run, out, at: walked.append((run, at)) or was(run, out, at))
    words = ["▁the", "▁nation", "▁whereas", "▁idiotic", "▁erblehwh", "▁thonreaner", "▁queñ", "▁aab" * 5, "▁unhappinessly"]
    for w in words:
        assert c.split(w) == c.library.encode(w[1:])  # it puts the first sign there itself
    assert ("▁the", 0) not in walked and len(walked) < len(words)
    # an entry of the memos is the ids alone
    assert c.encode("the nation, the end") == c.library.encode("the nation, the end")
    assert all(type(i) is int for memo in (c.stem, c.segment) for ids in memo.values() for i in ids)


def test_quality_counts(docs, spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.judged(docs.select("doc_id", "text"), labels, prefix="").collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = split(r.text)
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        twice = {j for v in at.values() if len(v) > 1 for k in v for j in (k, k + 1, k + 2)}
        lines = [x for x in (r.text or "").split("\n") if split(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in r.text or ""), len(lines) - len(set(lines)), len(twice))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_by_language_with_held_out_thresholds(spark):
    """Two languages, one with few documents: junk goes, and of good documents that were held out nearly all stay."""
    rnd = random.Random(8)
    vocabulary = {"aa": ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(150)], "bb": ["".join(rnd.choice("mnopqrst") for _ in range(5)) for _ in range(150)]}
    junk = ["%%%", "|||", "$1", "zzz", "###", "click", "buy"]
    rows, labels = [], []
    for k in range(900):
        lang, bad = "bb" if k % 7 == 0 else "aa", k % 5 == 0
        rows.append((k, " ".join(rnd.choice(junk if bad and rnd.random() < 0.6 else vocabulary[lang]) for _ in range(80)), lang))
        labels += [(k, int(not bad))] if k % 2 else []
    rows += [(900, rows[1][1], None), (901, rows[1][1], "cc"), (902, None, "aa"), (None, rows[1][1], "aa")]
    df, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(df, known, prefix="").collect()}
    assert len(got) == len(rows)
    for lang in ("aa", "bb"):
        bad = [got[k].kept for k in range(0, 900, 5) if rows[k][2] == lang and not got[k].base_failed]
        good = [got[k].kept for k in range(900) if k % 5 and rows[k][2] == lang and not got[k].base_failed]
        assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.9 * len(good)
    assert got[None].kept and not got[902].kept and got[902].score == 0
    alone = quality.judged(df.drop("lang"), known.where("false"), prefix="").collect()
    assert all(r.kept and r.score == 0 for r in alone if not r.base_failed)


@pytest.mark.parametrize("slice_windows", [1 << 20, 12])
def test_decontamination(spark, docs, texts, slice_windows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, " ".join(fold(texts[15])[3:17])), (2, "ONE"), (3, None), (4, " ".join(fold(texts[20]))), (5, ""), (1, "one two")]
    got = decontaminate.benchmark_hits(docs.where("doc_id is not null"), spark.createDataFrame(items, "item_id long, text string"), slice_windows=slice_windows).collect()
    assert len(got) == len(texts) - 1
    for r in got:
        w, hit, ids = fold(texts[r.doc_id]), set(), set()
        for i, t in items:
            x = fold(t)
            for k in range(max(1, len(x) - 9) if x else 0):
                win = x[k : k + 10]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit.update(range(a, a + len(win)))
                        ids.add(str(i))
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (len(w), len(hit), len(ids), sorted(ids))


def test_decontamination_judges_each_row_alone_with_slices_too(spark):
    rows = [(None, "one two three"), (None, "nothing here"), (None, "four five"), (7, "one two"), (7, "four five six"), (7, "clean"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "one two"), (2, "four five"), (2, "four five"), (3, "six")], "item_id long, text string")
    sliced, whole = (sorted((tuple(map(str, r)) for r in decontaminate.benchmark_hits(df, items, slice_windows=b).collect())) for b in (1, 1 << 20))
    assert len(sliced) == len(rows) and sliced == whole
    kept = [decontaminate.without_contaminated(df, items, slice_windows=b).collect() for b in (1, 1 << 20)]
    assert sorted(map(repr, kept[0])) == sorted(map(repr, kept[1])) and len(kept[0]) == 3
    assert [r[:4] for r in sliced if r[0] == "7"] == [("7", "1", "0", "0"), ("7", "2", "2", "1"), ("7", "3", "3", "2")]


def test_pii_spans(spark):
    t = ["mail a.b@c.de.x_y@d.org, 1.2.3.4.5.6.7.8 999.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "tel +49 (0)30 1234567 é +1 2", "é DE89370400440532013000 DE89370400440532013001", "ssn 123-45-6789 and 123-45-6789", None, "", "1" * 30_000 + "a" * 30_000 + "@"]
    rows = pii.personal_data(spark.createDataFrame([(k, x) for k, x in enumerate(t)], "doc_id long, text string")).collect()
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for r in rows:
        for kind, pattern in base.items() if r.doc_id < 7 else ():
            found = [m.span() for m in re.finditer(pattern, r.text or "") if kind != "ip" or all(int(x) <= 255 for x in m[0].split("."))]
            found = [x for x in found if kind != "phone" or 10 <= sum(ch.isdigit() for ch in r.text[x[0] : x[1]]) <= 15]
            assert [(s.start, s.stop) for s in r[f"pii_{kind}"]] == found
    assert [s.text for s in rows[1].pii_card] == ["4111 1111 1111 1111"]
    assert [(s.kind, s.start) for s in rows[3].pii_spans] == [("iban", 2)]
    assert len(rows[4].pii_ssn) == 2 and not rows[5].pii_spans and not rows[7].pii_email
    more = ["account DE89 3704 0044 0532 0130 00, version DE89370400440532013000", "number DE89370400440532013000", "x 1.2.3.4, " * 900 + "4111 1111 1111 1111", "ssn 123-45-6789", "order 123-45-6789"]
    judged = pii.personal_data(spark.createDataFrame([(k, x) for k, x in enumerate(more)], "doc_id long, text string"))
    far = judged.select("pii_spans", pii.redacted(F.col("text"), F.col("pii_spans")).alias("t")).collect()
    assert [(s.kind, s.start, s.stop, s.score) for s in far[0].pii_spans] == [("iban", 8, 35, 0.95)]  # context decides: the second is a version
    assert [(s.kind, s.score) for s in far[1].pii_spans] == [("iban", 0.6)]
    assert [(s.start, s.stop) for s in far[2].pii_spans if s.kind == "ip"] == [(11 * k + 2, 11 * k + 9) for k in range(900)]
    assert far[2].t == "x [ip], " * 900 + "[card]" and [len(r.pii_spans) for r in far[3:]] == [1, 0]
    hidden = pii.personal_data(spark.createDataFrame([(0, t[0])], "doc_id long, text string")).select(pii.redacted(F.col("text"), F.col("pii_spans"))).first()[0]
    assert hidden == "mail [email][email], [ip].[ip] 999.1.1.1"


def test_secrets(spark):
    rnd = random.Random(3)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    t = [f"some ordinary words and_identifiers here Password = '{noise(32)}' and more plain words" for _ in range(40)]
    lone, plain = noise(36) + "7q", "averyveryordinaryidentifierwithnumber2"
    t += [f"see {lone} there", f"see {plain} there", "AKIA" + "ABCDEFGH12345678", "hash 0123456789abcdef0", None, "password: short", ""]
    rows = secret_scan.secrets(spark.createDataFrame([(k, x) for k, x in enumerate(t)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(len(r.secret_assign) == 1 for r in rows[:40])
    assert [[s.kind for s in r.secret_spans] for r in rows[40:]] == [["random"], [], ["access"], ["hex"], [], [], []]
    s = spark.createDataFrame([(1, "x")], "a int, b string").select(spans.mod97(F.lit("GB82WEST12345698765432")).alias("m"), spans.luhn(F.lit("4111111111111111")).alias("l")).first()
    assert s.m == 1 and s.l


def test_simhash_components(docs, texts):
    got = simhash.near_duplicates(docs.select("doc_id", "text", "lang"), capacity=24).collect()
    assert len(got) == len(texts)
    fp = [r.fp & (1 << 64) - 1 for r in got]
    by_text = {t: simhash.fingerprint(t) for t in texts}
    assert sorted(fp) == sorted(by_text[t] for t in texts)
    root = list(range(len(fp)))
    for a, b in combinations(range(len(fp)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    ids = defaultdict(list)
    for k, r in enumerate(got):
        ids[root[k]].append(r.doc_id)
    for k, r in enumerate(got):
        assert r.component_id == min((i for i in ids[root[k]] if i is not None), default=None)


def test_gray_index_finds_all_links():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rnd.integers(0, 64, 60).astype(np.uint64)) for _ in range(8)), np.arange(40, dtype=np.uint64)]))
    want = {frozenset((int(a), int(b))) for a, b in combinations(values, 2) if int(a ^ b).bit_count() <= 4}
    index, cut = simhash.GrayIndex(values), len(values) // 3
    got = [(int(index.values[a]), int(index.values[b])) for x, y in index.pairs(index, simhash.exactly(4)) for a, b in zip(x, y, strict=True)]
    assert {frozenset(p) for p in got} == want and len(got) == len(want)
    left = sum(len(q) for q, _ in index.near(index, simhash.exactly(4)))
    assert left < (len(values) / index.LEAF) ** 2  # nodes rule out groups
    one, two = simhash.GrayIndex(values[:cut]), simhash.GrayIndex(values[cut:])
    across = {frozenset((int(one.values[a]), int(two.values[b]))) for x, y in one.pairs(two, simhash.exactly(4)) for a, b in zip(x, y, strict=True)}
    assert across == {p for p in want if len(p & set(map(int, values[:cut]))) == 1}


def test_votes_count_bits():
    h = np.random.default_rng(2).integers(0, 1 << 63, (1000, 3), dtype=np.uint64)
    for n in (0, 1, 2, 3, 7, 1000):
        assert (simhash.votes(h[:n]) == [[int((x >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for x in h[:n].T]).all()


def test_chunks_find_a_repeated_word_wherever_it_starts(spark):
    """A stretch of one word has no cut of its own or one per period; the fallback cut must not depend on what precedes it."""
    words = ("Der", "Edes", "menten", "Ofanwhon", "Üzu")
    rows = [(10 * k + j, f"{'x' * (3 + 7 * j)} start {j}. " + " ".join([w] * 60) + f". end {j * 31}") for k, w in enumerate(words) for j in range(2)]
    rows.append((99, "Nothing here is like any other text in this table, whatever words it may take to say so."))
    got = {r.doc_id: r.repeats for r in chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got.pop(99) and all(got.values())


def test_chunks_find_shared_passages(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    body = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, f"{body(30 + k)} {passage} {body(20)}" if k < 5 else body(80)) for k in range(20)] + [(20, None), (21, ""), (None, passage), (22, "é" * 5_000)]
    got = {r.doc_id: r for r in chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, r in got.items() if r.repeats and k is not None and k < 20] and {k for k, r in got.items() if r.repeats} == {*range(5), None}
    assert got[0].n_removed == 0 and got[1].n_removed > 0 and len(got) == len(rows)
    t = dict(rows)[1]
    cut = spark.createDataFrame([(t, got[1].removed)], "t string, r array<struct<start:int,stop:int>>").select(chunks.without(F.col("t"), F.col("r"))).first()[0]
    assert len(cut) == got[1].chars_kept and passage[40:-100] not in cut
    twice = [(1, passage), (1, "too short"), (1, passage), (2, f"{body(30)} {passage}"), (3, " ".join(passage.split()[:20]))]
    got = sorted((r.doc_id, r.n_shared > 0, r.n_removed > 0, r.chars_kept) for r in chunks.repeats(spark.createDataFrame(twice, "doc_id long, text string").repartition(3)).collect())
    assert [g[:3] for g in got] == [(1, False, False), (1, True, False), (1, True, True), (2, True, True), (3, False, False)]
    assert got[0][3] == 9 and got[1][3] == len(passage) and got[2][3] < 100  # each row by its own text


def test_chunks_recall_and_precision(spark):
    """Held against all windows of 51 words: planted passages are found, short shared phrases and clean texts are left alone."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(2, 9)))
    body = lambda n: [word() for _ in range(n)]
    passages, phrases = [body(rnd.randint(51, 70)) for _ in range(40)], [body(12) for _ in range(10)]
    rows = []
    for k in range(400):
        w = body(rnd.randint(60, 300))
        at = rnd.randrange(len(w))
        w[at:at] = passages[k % 40] if k < 160 else phrases[k % 10] if k < 280 else []
        rows.append((k, " ".join(w)))
    got = {r.doc_id for r in chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.repeats}
    assert len(got & set(range(160))) >= 158 and not got - set(range(160))


def test_language(spark):
    by = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "der schnelle braune fuchs springt über", "cc": "el zorro marrón salta sobre el perro"}
    rnd = random.Random(2)
    rows = [(k, None if n == 0 else " ".join(rnd.sample(by[k].split(), 5)), n) for k in by for n in range(30)]
    df = spark.createDataFrame(rows, "lang string, text string, n int")
    known = language.learn(df.where("n < 20"))
    got = df.where("n >= 20 or n = 0").select("lang", "text", language.predict(F.col("text"), known).alias("p")).collect()
    assert all(r.p.lang_pred == (r.lang if r.text else "und") and 0 <= r.p.score <= 1 for r in got)
    assert df.limit(1).select(language.predict(F.lit("123 !"), known).lang_pred).first()[0] == "und"
    assert df.limit(1).select(language.predict(F.lit("abc"), {}).lang_pred).first()[0] == "und"


def test_toxicity(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for k in range(400):
        w = [rnd.choice(vocabulary) for _ in range(60)]
        if k % 4 == 0:
            w[rnd.randrange(60)] = rnd.choice(["nasty", "vile"])
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 300").select("doc_id", "toxic"))
    got = df.where("doc_id >= 300").select("toxic", toxicity.scores(F.col("text"), model, spark).alias("s")).collect()
    assert sum((r.s >= 0.3) == bool(r.toxic) for r in got) >= 0.9 * len(got)
    none = toxicity.fit(df.select("doc_id", "text"), df.where("toxic = 0").select("doc_id", "toxic"))
    assert df.limit(1).select(toxicity.scores(F.lit(None).cast("string"), none, spark)).first()[0] == 0


def test_toxicity_learns_with_all_rounds_and_bits_from_sparse_state(spark, monkeypatch):
    """The defaults are the whole training; a round's broadcast holds the coordinates learnt so far, no more."""
    sent = []
    put = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or put(self, value))
    df = spark.createDataFrame([(k, f"{'nasty' if k % 2 else 'kind'} word{k % 5} text", k % 2) for k in range(40)], "doc_id long, text string, toxic int")
    toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(sent) == 9 and all(len(x) == 3 for x in sent)  # eight rounds, and the model for its calibration
    sent.pop()
    assert len(sent[0][0]) == 0 and 0 < len(sent[-1][0]) < 100 and all(np.all(n > 0) for _, _, n in sent)
    assert max(int(k.max()) for k, _, _ in sent[1:]) == 1 << 20  # the bias
    assert inspect.signature(toxicity.fit).parameters["sample_docs"].default == 6_000
    assert inspect.signature(toxicity.scores).parameters["bits"].default == 20


def test_urls(spark):
    rows = [(1, "http://A.com/x?y", "<p>"), (2, "https://en.example.com/en/1#f", None), (3, "http://www.example.com/en/", ""), (4, "no scheme", ""), (5, None, None), (6, "x://bad.net/fr/a", '<a href="/rel">'), (7, "x://bad.net/de/", ""), (8, "x://friend.org/", '<a href=http://bad.net/de/> <a href="http://bad.net/">')]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, threshold=0.05).collect()}
    assert [got[k].rule for k in range(1, 9)] == ["com/", "example.com/en/", "www.example.com/en/", None, None, "net/fr/", None, None]
    assert [got[k].verdict for k in range(1, 9)] == ["allow", "block", "allow", "allow", "allow", "block", "block", "block"]
    assert (got[1].host, got[1].path, got[4].host, got[5].path) == ("a.com", "/x", "", "")


def test_urls_with_links_keep_one_scale(spark):
    """The default threshold on pages with links, and a link between other hosts, which changes no verdict and no score."""
    link = lambda *hosts: " ".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [(1, "x://bad.net/fr/a", ""), (2, "x://half.net/fr/a", ""), (3, "x://half.net/de/", ""), (4, "x://friend.org/", link("bad.net")), (5, "x://far.org/", link("friend.org"))]
    rows += [(6, "x://two.net/fr/", ""), (7, "x://p.org/", link("two.net")), (8, "x://q.org/", link("two.net", "three.net")), (9, "x://three.net/es/", ""), (10, "x://good.com/", link("fan.org")), (11, "x://fan.org/", link("three.net"))]
    judge = lambda r: {p.page_id: p for p in urls.judged(spark.createDataFrame(r, "page_id long, url string, html string"), RULES).collect()}
    got = judge(rows)
    assert [got[k].verdict for k in range(1, 12)] == ["block"] * 6 + ["allow", "block", "block", "allow", "allow"]
    assert [got[k].distrust for k in (1, 3, 4, 5, 7, 8, 11)] == pytest.approx([1, 0.5, 0.85, 0.85**2, 0.425, 0.85, 0.425])
    assert (got[10].trust, got[11].trust) == pytest.approx((1, 0.85))
    alone = [(k, u, "") for k, u, _ in rows]
    other = [(12, "x://one.org/", link("other.org"))]
    without, beside = judge(alone), judge(alone + other)
    assert {k: beside[k] for k in without} == without
    assert [without[k].verdict for k in (1, 2, 3)] == ["block"] * 3


def test_urls_against_plain_pagerank(spark):
    """Random links with hubs, cycles and dangling hosts: masses are proportional to a PageRank computed in plain Python."""
    rnd = random.Random(6)
    hosts = [f"h{k}.org" for k in range(12)] + ["a.com", "b.com", "bad.net"]
    links = {(s, d) for s in hosts[:10] for d in rnd.sample(hosts, 3) if s != d}
    rows = [(k, f"x://{s}/{'fr/' if s == 'bad.net' else ''}", " ".join(f"<a href=x://{d}/>" for t, d in sorted(links) if t == s)) for k, s in enumerate(hosts)]
    got = {r.host: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    for field, seeds, pairs in (("trust", ["a.com", "b.com"], links), ("distrust", ["bad.net"], {(d, s) for s, d in links})):
        jump = {h: (h in seeds) / len(seeds) for h in hosts}
        out = defaultdict(list)
        for s, d in pairs:
            out[s].append(d)
        rank = dict(jump)
        for _ in range(300):  # with dangling hosts returned to the seeds
            lost = sum(rank[h] for h in hosts if not out[h])
            step = {h: (0.15 + 0.85 * lost) * jump[h] for h in hosts}
            for s in hosts:
                for d in out[s]:
                    step[d] += 0.85 * rank[s] / len(out[s])
            rank = step
        factor = sum(getattr(got[h], field) for h in hosts) / sum(rank.values())
        assert [getattr(got[h], field) for h in hosts] == pytest.approx([factor * rank[h] for h in hosts], abs=1e-4)
    assert all(r.verdict == ("block" if r.rule == "net/fr/" or (r.rule is None and r.distrust >= 0.5 and r.distrust > r.trust) else "allow") for r in got.values())


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(none).count() == 0
    assert quality.judged(none.select("doc_id", "text"), labels).count() == 0
    assert decontaminate.benchmark_hits(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert pii.personal_data(none).count() == 0 and secret_scan.secrets(none).count() == 0
    assert chunks.repeats(none).count() == 0 and language.learn(none) == {}
    assert len(toxicity.fit(none, labels)[0]) == 0
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_toxicity_stems_take_unseen_endings():
    bits, rnd = 18, random.Random(5)
    word = lambda: "".join(rnd.choice("aeinrst") for _ in range(6))
    m = toxicity.Ftrl(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), 0.5, 1.0, 1.0, 0.0)
    for n in range(400):
        bad = n % 2
        body = " ".join([*(word() for _ in range(12)), f"vequ{word()}" if bad else word()])
        k, count = np.unique(np.concatenate(toxicity.features(body, bits)).astype(np.int64), return_counts=True)
        m.learn(np.append(k, 1 << bits), np.append(count, 1.0), bad)
    w = m.weights()
    top = lambda t: toxicity.window_sums(toxicity.features(t, bits), w[:-1], 24).max() + w[-1]
    clean = [" ".join(word() for _ in range(13)) for _ in range(50)]
    assert np.mean([top(f"{t} vequ{word()}") > 0 for t in clean]) > 0.9 and np.mean([top(t) > 0 for t in clean]) < 0.1


def test_toxicity_calibration_does_not_run_away():
    logit = np.array([-12.0] * 50 + [-4.0] * 50 + [-9.0] * 40 + [3.0] * 20)
    y = np.array([0.0] * 100 + [1.0] * 60)
    slope, shift = toxicity.calibrated(1 / (1 + np.exp(-logit)), y)
    q = 1 / (1 + np.exp(-(slope * logit + shift)))
    assert 0.1 <= slope < 2 and abs(q.sum() - y.sum()) < 2
    # and where whole steps led to a slope of thousands: far apart, with few labels that say otherwise
    logit = np.array([-20.0] * 300 + [-2.0] * 3 + [-6.0] * 200 + [5.0] * 100)
    y = np.array([0.0] * 303 + [1.0] * 300)
    slope, shift = toxicity.calibrated(1 / (1 + np.exp(-logit)), y)
    assert 0.1 <= slope < 5 and abs(shift) < 50
