"""Cross-tokenizer alignment against a plain walk over the tokens of both libraries."""

import hashlib
import json
import random
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from weftline.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@lru_cache
def libraries():
    import sentencepiece

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, {i: x for x, i in json.load(open(A))["model"]["vocab"].items()}, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """(id, bytes) of both sides, by the libraries alone."""
    t, name, sp = libraries()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a = [(i, bytes(byte_of[c] for c in name[i])) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plainly(texts):
    rows, held = [], []
    for t in texts:
        a, b = map(spans, tokens(t) if t else ([], []))
        links = Counter((i, j) for i, s, e in a for j, u, v in b if s < v and u < e)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= c) for side in (a, b)))
            low = c
        rows.append((len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        held.append(links)
    n = Counter(p for links in held for p in links)
    most = defaultdict(int)
    for (i, _), k in n.items():
        most[i] = max(most[i], k)
    return [(*r[:4], sum(k for p, k in links.items() if n[p] == most[p[0]]), sum(k * n[p] for p, k in links.items()), r[4]) for r, links in zip(rows, held, strict=True)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    odd = [None, "", " ", "\n", "  two  blanks ", "tab\tand nbsp", "▁ is a space to B", "<|endoftext|> <s></s> <0x0A>", "don't we'll 'tis", "a\n\nb\n c\r\nd\x1ce", "x.\nThou ,.-", "中文🙂 ï\u0000 null", "end\n", "\nstart", "aab" * 300, " ñ é ×. ÷1", "it 's"]
    for _ in range(60):
        odd.append("".join(rnd.choice("abcthe  \n\n.,'s1é▁🙂\t" if rnd.random() < 0.2 else "abcthe  \n.,'s1é") for _ in range(rnd.randint(1, 60))))
    return odd + odd[5:9] + ["the same words again and again " * 20] * 3


def test_equals_a_plain_walk(spark, texts):
    rows = [(k if k % 9 else None, t, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    got = alignment.aligned(df, A, B, slice_chars=200).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, plainly(texts), strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_one_slice_equals_many(spark, texts):
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    one, many = (sorted(map(tuple, alignment.aligned(df, A, B, slice_chars=n).collect())) for n in (1, 10**9))
    assert one == many


def test_segments_are_tokenised_as_in_their_texts():
    rnd = random.Random(5)
    both = alignment.tokenizers(A, B)
    for _ in range(200):
        text = "".join(rnd.choice(" \n\n  ab.'T,é") for _ in range(30))
        assert "".join(alignment.segmented(text)) == " " + text
        assert alignment.segmented(text) == alignment.CUT.split(" " + text)
        x = alignment.aligned_slice([text], both)
        a, b = tokens(text)
        assert (x["n_a"][0], x["n_b"][0]) == (len(a), len(b))


def test_long_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x" * 120_000), (2, "word " * 60_000), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in alignment.aligned(df, A, B).collect()}
    assert got[1].n_groups > 0 and got[2].n_groups == got[2].n_links and got[3].n_a == 0 and got[3].groups_sha256 == ""
    assert alignment.aligned(df.limit(0), A, B).count() == 0
