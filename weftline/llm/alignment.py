"""Cross-tokenizer alignment: which tokens of two tokenizers overlap, and how often each pair of ids does corpus-wide.

A is a byte-level BPE over a space and the text, B a SentencePiece BPE of the text, which adds the space.  Each Arrow
partition is worked off in slices of whole texts:

1. texts are cut before every single space or line feed that stands between two other characters.  No token of either
   tokenizer crosses such a place (checked when the files are loaded), so equal segments are tokenised once a slice;
2. DuckDB holds the token intervals of the distinct segments as tables over one byte axis.  Two ASOF joins find, for
   each token, the other side's token in which it starts: an overlap begins where one of its two tokens begins, so these
   are all links.  Window sums over common starts number the groups; joins with the places of the segments give the
   numbers of each text, and the id pairs that it holds with how often;
3. a slice keeps its texts' pairs as places in the slice's own list of pairs, and counts in how many texts each occurs.

Spark sums these partial counts, finds the highest count of each A id, and hands every slice the counts of its own
pairs (rows grow with the slices' distinct pairs, not with the links); a last pass adds them up for each text.

Defined results: null and empty texts, and those whose joined token bytes differ from the space and the text, have no
tokens: zeros and an empty ``groups_sha256``.  Each row is worked on by itself, so null and repeated ids keep their
rows; columns other than the id and the text are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialised

#: Texts are cut before a single space or line feed between two characters that are no white space.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: What keeps a text from being cut before every space and line feed.
UNEVEN = re.compile(r"\s\s|[^\S \n]|\s\Z|\0")
#: Segments that may follow one another in a text.
INNER = re.compile(r"[ \n]\S(?s:.*)(?<=\S)")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: An id pair as one number: the id of A times this, plus that of B.
SHIFT = 1 << 32


class Tokenizers:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, byte_json: str, piece_model: str):
        import sentencepiece
        import tiktoken

        with open(byte_json, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("A must be a plain byte-level BPE")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        vocabulary = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if byte_of.keys() >= set(t)}
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {t: i for t, i in vocabulary.items() if i not in special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        if [spec["model"]["vocab"][m] for m in merges] != [*range(256, 256 + len(merges))]:
            raise ValueError("ids of A must follow its merges")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # what ByteLevel cuts by
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t

        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        ordinary = [p for i, p in enumerate(pieces) if not sp.is_byte(i)]
        if any("\n" in p or re.search("[^▁]▁", p) for p in ordinary):
            raise ValueError("a piece of B crosses a place where texts are cut")
        if len(self.b.encode("\n")) != 2:  # a space of its own and the line feed's byte, which joins with nothing
            raise ValueError("B must write a line feed as a byte")
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode_a(self, segments: list[str], size: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids in a row, and how many each segment (of ``size`` bytes) has; the first ``inner`` ones as one text."""
        ids = np.asarray(self.a.encode_to_numpy("".join(segments[:inner]), disallowed_special=()), np.int64)
        last = np.searchsorted(np.cumsum(self.a_size[ids]), np.cumsum(size[:inner]))
        alone = [self.a.encode_ordinary(x) for x in segments[inner:]]
        rest = np.fromiter(chain.from_iterable(alone), np.int64)
        return np.concatenate([ids, rest]), np.concatenate([np.diff(last + 1, prepend=0), [*map(len, alone)]]).astype(np.int64)

    def encode_b(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B puts a space in front: in place of the segment's own, else before a line feed, where it is taken off again."""
        said = [x[1:] if x[0] == " " else x for x in segments]
        ids = [x if y[0] == " " else x[1:] for x, y in zip(self.b.encode(said, num_threads=1), segments, strict=True)] if said else []
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([*map(len, ids)], np.int64)

    def agree(self, said: list[bytes], ids: np.ndarray, n: np.ndarray, of: list[bytes]) -> np.ndarray:
        """For each segment, whether the bytes of its tokens (``of``) are the segment's."""
        parts = [of[i] for i in ids.tolist()]
        sizes = np.array([*map(len, parts)], np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        if b"".join(parts) == b"".join(said) and (np.diff(np.concatenate([[0], np.cumsum(sizes)])[starts]) == [*map(len, said)]).all():
            return np.ones(len(said), bool)
        return np.array([b"".join(parts[x:y]) == z for x, y, z in zip(starts[:-1], starts[1:], said, strict=True)], bool)


@lru_cache(maxsize=2)
def tokenizers(byte_json: str, piece_model: str) -> Tokenizers:
    return Tokenizers(byte_json, piece_model)


#: From the token intervals ``a`` and ``b`` (segment, start, end, id) and the places of segments in texts: the other
#: side's token at each start, the links of each segment, and the tokens of both sides numbered by groups.
STEPS = """
CREATE TEMP TABLE at_a AS SELECT a.seg, a.s, a.id AS aid, b.id AS bid, a.s = b.s AS same FROM a ASOF JOIN b ON a.s >= b.s;
CREATE TEMP TABLE at_b AS SELECT b.seg, b.s, a.id AS aid, b.id AS bid, a.s = b.s AS same FROM b ASOF JOIN a ON b.s >= a.s;
CREATE TEMP TABLE links AS SELECT seg, aid::BIGINT * 4294967296 + bid AS pair, count(*)::INT AS n
 FROM (SELECT seg, aid, bid FROM at_a UNION ALL SELECT seg, aid, bid FROM at_b WHERE NOT same) GROUP BY ALL;
CREATE TEMP TABLE grouped AS
 SELECT seg, s, aid AS id, 0 AS side, same, sum(same::INT) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM at_a
 UNION ALL SELECT seg, s, bid, 1, same, sum(same::INT) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) FROM at_b"""
#: Tokens as they are written down.
WRITTEN = "SELECT seg, id, side, same FROM grouped ORDER BY g, side, s"
PAIRS = "SELECT doc, pair, sum(n)::BIGINT AS n FROM place JOIN links USING (seg) GROUP BY ALL ORDER BY doc"


class Numbers(dict):
    """Numbers given to keys as they first come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def segmented(text: str) -> list[str]:
    """The segments of a space and the text."""
    if UNEVEN.search(text) or text[:1].isspace():
        return CUT.split(" " + text)
    return (" " + text.replace(" ", "\0 ").replace("\n", "\0\n")).split("\0")


def _intervals(ids: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> pa.Table:
    size = sizes[ids]
    return pa.table({"seg": np.repeat(np.arange(len(n), dtype=np.int32), n), "s": np.cumsum(size) - size, "id": ids.astype(np.int32)})


def _written(seg: np.ndarray, ids: np.ndarray, side: np.ndarray, same: np.ndarray) -> dict[int, str]:
    """``a1,a2|b1;a3|b2,b3`` of each segment, from its tokens in order."""
    new = np.concatenate([[True], seg[1:] != seg[:-1]])
    before = np.where(new, 0, np.where(~same, 3, np.where(side == 1, 2, 1))).tolist()
    text = "".join([f"{' ;|,'[m]}{i}" for m, i in zip(before, ids.tolist(), strict=True)])
    return dict(zip(seg[new].tolist(), text.split(" ")[1:], strict=True))


def aligned_slice(texts: list[str | None], both: Tokenizers) -> dict:
    """The numbers of each text, and its id pairs as places in ``pairs``.

    ``first``: where each text's entries of ``place`` and ``times`` begin (and where the last ends).
    """
    import duckdb

    known = Numbers()
    split = [list(map(known.__getitem__, segmented(t))) if t else [] for t in texts]
    inner = [bool(INNER.fullmatch(x)) for x in known]
    order = np.argsort(~np.array(inner, bool), kind="stable")  # those that may be encoded as one text stand first
    place_of = np.empty_like(order)
    place_of[order] = np.arange(len(order))
    segments = list(known)
    segments = [segments[k] for k in order.tolist()]
    bytes_of = [x.encode("utf-8", "surrogatepass") for x in segments]
    a = both.encode_a(segments, np.array([*map(len, bytes_of)], np.int64), sum(inner))
    b = both.encode_b(segments)
    fine = both.agree(bytes_of, *a, both.a_bytes) & both.agree(bytes_of, *b, both.b_bytes)
    if not fine.all():  # the texts that hold such a segment have no tokens
        a, b = ((ids[np.repeat(fine, n)], np.where(fine, n, 0)) for ids, n in (a, b))
        split = [x if fine[place_of[x]].all() else [] for x in split]

    lengths = np.array([len(x) for x in split], np.int64)
    total = int(lengths.sum())
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS} | {"groups_sha256": [""] * len(texts)}
    if not total:
        return out | {"first": np.zeros(len(texts) + 1, np.int64), "place": np.zeros(0, np.int32), "times": np.zeros(0, np.int64), "pairs": np.zeros(0, np.int64)}
    flat = place_of[np.fromiter(chain.from_iterable(split), np.int64, total)].astype(np.int32)
    n = len(segments)
    del split, known, segments, bytes_of, inner
    place = pa.table({"doc": np.repeat(np.arange(len(texts), dtype=np.int32), lengths), "seg": flat})
    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": spill}) as db:
        for name, rows in (("a", _intervals(*a, both.a_size)), ("b", _intervals(*b, both.b_size)), ("place", place)):
            db.register(name, rows)
        db.execute(STEPS)
        seg, ids, side, same = db.execute(WRITTEN).fetchnumpy().values()
        linked, links = db.execute("SELECT seg, n FROM links").fetchnumpy().values()
        doc, pair, times = db.execute(PAIRS).fetchnumpy().values()
    some, ends = np.flatnonzero(lengths), np.cumsum(lengths)
    each = {"n_a": np.bincount(seg[side == 0], minlength=n), "n_b": np.bincount(seg[side == 1], minlength=n)}
    each |= {"n_groups": np.bincount(seg[(side == 0) & same], minlength=n), "n_links": np.bincount(linked, links, n).astype(np.int64)}
    for c in COUNTS:
        out[c][some] = np.add.reduceat(each[c][flat], (ends - lengths)[some])
    said, at = _written(seg, ids, side, same), flat.tolist()
    for k in some.tolist():
        out["groups_sha256"][k] = hashlib.sha256(";".join(map(said.__getitem__, at[ends[k] - lengths[k] : ends[k]])).encode()).hexdigest()
    pairs, where = np.unique(pair, return_inverse=True)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return out | {"first": first, "place": where.astype(np.int32), "times": np.asarray(times, np.int64), "pairs": pairs}


def _slices(texts: list[str | None], chars: int) -> Iterator[range]:
    """Ranges of whole texts of about so many characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield range(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def aligned(docs: DataFrame, byte_json: str, piece_model: str, *, slice_chars: int = 6_000_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs`` (doc_id, text).

    ``n_best``: links whose pair is held by as many texts as any pair of its A id.  ``count_sum``: the number of texts
    that hold the link's pair, summed over the links.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = (
        f"slice string, doc_id array<{id_type}>, {', '.join(f'{c} array<bigint>' for c in COUNTS)}, groups_sha256 array<string>,"
        " first binary, place binary, times binary, pairs array<bigint>, n_texts array<bigint>"
    )

    def per_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, n = tokenizers(byte_json, piece_model), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _slices(texts, slice_chars):
                x = aligned_slice(texts[part.start : part.stop], both)
                ids = batch.column(0).slice(part.start, len(part))
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                raw = lambda values: pa.array([values.tobytes()], pa.binary())
                columns = [pa.array([f"{task}-{n}"]), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids)]
                columns += [one(x[c], pa.int64()) for c in COUNTS] + [one(x["groups_sha256"], pa.string())]
                columns += [raw(x[c]) for c in ("first", "place", "times")]
                columns += [one(x["pairs"], pa.int64()), one(np.bincount(x["place"], minlength=len(x["pairs"])), pa.int64())]
                n += 1
                yield pa.RecordBatch.from_arrays(columns, ["slice", "doc_id", *COUNTS, "groups_sha256", "first", "place", "times", "pairs", "n_texts"])

    slices = materialised(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(per_slice, made))
    counted = slices.select(F.explode(F.arrays_zip("pairs", "n_texts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_texts").alias("n"))
    counted = materialised(counted.withColumn("a", F.expr(f"pair div {SHIFT}")))
    best = counted.groupBy("a").agg(F.max("n").alias("most"))
    judged = counted.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = slices.select("slice", F.explode("pairs").alias("pair")).join(judged, "pair")
    known = known.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("k")).select("slice", F.col("k.n").alias("n"), F.col("k.best").alias("best"))

    per_text = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    result = ", ".join(f"{c} {id_type if c == 'doc_id' else 'string' if c == 'groups_sha256' else 'bigint'}" for c in per_text)

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                first, place, times = (np.frombuffer(row[c].as_py(), kind) for c, kind in (("first", np.int64), ("place", np.int32), ("times", np.int64)))
                n, best = (np.asarray(row[c].values) if row[c].is_valid else np.zeros(0, np.int64) for c in ("n", "best"))
                added = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[first])
                sums = {"n_best": pa.array(added(times * best[place])), "count_sum": pa.array(added(times * n[place]))}
                yield pa.RecordBatch.from_arrays([sums[c] if c in sums else row[c].values for c in per_text], list(per_text))

    return slices.drop("pairs", "n_texts").join(known, "slice", "left").mapInArrow(per_row, result)
