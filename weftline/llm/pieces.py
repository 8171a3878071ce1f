"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

``PieceCoder`` reads a BPE model once per Python worker.  A text becomes pieces in these steps:

1. spaces turn into U+2581 and one is put in front, as the model's (identity) normaliser does;
2. the text is cut before every U+2581 that follows another character.  No piece of the vocabulary crosses such a
   place (checked when the model is loaded), so merges cannot either, and each distinct segment is encoded once and
   kept in a bounded memo;
3. in a segment an Aho-Corasick pass gives the longest piece at each position.  The encoder walks from left to right,
   takes the longest piece that may follow the piece before it, falls back to shorter ones, and when none fits marks
   the position as failed in a bitfield and steps back.  Two pieces may be neighbours if merging their joined
   characters from scratch gives just these two again;
4. characters outside the vocabulary stand alone and become byte pieces.

Defined results: a null text counts as empty; an empty text has no pieces and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
NEVER = float("-inf")
#: No piece; and the bits that an id takes in the number of a pair of ids.
NONE, PAIR = -1, 20
#: Places inside a segment where it is cut once more, as long as no piece of the vocabulary holds such a place.
CUT = "(?<=[A-Za-z\u00c0-\u00ff])(?=[\\n.,:;!?|*&%$#\"()'-])|(?<=\\n)(?=.)"
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Memo(dict):
    """Made values by text, of bounded size: two generations, the older dropped when the younger is full."""

    def __init__(self, make, entries: int, chars: int | None = None):
        super().__init__()
        self.make, self.entries, self.chars, self.older = make, entries, chars, {}

    def __missing__(self, key: str):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if self.chars is None or len(key) <= self.chars:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceCoder:
    def __init__(self, model_path: str, memo_entries: int = 200_000):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)
        self.piece_id = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not special(i)}
        self.score = {p: sp.get_score(i) for p, i in self.piece_id.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(c not in self.piece_id for p in self.piece_id for c in p):
            raise ValueError("a piece has a character that is no piece itself")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece_id):
            raise ValueError("a piece crosses a word boundary")
        self.piece = {i: p for p, i in self.piece_id.items()}
        self.size = [len(self.piece.get(i, "")) for i in range(sp.vocab_size())]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.piece_id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.stems = re.compile(CUT) if not any(re.search(CUT, p) for p in self.piece_id) else re.compile("(?!)")
        self.fits = Memo(lambda pair: self._fits(self.piece.get(pair >> PAIR, ""), self.piece[pair & (1 << PAIR) - 1]), 1 << 18)
        self.history: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        self.prefix = Memo(self._shorter, len(self.piece_id))
        self.known = set("".join(self.piece_id))
        self.said = [str(i) for i in range(sp.vocab_size())]
        self.stem = Memo(lambda x: tuple(self.encode_stem(x)), memo_entries, 64)
        self.segment = Memo(self.encode_segment, memo_entries, 64)

    def merges(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How the piece's characters merge when they stand alone, the best score first and the leftmost among equals.

        Before merge k (and after the last): the score of that merge (minus infinity: none), the first part, the last
        part.  None if the merges do not end in the piece itself.
        """
        if piece in self.history:
            return self.history[piece]
        parts, scores, first, last = list(piece), [], [], []
        while True:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1], NEVER)
                if s > best:
                    best, at = s, k
            scores.append(best)
            first.append(parts[0])
            last.append(parts[-1])
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.history[piece] = (scores, first, last) if len(parts) == 1 else None
        return self.history[piece]

    def _fits(self, left: str, right: str) -> bool:
        """Whether re-merging the joined characters leaves these two: no merge across the border may come first."""
        b = self.merges(right)
        if not left or b is None:
            return b is not None
        a = self.merges(left)
        i = j = 0
        while True:
            across, in_left, in_right = self.score.get(a[2][i] + b[1][j], NEVER), a[0][i], b[0][j]
            if across > in_left and across >= in_right and across > NEVER:
                return False
            if in_left == in_right == NEVER:
                return True
            if in_left >= in_right:
                i += 1
            else:
                j += 1

    def _shorter(self, i: int) -> int:
        """The longest piece that is a proper prefix, or NONE."""
        piece = self.piece[i]
        return next((self.piece_id[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.piece_id), NONE)

    def split(self, run: str) -> list[int]:
        """The pieces of a run of known characters: the longest at each place if they may be neighbours, else by backtracking.

        Pieces that cover the run and may each follow the one before are its encoding: there is only one such row.
        """
        fits, size = self.fits, self.size
        out, n, before = [], 0, NONE
        for _, i in self.automaton.iter_long(run):
            if not fits[before << PAIR | i]:
                return self.backtracked(run, out, n)
            out.append(i)
            n += size[i]
            before = i
        return out if n == len(run) else self.backtracked(run, [], 0)

    def backtracked(self, run: str, out: list[int], at: int) -> list[int]:
        """The pieces of a run of which ``out``, up to ``at``, are the longest in turn and may be neighbours."""
        fits, shorter, size = self.fits, self.prefix, self.size
        n = len(run)
        longest = [NONE] * n
        for end, i in self.automaton.iter(run):  # ends ascend: of one start, the last match is the longest
            longest[end - size[i] + 1] = i
        failed = bytearray(n // 8 + 1)
        before, i, clean = out[-1] if out else NONE, longest[at], True
        while at < n:
            while i >= 0:
                end = at + size[i]
                if (clean or not failed[end >> 3] >> (end & 7) & 1) and fits[before << PAIR | i]:
                    break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, before = end, i
                i = longest[at] if at < n else NONE
            else:
                failed[at >> 3] |= 1 << (at & 7)
                clean = False
                i = out.pop()
                at -= size[i]
                before = out[-1] if out else NONE
        return out

    def encode_stem(self, stem: str) -> list[int]:
        """A stretch of text without inner cut: known characters by backtracking, each other one as its bytes."""
        if self.known.issuperset(stem):
            return self.split(stem)
        ids: list[int] = []
        run = ""
        for c in stem:
            if c in self.known:
                run += c
                continue
            ids += self.split(run) if run else []
            ids += (self.byte_id[b] for b in c.encode())
            run = ""
        return ids + (self.split(run) if run else [])

    def encode_segment(self, segment: str) -> tuple[int, ...]:
        """The ids.  Tuples of numbers, so that the garbage collector need not track them."""
        stems = [self.stem[x] for x in self.stems.split(segment)]
        return stems[0] if len(stems) == 1 else tuple(chain.from_iterable(stems))

    def encode(self, text: str | None) -> list[int]:
        segment = self.segment
        return list(chain.from_iterable([segment[s] for s in self.segments.findall(SPACE + text.replace(" ", SPACE))])) if text else []

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text and of the decoded text."""
        ids, names = self.encode(text), self.said
        said = ",".join([names[i] for i in ids])
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@lru_cache(maxsize=2)
def coder(model_path: str) -> PieceCoder:
    """One per Python worker.  Its memos hold many small tuples, no cycles: the collector passes over them rarely."""
    import gc

    gc.set_threshold(100_000, 50, 1_000)
    return PieceCoder(model_path)


def encode_digests(text: Column, model_path: str) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>`` of each whole text."""

    @F.pandas_udf(RESULT)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(model_path)
        for texts in batches:
            yield pd.DataFrame([c.digests(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def encode_ids(text: Column, model_path: str) -> Column:
    """The ids of each whole text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(model_path)
        for texts in batches:
            yield pd.Series([c.encode(t) for t in texts], dtype=object)

    return ids(text)


def decode_ids(ids: Column, model_path: str) -> Column:
    """The text of each array of ids; null counts as empty."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(model_path)
        for rows in batches:
            yield pd.Series([c.decode([int(i) for i in r]) if r is not None and len(r) else "" for r in rows], dtype=object)

    return text(ids)


def round_trip(text: Column, model_path: str, at_once: int = 500) -> Column:
    """``struct<ids, text>``: the ids of each whole text and what they decode to, in one pass with few rows in memory.

    As one stage of several in a session, it gives its coder back with the partition: workers that wait would hold it.
    """

    @F.arrow_udf("ids array<int>, text string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import gc

        c = PieceCoder(model_path, memo_entries=40_000)
        for texts in batches:
            for k in range(0, len(texts), at_once):
                ids = [c.encode(t) for t in texts.slice(k, at_once).to_pylist()]
                said = pa.array([c.decode(x) for x in ids], pa.string())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), said], ["ids", "text"])
        del c
        gc.collect()  # its memos refer to it

    return both(text)
