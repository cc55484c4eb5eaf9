"""Token counts: a prefix table holds the exact number of tokens at every prefix of a text.

A text is cut into pieces by the tokenizer's own pattern; merges never cross a piece. In a piece of n bytes, the encoding of
each prefix is that of a shorter prefix plus one last token: of the vocabulary's tokens that end there, the longest whose
pair with the last token before it survives the merges. So one pass of n steps gives the last token and the count at every
prefix; a step looks back as far as the longest token, so no more states are held. Truncation and budget questions are answered from
the table of the piece in which the budget ends, without encoding again: a cut changes how a text is split only where it leaves white space,
half of a contraction, or half of a special string at its end. Counts of short pieces are kept in a worker while they fit a bound; texts take
time linear in their length.

Special strings inside a text count as the library has it by default: one token each, with no merge across them.

Defined results: a null text is an empty text of no tokens; very long texts and pieces are read whole; of prefixes that fit the budget the
longest counts, also where a longer prefix takes fewer tokens than a shorter one; repeated rows each get their own result; an empty table
gives an empty table; extra columns are kept, and one named like a result is replaced.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import append

LIMIT = 512
#: Pieces, and prefixes of pieces, whose counts a worker keeps, each of at most so many letters.
KEPT = 400_000
KEPT_PIECE = 64
#: The tokenizer family's fixed split pattern, with the white space of its own regular-expression library spelled out.
SPACE = r"[\t-\r\x20\x85\p{Z}]"
OTHER = r"[^\t-\r\x20\x85\p{Z}\p{L}\p{N}]"
#: Letters come first as they are most frequent; no piece that begins with an apostrophe could be theirs.
PATTERN = rf"\x20?\p{{L}}++|'(?:[sdmt]|ll|ve|re)|\x20?\p{{N}}++|\x20?{OTHER}++|{SPACE}+(?!{SPACE.replace('[', '[^')})|{SPACE}+"


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixTable:
    """Counts at every prefix for one byte-level BPE vocabulary file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("a byte-level vocabulary without normalizer, prefix space and other split patterns is wanted")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = [x["content"] for x in spec["added_tokens"] if not x["normalized"]]
        known = {x["content"] for x in spec["added_tokens"]}
        self.vocab = {raw(k) for k in spec["model"]["vocab"] if k not in known}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}  # the merge that makes a token: its rank, left and right
        for i, (a, b) in enumerate(self.rank):
            self.made.setdefault(a + b, (i, a, b))
        self.widest = max(map(len, self.vocab))
        tails: dict[bytes, set[int]] = {}
        for token in self.vocab:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        self.tails = {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in tails.items()}  # longest tokens first
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.totals: dict[str, int] = {}
        self.states: dict[bytes, tuple[int, bytes]] = {}
        self.survives = lru_cache(1 << 17)(self._survives)
        self.whole = lru_cache(1 << 16)(lambda token: self.merged(token) == [token])

    def merged(self, piece: bytes) -> list[bytes]:
        """By the merges, lowest rank first: the definition, for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _survives(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave the two tokens side by side.

        Their making is undone step by step, the later merge first. At each step a merge across the border may not have come before the
        merge that was just undone; of equal merges, the left one comes first.
        """
        rank, made = self.rank, self.made
        before = 1 << 60  # a merge across the border of a rank below this would have come first
        while True:
            if rank.get((left, right), 1 << 60) < before:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]

    def step(self, piece: bytes, end: int, at) -> tuple[int, bytes]:
        """Tokens of piece[:end] and the last of them; at(start) gives the same for a shorter prefix."""
        vocab, survives = self.vocab, self.survives
        for size in (*self.tails.get(piece[max(0, end - 3) : end], ()), 2, 1):
            start = end - size
            if start >= 0 and (token := piece[start:end]) in vocab:
                count, before = at(start)
                if survives(before, token) if start else self.whole(token):
                    return count + 1, token
        raise ValueError("a byte is missing in the vocabulary")

    def walk(self, piece: bytes, upto: int | None = None) -> Iterator[int]:
        """Tokens of the prefixes of 1, 2, ... bytes; of the states, only those are held that a token can reach back to."""
        held = self.widest + 1
        ring = [(0, b"")] * held
        for end in range(1, (len(piece) if upto is None else min(upto, len(piece))) + 1):
            ring[end % held] = found = self.step(piece, end, lambda start: ring[start % held] if start else (0, b""))
            yield found[0]

    def last(self, piece: bytes) -> int:
        """Tokens of the whole piece: its prefixes are looked up among those that earlier pieces have left, and left for later ones."""
        states = self.states
        if len(piece) > KEPT_PIECE:
            for count in self.walk(piece):
                pass
            return count
        if len(states) >= KEPT:
            states.clear()
        known = len(piece)
        while known and piece[:known] not in states:
            known -= 1
        at = lambda start: states[piece[:start]] if start else (0, b"")
        for end in range(known + 1, len(piece) + 1):
            states[piece[:end]] = self.step(piece, end, at)
        return at(len(piece))[0]

    def prefix(self, piece: str) -> tuple[int, ...]:
        return 0, *self.walk(piece.encode())

    def total(self, piece: str) -> int:
        found = self.totals.get(piece)
        if found is None:
            found = self.last(piece.encode())
            if len(piece) <= KEPT_PIECE:
                if len(self.totals) >= KEPT:
                    self.totals.clear()
                self.totals[piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; a special string is a piece of its own."""
        if self.cut is None or not self.cut.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.split.findall(part)
        return out

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """Pieces and the tokens of each."""
        get, total = self.totals.get, self.total
        if self.cut is None or not self.cut.search(text):
            pieces = self.split.findall(text)
            return pieces, [n if (n := get(p)) is not None else total(p) for p in pieces]
        special, pieces = set(self.special), self.pieces(text)
        return pieces, [1 if p in special else total(p) for p in pieces]

    def count(self, text: str) -> int:
        return sum(self.counts(text)[1])

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the most characters from its start that take at most `budget` tokens."""
        pieces, counts = self.counts(text)
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        ends, tokens = [0, *accumulate(map(len, pieces))], [0, *accumulate(counts)]
        over = bisect_right(tokens, budget) - 1  # the piece that passes the budget
        if self.blanks(pieces, over) and over + 1 < len(pieces) and pieces[over + 1][0].isspace():
            k = ends[over + 1] + 1  # white space that one character more might write in fewer tokens
            if self.blank(text, k, over, ends, tokens) <= budget:
                return total, k
        while over >= 0 and not (k := self.within(text, over, pieces, ends, tokens, budget)):
            over -= 1
        return total, k if over >= 0 else 0

    def within(self, text: str, p: int, pieces: list[str], ends: list[int], tokens: list[int], budget: int) -> int:
        """The last cut in piece p, its end included, up to which the text takes at most the budget; 0 if there is none."""
        piece = pieces[p]
        if piece in self.special or piece[0] == "'":
            return next((ends[p] + k for k in range(len(piece), 0, -1) if self.upto(text, ends[p] + k, pieces, ends, tokens) <= budget), 0)
        left, raw = budget - tokens[p], piece.encode()
        joined = piece[0].isspace() and self.blanks(pieces, p - 1)
        found = at = k = 0
        # a token has `widest` bytes at most, so no prefix of more than that many a token fits
        for count in self.walk(raw, max(0, left) * self.widest):
            at += 1
            if at == len(raw) or raw[at] & 0xC0 != 0x80:  # a character ends here
                k += 1
                if count <= left and not (k == 1 and joined):
                    found = k
        if joined and not found and self.blank(text, ends[p] + 1, p - 1, ends, tokens) <= budget:
            found = 1
        return ends[p] + found if found else 0

    def blanks(self, pieces: list[str], p: int) -> bool:
        return p >= 0 and pieces[p].isspace()

    def blank(self, text: str, k: int, p: int, ends: list[int], tokens: list[int]) -> int:
        """Tokens up to k, where the text from piece p on is white space: at the end of a text it is one piece."""
        return tokens[p] + self.total(text[ends[p] : k])

    def upto(self, text: str, k: int, pieces: list[str], ends: list[int], tokens: list[int]) -> int:
        """Tokens of the first k characters: of all pieces that the cut can't touch, and of the few characters of the rest, split anew."""
        at = max(0, bisect_left(ends, k) - 1)
        whole = 0
        while at and whole < 2:
            at -= 1
            whole += not pieces[at].isspace()
        return tokens[at] + self.count(text[ends[at] : k])

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """Bytes and tokens up to the end of each piece."""
        pieces, tokens = self.counts(text)
        return [0, *accumulate(len(p.encode()) for p in pieces)], [0, *accumulate(tokens)]

    def at(self, text: str, ends: list[int]) -> list[int]:
        """Tokens used by the first `end` bytes of the text's own pieces, for each end; inside a piece, by its table."""
        sizes, tokens = self.boundaries(text)
        pieces, special = self.pieces(text), set(self.special)
        out = []
        for end in ends:
            i = min(bisect_right(sizes, max(0, end)) - 1, len(pieces))
            inside = min(max(0, end), sizes[-1]) - sizes[i]
            out.append(tokens[i] + (0 if not inside else 1 if pieces[i] in special else self.prefix(pieces[i])[inside]))
        return out

    def fit(self, text: str, budget: int) -> int:
        return self.measure(text, budget)[1]


@lru_cache(2)
def loaded(name: str) -> PrefixTable:
    """The vocabulary is found on each executor: the parameter is a file's name there, or its full path."""
    import os

    if os.path.isabs(name):
        return PrefixTable(name)
    import public_tokenizers

    return PrefixTable(public_tokenizers.path(name))


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", budget: int = LIMIT) -> DataFrame:
    """df with n_bytes, n_tokens, and fit_chars: the most characters from the start that take at most `budget` tokens."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())]

    def make():
        t = loaded(vocabulary)

        def work(a):
            found = [t.measure(x, budget) for x in a.to_pylist()]
            sizes = np.diff(np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1])
            return [sizes, [n for n, _ in found], [c for _, c in found]]

        return work

    return append(df, text, fields, make)


def counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    found = count_tokens(docs.select(id_col, text), text, vocabulary, limit)
    return found.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")
