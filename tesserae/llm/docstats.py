"""Statistics of whole texts, over Arrow buffers: what the quality operators judge by.

A word is a run of characters other than space and \\t \\n \\v \\f \\r. Works on blocks of texts; memory follows the block.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa

from tesserae.llm.common import buffers

#: Bytes of text worked on at once: what a core's cache holds with its counts.
BLOCK = 1 << 18

#: Classes of bytes; none is in two.
CLASSES = {
    "blanks": b"\t\x0b\x0c\r ",
    "newlines": b"\n",
    "n_symbols": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": b"0123456789",
    "exclaim": b"!?",
    "stops": b".,;:",
    "brackets": b"()[]{}=_/\\@+~^\"'`",
    "tails": bytes(range(128, 192)),
    "leads": bytes(range(192, 256)),
}
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    CLASS_OF[list(_bytes)] = _i
WHITE = CLASS_OF <= 1
LOWER = CLASS_OF == 4
LETTER = LOWER | (CLASS_OF == 3) | (np.arange(256) > 127)

#: What a row of features() holds, in this order.
FEATURES = (
    "log_words log_chars mean_word sd_word longest_word symbols_word upper_letter digits_char exclaim_word stops_word brackets_word "
    "accents_char words_line chars_line dup_line repeat_word distinct_word top_word letterless_word single_word upper_word stutter_word"
).split()


def by_class(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """How many bytes of each class a text has, in one count."""
    docs, width = len(offsets) - 1, len(CLASSES) + 1
    text = np.repeat(np.arange(docs, dtype=np.int32) * width, np.diff(offsets))
    found = np.bincount(text + CLASS_OF[data], minlength=docs * width).reshape(docs, width)
    return {k: found[:, i] for i, k in enumerate(CLASSES)}


def sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of mask between offsets."""
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def word_ids(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids of the words one after another, offsets of the texts in them, and by text the repeated lines."""
    number = {}
    make = count().__next__
    ids: list[int] = []
    ends, dups = [0], []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text = data[s:e]
        for w in (words := text.split()):
            if w not in number:
                number[w] = make()
        ids.extend(map(number.__getitem__, words))
        ends.append(len(ids))
        if 10 in text:
            lines = [x for x in text.split(b"\n") if x.strip()]
            dups.append(len(lines) - len(set(lines)))
        else:
            dups.append(0)
    return np.array(ids, np.int64), np.array(ends, np.int64), np.array(dups, np.int64), len(number)


def pair(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """A number a distinct pair; b < n. Numbers stay below the count of rows, so no product overflows."""
    codes, found = pd.factorize(a * n + b)
    return codes.astype(np.int64), max(1, len(found))


def repeated(ids: np.ndarray, ends: np.ndarray, n: int, width: int = 5) -> np.ndarray:
    """By text: words that lie in a window of width words that the text holds twice or more."""
    total = len(ids)
    if total < width + 1:
        return np.zeros(len(ends) - 1, np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    code, size = pair(text, ids, max(1, n))
    code, size = code[: total - width + 1], size
    for k in range(1, width):
        code, size = pair(code, ids[k : k + total - width + 1], max(1, n))
    inside = text[: total - width + 1] == text[width - 1 :]
    twice = inside & (np.bincount(code[inside], minlength=size)[code] > 1)
    hit = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + width, -1)
    return sums(np.cumsum(hit[:-1]) > 0, ends)


def counts(array: pa.Array) -> dict[str, np.ndarray]:
    """Whole numbers by text."""
    offsets, data = buffers(array)
    raw = data.tobytes()
    white = WHITE[data]
    out = by_class(data, offsets)
    starts = ~white
    starts[1:] &= white[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = ~white[first]
    ids, ends, dups, n = word_ids(raw, offsets)
    word = np.flatnonzero(starts)
    # a word ends at white space or where its text ends
    last = ~white
    last[:-1] &= white[1:]
    final = offsets[1:][np.diff(offsets) > 0] - 1
    last[final] = ~white[final]
    size = np.flatnonzero(last) + 1 - word
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    docs = len(ends) - 1
    out["n_bytes"] = np.diff(offsets)
    out["n_chars"] = out["n_bytes"] - out["tails"]
    out["word_chars"] = out["n_chars"] - out["blanks"] - out["newlines"]
    out["n_words"] = np.diff(ends)
    out["n_dup_lines"] = dups
    out["n_repeat_words"] = repeated(ids, ends, n)
    out["size_sum"] = np.bincount(text, size, docs)
    out["size_sq"] = np.bincount(text, size.astype(float) ** 2, docs)
    out["longest"] = np.zeros(docs, np.int64)
    np.maximum.at(out["longest"], text, size)
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(LETTER[data], out=letters[1:])
    lower = np.zeros(len(data) + 1, np.int32)
    np.cumsum(LOWER[data], out=lower[1:])
    n_letters = letters[word + size] - letters[word]
    out["letterless"] = np.bincount(text, n_letters == 0, docs).astype(np.int64)
    out["shouted"] = np.bincount(text, (lower[word + size] == lower[word]) & (n_letters > 1), docs).astype(np.int64)
    out["singles"] = np.bincount(text, size == 1, docs).astype(np.int64)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    out["stutter"] = np.bincount(text, same, docs).astype(np.int64)
    by_word, keys = pd.factorize(text * max(1, n) + ids)
    times, owner = np.bincount(by_word, minlength=len(keys)), keys // max(1, n)
    out["distinct"] = np.bincount(owner, minlength=docs)
    out["top"] = np.zeros(docs, np.int64)
    np.maximum.at(out["top"], owner, times)
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row of float32 a text, finite for any text."""
    words, chars = np.maximum(1, c["n_words"]), np.maximum(1, c["n_chars"])
    lines = np.maximum(1, c["newlines"] + 1)
    mean = c["size_sum"] / words
    columns = [
        np.log1p(c["n_words"]),
        np.log1p(c["n_chars"]),
        mean,
        np.sqrt(np.maximum(0, c["size_sq"] / words - mean**2)),
        np.log1p(c["longest"]),
        c["n_symbols"] / words,
        c["upper"] / np.maximum(1, c["upper"] + c["lower"]),
        c["digits"] / chars,
        c["exclaim"] / words,
        c["stops"] / words,
        c["brackets"] / words,
        c["tails"] / chars,
        np.log1p(c["n_words"] / lines),
        np.log1p(c["n_chars"] / lines),
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words,
        c["distinct"] / words,
        c["top"] / words,
        c["letterless"] / words,
        c["singles"] / words,
        c["shouted"] / words,
        c["stutter"] / words,
    ]
    return np.column_stack(columns).astype(np.float32) if len(words) else np.zeros((0, len(columns)), np.float32)
