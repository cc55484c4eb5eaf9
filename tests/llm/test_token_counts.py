"""The prefix table against the library, on whole texts and on every prefix of a piece."""

import random
import time
import tracemalloc

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import token_counts

NAME = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
TABLE = token_counts.loaded(NAME)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet=" \n\t\x1c\x85  ​᠎'sSllaveé९½٣😀<|endoftext|>", max_size=60), st.lists(st.sampled_from(["the ", " <|endoftext|>", "ing", "  ", "don't", "12345", "!!", "été", "　", "\r\n"]), max_size=20).map("".join)))
def test_whole_texts(text):
    assert TABLE.count(text) == library(text)


def test_every_prefix_of_a_piece():
    for piece in ["internationalization", " aaaaaaaaaaaaaaaa", "Donaudampfschifffahrtsgesellschaft", "--------====----", "ththndeahewhthsting", "3141592653589793"]:
        assert list(TABLE.prefix(piece)) == [library(piece[:i]) for i in range(len(piece) + 1)]


def test_at_and_fit():
    text = "The quick brown fox<|endoftext|> jumped over   internationalization."
    sizes, tokens = TABLE.boundaries(text)
    assert TABLE.at(text, [0, *sizes, 10_000]) == [0, *tokens, tokens[-1]]
    for budget in range(tokens[-1] + 2):
        assert library(text[: TABLE.fit(text, budget)]) <= budget or budget == 0


PARTS = st.lists(st.sampled_from(["the ", " <|endoftext|>", "ing", "  ", "don't", "12345", "!!", "été", "\u3000", "\r\n", "internationalization", " ", "'re", "😀", "zzzzzzzz"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(PARTS, st.integers(0, 20))
def test_fit_is_the_longest(text, budget):
    k = TABLE.fit(text, budget)
    assert library(text[:k]) <= budget
    assert all(library(text[:j]) > budget for j in range(k + 1, len(text) + 1))


@settings(max_examples=2500, deadline=None)
@given(st.one_of(st.text(alphabet=" \n\t\x1c\x85\u2003  'sSllavre1é!-<|endoftext|>", max_size=40), st.lists(st.sampled_from([" ", "  ", "   ", "\n", "\n\n", "\t", "a", " b", "'ll", "'l", "'", "!", " !!", "1", "<|endoftext|>", "----", "        "]), max_size=12).map("".join)), st.integers(0, 12))
def test_fit_at_every_kind_of_cut(text, budget):
    k = TABLE.fit(text, budget)
    assert library(text[:k]) <= budget
    assert all(library(text[:j]) > budget for j in range(k + 1, len(text) + 1))


def seconds(f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


def test_budgets_cost_no_second_encoding():
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150_000))
    for text in ("-" * 40_000, letters, " " * 60_000 + "x", "a1" * 20_000):
        fresh = lambda: token_counts.PrefixTable(public_tokenizers.path(NAME))
        plain, both = min(seconds(fresh().count, text) for _ in range(2)), min(seconds(fresh().measure, text, 512) for _ in range(2))
        assert both < 1.5 * plain + 0.3, text[:9]


def test_memory_of_a_long_piece_is_flat():
    letters = "".join(random.Random(2).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    TABLE.count(letters[:5_000])
    tracemalloc.start()
    TABLE.measure(letters, 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(letters) + 20_000_000  # the text itself in bytes, and caches with a bound


def test_fit_inside_a_long_piece():
    for text in ("ab" * 1_500, "ththndea" * 700, " " * 40_000 + "x", "é" * 3_000, "1" * 5_000, "a" + "!" * 9_000):
        k = TABLE.fit(text, 512)
        assert library(text[:k]) <= 512 < library(text) and all(library(text[:j]) > 512 for j in range(k + 1, k + 40) if j <= len(text))


def test_long_piece():
    for text in ("a" * 50_000, "ab1" * 20_000, " " * 50_000, "é" * 20_000):
        assert TABLE.count(text) == library(text)


def test_spark(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (None, "", ""), (3, "word " * 700, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counts(df).collect())
    assert got == sorted((str(i), len((t or "").encode()), library(t or ""), library(t or "") > 512) for i, t, _ in rows)
    assert token_counts.counts(df.where("false")).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: library(r.text or "") for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.counts(df).collect()} == want
