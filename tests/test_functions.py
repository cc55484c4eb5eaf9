"""Column functions on the hazards: white space, ties, halves, falsy values, odd numbers and dates."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.functions import values as vl


def one(spark, column, **cells):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first().x


def test_norm_trims_all_white_space(spark):
    assert one(spark, tx.norm(F.col("s")), s="　  ÀB c\t\n") == "àb c"


@pytest.mark.parametrize(("s", "n", "want"), [("", 2, []), ("a", 2, []), ("ab", 3, []), ("aBab", 2, ["ab", "ba"]), ("a b", 2, []), ("a b", 3, ["a b"]), ("x😀y", 2, ["x😀", "😀y"])])
def test_grams(spark, s, n, want):
    assert one(spark, tx.grams(F.col("s"), n), s=s) == want


def test_highlight_skips_tags(spark):
    assert one(spark, tx.highlight(F.col("s"), ["a+b", "b"]), s="A+B <b>b</b>") == "<mark>A+B</mark> <b><mark>b</mark></b>"


def test_sections(spark):
    md = "## One\n a\nb \n## Two\n\n## Three\nlast\n"
    got = [one(spark, tx.section(F.col("s"), h), s=md) for h in ("One", "Two", "Three", "Four")]
    assert got == ["a\nb", "", "last", ""]
    assert one(spark, tx.first_section(F.col("s"), ["Two", "Four", "Three"]), s=md) == "last"
    assert one(spark, tx.strip_front_matter(F.col("s")), s="---\nid: 1\n---\n\nbody --- x") == "body --- x"


def test_titles(spark):
    prefix, main = tx.split_title(F.col("t"), F.lit("id-1"), ["No\\.? ?[0-9]+", "Q[0-9]+"])
    assert one(spark, F.array(prefix, main), t="No. 12 The rest") == ["No. 12", "The rest"]
    assert one(spark, F.array(prefix, main), t="Q7: Why") == ["Q7", "Why"]
    assert one(spark, F.array(prefix, main), t="Q7") == ["", "Q7"]
    assert one(spark, F.array(prefix, main), t=None) == ["", "id-1"]


def test_hash(spark):
    import hashlib

    assert one(spark, tx.hashed(F.col("s")), s=" Abc ") == hashlib.sha256(b"abc").hexdigest()[:16]


@pytest.mark.parametrize(("x", "want"), [(2.5, 3), (-2.5, -2), (0.49999, 0), (-0.5, 0)])
def test_halves_go_up(spark, x, want):
    assert one(spark, vl.half_up(F.col("x")), x=x) == want


def test_synonym_share_is_double():
    assert [int(w * 0.7) for w in (90, 170, 180)] == [62, 118, 125]


@pytest.mark.parametrize(("s", "want"), [("1,234", 1234.0), (" 7.5 ", 7.5), ("x", 0.0), ("", 0.0), (None, 0.0)])
def test_number(spark, s, want):
    assert one(spark, vl.number(F.col("s")), s=s) == want


def test_falsy(spark):
    assert one(spark, vl.falsy_or(F.col("s"), F.lit("d")), s="") == "d"
    assert one(spark, vl.falsy_or(F.col("n"), F.lit(9), "number"), n=0) == 9
    assert one(spark, vl.falsy_or(F.col("n"), F.lit(9.0), "number"), n=float("nan")) == 9.0


@pytest.mark.parametrize(("day", "a", "b", "want"), [("01-01", "12-15", "01-15", True), ("12-15", "12-15", "01-15", True), ("06-01", "12-15", "01-15", False), ("07-01", "07-01", "07-01", True)])
def test_season(spark, day, a, b, want):
    assert one(spark, vl.in_season(F.col("d"), F.col("a"), F.col("b")), d=day, a=a, b=b) is want


@pytest.mark.parametrize(("s", "want"), [("999 and below", (0.0, 999.0)), ("1,000 - 2,999", (1000.0, 2999.0)), ("8,000+", (8000.0, float("inf"))), ("10~20", (10.0, 20.0)), ("unreadable", (None, None)), (None, (None, None))])
def test_tiers(spark, s, want):
    assert tuple(one(spark, F.array(*vl.tier_bounds(F.col("s"))), s=s)) == want


def test_living_fee(spark):
    fee = lambda lodged, meals, rate=299.0, fx=31.5: one(spark, vl.living_fee(F.col("r"), F.col("f"), F.col("l"), F.col("b"), F.col("u"), F.col("d")), r=rate, f=fx, l=lodged, b=meals, u=meals, d=meals)
    assert fee(False, False) == 9419  # the known reading
    assert fee(True, False) == 2826 and fee(True, True) == 942 and fee(False, True, rate=0.0) == 0


@pytest.mark.parametrize(("n", "want"), [(0, "零"), (7, "柒"), (10, "壹拾"), (105, "壹佰零伍"), (10_000, "壹萬"), (10_305, "壹萬零參佰零伍"), (100_010_000, "壹億零壹萬"), (12_345, "壹萬貳仟參佰肆拾伍"), (-20, "負貳拾"), (10**12, "壹兆"), (None, None)])
def test_formal_amount(n, want):
    assert vl.formal_amount(n) == want


def test_formal_amounts(spark):
    rng = random.Random(4)
    numbers = [0, -20, 10**12, 10**16, 10**18, 10_305, 100_010_000, 2**62, -(2**62), 20_000_300_000, *range(1, 1200, 7)]
    numbers += [int("".join(rng.choice("0001234567") for _ in range(rng.randrange(1, 18)))) for _ in range(600)]
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "n long")
    got = df.select("n", vl.formal_amounts(F.col("n")).alias("x")).collect()
    assert [(r.n, r.x) for r in got if r.x != vl.formal_amount(r.n)] == []


@pytest.mark.parametrize(("s", "want"), [("第十二條之一", (12, 1, "")), ("第十二條", (12, 0, "")), ("12-3", (12, 3, "")), ("７", (None, None, "７")), ("一百零五", (105, 0, "")), ("甲", (None, None, "甲")), ("第三點之十", (3, 10, "")), (" 4 ", (4, 0, "")), ("4-x", (None, None, "4-x")), ("", (None, None, "")), (None, (None, None, None))])
def test_natural_key(spark, s, want):
    assert tuple(one(spark, vl.natural_key(F.col("s")), s=s)) == want


def test_radicals(spark):
    every = [chr(x) for x in range(0x2E80, 0x2FD6)] + ["x", "一⼀", ""]
    df = spark.createDataFrame([(t,) for t in every], "t string")
    got = df.select("t", vl.unified(F.col("t")).alias("u"), vl.has_radicals(F.col("t")).alias("r")).collect()
    assert all(r.u == (unicodedata.normalize("NFKC", r.t) if len(unicodedata.normalize("NFKC", r.t)) == len(r.t) else r.t) for r in got)
    assert all(r.r == any(0x2E80 <= ord(ch) <= 0x2FD5 for ch in r.t) for r in got)


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("## A `x` b\none **two**\nthree\n\n### C\nlast", "<h3>A <code>x</code> b</h3>\n<p>one <strong>two</strong>\nthree</p>\n<h4>C</h4>\n<p>last</p>"),
        ("a `**b** [c](d)` e", "<p>a <code>**b** [c](d)</code> e</p>"),
        ("one ` mark and ** another", "<p>one ` mark and ** another</p>"),
        ("[a](/b?c) <i> & **[x](y)**", '<p><a href="/b?c">a</a> &lt;i&gt; &amp; <strong><a href="y">x</a></strong></p>'),
        ("---\nid: 1\n---\n\n# one\n#### four\n##none", "<p># one\n#### four\n##none</p>"),
        ("p\nprose", "<p>p\nprose</p>"),
        ("", ""),
        ("\n \n", ""),
    ],
)
def test_markdown(spark, md, want):
    assert one(spark, tx.markdown(F.col("s")), s=md) == want


def test_nfkc(spark):
    rows = ["ﬁ Ａ①", "é", None, ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = {r.i: r.x for r in df.select("i", vl.nfkc(F.col("s")).alias("x")).collect()}
    assert got == {i: None if r is None else unicodedata.normalize("NFKC", r) for i, r in enumerate(rows)}


def test_dates(spark):
    assert one(spark, vl.offset_year_date(F.col("s")), s="2024-03-05") == "113.03.05"
    assert one(spark, vl.offset_year_date(F.col("s")), s="soon") == "soon"
    span = lambda a, b: one(spark, vl.trip_days(F.to_date("a"), F.to_date("b")), a=a, b=b)
    assert (span("2024-02-28", "2024-03-01"), span("2024-03-01", "2024-02-28"), span("2024-03-01", None)) == (3, 0, 0)
