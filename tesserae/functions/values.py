"""Numbers, dates, money, and the falsy defaults of loosely typed input."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tesserae.session import ship


def falsy_or(c: Column, default: Column, kind: str = "string") -> Column:
    """c, or the default where c is null, empty (string) or zero / NaN (number)."""
    empty = c == "" if kind == "string" else (c == 0) | F.isnan(c.cast("double"))
    return F.when(c.isNull() | empty, default).otherwise(c)


def number(c: Column, default: float = 0.0) -> Column:
    """A number with thousands separators; what can't be read is the default. Never an error."""
    return F.coalesce(F.trim(F.regexp_replace(c, ",", "")).try_cast("double"), F.lit(default))


def half_up(c: Column, places: int = 0) -> Column:
    """Halves go up, towards plus infinity, as in floor(x + 0.5)."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale if places else F.floor(c + 0.5)


def thousands(c: Column) -> Column:
    """With separators; nothing for zero or null."""
    return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit("")).otherwise(F.format_number(c, 0))


def offset_year_date(c: Column, offset: int = 1911) -> Column:
    """Y-M-D with the year moved, months and days of two digits; the text itself if it isn't a date."""
    d = F.try_to_date(c, "yyyy-MM-dd")
    return F.when(d.isNull(), c).otherwise(F.concat_ws(".", (F.year(d) - offset).cast("string"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.dayofmonth(d).cast("string"), 2, "0")))


def trip_days(start: Column, end: Column) -> Column:
    """Days from start to end, both counted; 0 if one is missing or they are reversed."""
    return F.when(end >= start, F.datediff(end, start) + 1).otherwise(0)


def in_season(day: Column, first: Column, last: Column) -> Column:
    """Whether an MM-dd lies in an inclusive range that may go over the year's end."""
    return F.when(first <= last, (day >= first) & (day <= last)).otherwise((day >= first) | (day <= last))


def living_fee(rate: Column, fx: Column, lodged: Column, breakfast: Column, lunch: Column, dinner: Column, base: float = 0.3, meals: tuple[float, float, float] = (0.04, 0.08, 0.08)) -> Column:
    """A day's allowance: the whole rate, or a share if lodging is supplied, less a share for each supplied meal; never below 0."""
    share = F.when(lodged, F.lit(base)).otherwise(F.lit(1.0))
    for flag, cut in zip((breakfast, lunch, dinner), meals, strict=True):
        share = share - F.when(flag, F.lit(cut)).otherwise(F.lit(0.0))
    amount = half_up(rate * fx * half_up(F.greatest(F.lit(0.0), share), 4), 4)
    return F.when((F.coalesce(rate, F.lit(0.0)) > 0) & (F.coalesce(fx, F.lit(0.0)) > 0), half_up(amount)).otherwise(F.lit(0)).cast("long")


def tier_bounds(c: Column) -> tuple[Column, Column]:
    """Bounds from a text: `N+` or `N and above`, `N-` or `N and below`, `a-b` with any of three dashes; else nulls."""
    s = F.lower(F.regexp_replace(c, r"[\s,]", ""))
    pair = r"^([0-9]+(?:\.[0-9]+)?)[-–~]([0-9]+(?:\.[0-9]+)?)$"
    above, below = r"^([0-9]+(?:\.[0-9]+)?)(?:\+|andabove)$", r"^([0-9]+(?:\.[0-9]+)?)(?:-|andbelow)$"
    get = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit("")).try_cast("double")
    low = F.coalesce(get(pair, 1), get(above, 1), F.when(get(below, 1).isNotNull(), F.lit(0.0)))
    high = F.coalesce(get(pair, 2), get(below, 1), F.when(get(above, 1).isNotNull(), F.lit(float("inf"))))
    return low, high


#: Formal numerals, places in a group, and groups of four digits.
DIGITS = "零壹貳參肆伍陸柒捌玖"
PLACES = ["", "拾", "佰", "仟"]
GROUPS = ["", "萬", "億", "兆", "京"]


def formal_amount(n: int | None) -> str | None:
    """A whole amount in formal Chinese numerals: groups of four digits, one zero for a gap inside."""
    if n is None:
        return None
    if n == 0:
        return DIGITS[0]
    parts, left, gap, level = [], abs(n), False, 0
    while left:
        left, four = divmod(left, 10_000)
        words, zero = "", False
        for place in range(4):
            digit = four // 10**place % 10
            if digit:
                words = DIGITS[digit] + PLACES[place] + (DIGITS[0] if zero and words else "") + words
                zero = False
            else:
                zero = True
        if four:
            parts.append(words + (GROUPS[level] if level < len(GROUPS) else GROUPS[-1]) + (DIGITS[0] if gap and parts else ""))
            gap = four < 1000
        else:
            gap = True
        level += 1
    return ("負" if n < 0 else "") + "".join(reversed(parts))


def formal_amounts(c: Column) -> Column:
    """formal_amount as one expression: every digit with its place, then what zeros leave out is cut away."""
    n = c.cast("long")
    digits = F.split(F.regexp_replace(n.cast("string"), "^-", ""), "")
    digits = F.filter(digits, lambda x: x != "")
    size = F.size(digits)

    def worded(x: Column, i: Column) -> Column:
        right = size - 1 - i  # digits that follow
        place = F.element_at(F.array(*map(F.lit, PLACES)), (right % 4 + 1).cast("int"))
        group = F.element_at(F.array(*map(F.lit, GROUPS)), (F.floor(right / 4) + 1).cast("int"))
        word = F.translate(x, "0123456789", DIGITS)
        return F.concat(word, F.when(x == "0", "").otherwise(place), F.when(right % 4 == 0, group).otherwise(""))

    zero, marks = DIGITS[0], "".join(GROUPS[1:])
    text = F.array_join(F.transform(digits, worded), "")
    text = F.regexp_replace(text, f"{zero}+", zero)
    text = F.regexp_replace(text, f"{zero}([{marks}])", "$1")
    text = F.regexp_replace(text, f"([{marks}])[{marks}]+", f"$1{zero}")  # groups of zeros
    text = F.regexp_replace(F.regexp_replace(text, f"{zero}+", zero), f"{zero}$", "")
    return F.when(n == 0, zero).otherwise(F.concat(F.when(n < 0, "負").otherwise(""), text))


def nfkc(c: Column) -> Column:
    """Compatibility composition, which Spark has no function for."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return convert(c)


#: Ordinary numerals.
NUMERALS = dict(zip("〇一二三四五六七八九", range(10), strict=True))


def numeral(c: Column) -> Column:
    """An ordinary Chinese numeral up to 9999 as a number; null if it has other characters."""
    at = lambda unit: F.regexp_extract(c, f"([一二三四五六七八九])?{unit}", 1)
    digit = lambda x: F.coalesce(F.nullif(F.translate(x, "〇一二三四五六七八九", "0123456789"), F.lit("")).try_cast("int"), F.lit(0))
    part = lambda unit, size: F.when(F.instr(c, unit) > 0, F.greatest(digit(at(unit)), F.lit(1)) * size).otherwise(0)
    ones = digit(F.regexp_extract(c, "([一二三四五六七八九])$", 1))
    return F.when(F.rlike(c, F.lit("^[〇零一二三四五六七八九十百千]+$")), part("千", 1000) + part("百", 100) + part("十", 10) + ones)


WORDED = "〇零一二三四五六七八九十百千"


def natural_key(c: Column) -> Column:
    """number, sub, text: what a label is ordered by. A number in digits or numerals, maybe between its marks, and one below it after a dash or
    its mark; a label of another form has no number and is ordered by its text, after all numbers."""
    one = f"([0-9]{{1,9}}|[{WORDED}]+)"
    form = f"^第?{one}[條点點項號号]?(?:[之-]{one})?$"
    label = F.trim(c)
    value = lambda k: F.coalesce(F.regexp_extract(label, form, k).try_cast("int"), numeral(F.regexp_extract(label, form, k)))
    fits = F.rlike(label, F.lit(form))
    return F.struct(F.when(fits, value(1)).alias("number"), F.when(fits, F.coalesce(value(2), F.lit(0))).alias("sub"), F.when(fits, "").otherwise(label).alias("text"))


def natural_order(key: str) -> list[Column]:
    """The order of a natural_key column."""
    return [F.col(f"{key}.number").asc_nulls_last(), F.col(f"{key}.sub"), F.col(f"{key}.text")]


#: Characters that stand for radicals: two blocks of the character set.
RADICALS = (0x2E80, 0x2FD5)


@cache
def unified_pairs() -> tuple[str, str]:
    """The radicals that have a unified character, and these, by the standard's own decompositions."""
    found = [(chr(x), unicodedata.normalize("NFKC", chr(x))) for x in range(RADICALS[0], RADICALS[1] + 1)]
    found = [(a, b) for a, b in found if a != b and len(b) == 1]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def radical_block() -> str:
    """The second block, in order."""
    return "".join(chr(x) for x in range(0x2F00, RADICALS[1] + 1))


def has_radicals(c: Column) -> Column:
    return F.rlike(c, F.lit(f"[{chr(RADICALS[0])}-{chr(RADICALS[1])}]"))


def unified(c: Column) -> Column:
    """A text with unified characters in place of radicals that stand for them."""
    return F.translate(c, *unified_pairs())
