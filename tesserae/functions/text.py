"""Text: normalising, n-grams, matching, titles, sections, references. All columns in, columns out, without Python workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTE = r"([\\^$.|?*+()\[\]{}-])"


def norm(c: Column) -> Column:
    """Lower case, without white space (of any script) at either end."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def grams(c: Column, *sizes: int) -> Column:
    """Distinct runs of so many characters of the lower-cased text that neither begin nor end with a blank. Short text: none.

    Each size is one pass of a pattern that looks ahead from every character; where no run begins, its second branch takes the character.
    """
    text = F.lower(c)
    run = lambda n: "[^ ]" + ("." * (n - 2) + "[^ ]" if n > 1 else "")
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?:(?=({run(n)}))|)."), F.lit(1)) for n in sizes]
    return F.coalesce(F.array_distinct(F.array_remove(F.concat(*runs), "")), F.array().cast("array<string>"))


def has(c: Column, term: Column | str) -> Column:
    """Substring test, a null text holding nothing."""
    return F.coalesce(F.contains(F.lower(c), F.lit(term) if isinstance(term, str) else term), F.lit(False))


def highlight(c: Column, terms: Sequence[str], open_: str = "<mark>", close: str = "</mark>") -> Column:
    """Marks every occurrence of a term, in either case, outside of tags; longer terms first."""
    import re

    kept = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not kept:
        return c
    return F.regexp_replace(c, "(?i)(?:" + "|".join(map(re.escape, kept)) + ")(?![^<]*>)", f"{open_}$0{close}")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def split_title(title: Column, fallback: Column, prefixes: Sequence[str]) -> tuple[Column, Column]:
    """An ordinal prefix and the rest, if a prefix's pattern fits and something remains; a null title: the fallback."""
    rest = F.trim(title)
    prefix = F.lit("")
    main = F.coalesce(F.nullif(rest, F.lit("")), fallback)
    for p in reversed(list(prefixes)):
        found = F.regexp_extract(rest, f"^({p})[\\s:]*(.+)$", 1)
        left = F.regexp_extract(rest, f"^({p})[\\s:]*(.+)$", 2)
        fits = F.coalesce((found != "") & (F.trim(left) != ""), F.lit(False))
        prefix, main = F.when(fits, F.trim(found)).otherwise(prefix), F.when(fits, F.trim(left)).otherwise(main)
    return prefix, main


def after_first(c: Column, mark: str = "_") -> Column:
    """What follows the first mark; all of it if there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + len(mark))).otherwise(c)


def strip_front_matter(md: Column) -> Column:
    return F.regexp_replace(md, r"^---\n[\s\S]*?\n---\n*", "")


def section(md: Column, heading: str) -> Column:
    """The body below `## heading` up to the next `##` or the end, trimmed; empty if there is none."""
    import re

    return F.trim(F.regexp_extract(F.concat(F.lit("\n"), md), rf"\n##[ \t]+{re.escape(heading)}[ \t]*\n([\s\S]*?)(?=\n##\s|$(?![\s\S]))", 1), F.lit(" \n\t\r"))


def first_section(md: Column, headings: Sequence[str]) -> Column:
    """The first heading's body that isn't empty."""
    return F.coalesce(*[F.nullif(section(md, h), F.lit("")) for h in headings], F.lit(""))


def first_sentence(c: Column, stop: str = ".", mark: str = "") -> Column:
    """Up to the first full stop, with it if there is one; marked as generated."""
    head = F.substring_index(c, stop, 1)
    return F.concat(F.when(F.instr(c, stop) > 0, F.concat(head, F.lit(stop))).otherwise(head), F.lit(mark))


def url_host(url: Column) -> Column:
    """The host of a well-formed http(s) url, else empty."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def first_match(c: Column, cascade: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first part that c contains."""
    out = F.lit(default)
    for part, label in reversed(list(cascade)):
        out = F.when(F.contains(c, F.lit(part)), label).otherwise(out)
    return F.when(c.isNull(), F.lit(default)).otherwise(out)


def signal(c: Column, words: dict[str, Sequence[str]], default: str) -> Column:
    """The first level one of whose words occurs; levels in order of precedence."""
    import re

    out = F.lit(default)
    for level, found in reversed(list(words.items())):
        out = F.when(F.coalesce(F.rlike(F.lower(c), F.lit("|".join(map(re.escape, found)))), F.lit(False)), level).otherwise(out)
    return out


def has_contents(c: Column) -> Column:
    """Whether a line is left of a table of contents: a title, dots or an ellipsis, and a page number at its end."""
    return F.coalesce(F.rlike(c, F.lit(r"(?m)^\S[^\n]*?(?:\.{3,}|…)[ \t]*+[0-9]++[ \t]*+$")), F.lit(False))


def hashed(c: Column) -> Column:
    """A pseudonym: the first 16 hexadecimal digits of SHA-256 over the trimmed lower-case text."""
    return F.substr(F.sha2(norm(c), 256), F.lit(1), F.lit(16))


def without_suffix(c: Column, suffix: str) -> Column:
    """A key without what the pattern finds at its end, trimmed."""
    return F.trim(F.regexp_replace(F.trim(c), f"(?:{suffix})$", ""))


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    """Whether the url holds one of the domains."""
    out = F.lit(False)
    for d in domains:
        out = out | F.coalesce(F.contains(url, F.lit(d)), F.lit(False))
    return out


def _between(c: Column, mark: str, tag: str, outside=lambda x: x) -> Column:
    """What stands between two marks in a tag; a last mark without a partner stays. outside: for what isn't between."""
    parts = F.split(c, "\\Q" + mark + "\\E")
    last = F.size(parts) - 1
    lone = last % 2 == 1  # the last mark has no partner

    def shown(x: Column, i: Column) -> Column:
        inside = (i % 2 == 1) & ~(lone & (i == last))
        return F.when(inside, F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))).otherwise(F.concat(F.when(lone & (i == last), mark).otherwise(""), outside(x)))

    return F.array_join(F.transform(parts, shown), "")


def _inline(c: Column) -> Column:
    """Code spans first, whose text is taken as it is; elsewhere links, then strong text."""
    link = lambda x: F.regexp_replace(x, r"\[([^\[\]]*+)\]\(([^()\s]*+)\)", '<a href="$2">$1</a>')
    return _between(c, "`", "code", lambda x: _between(link(x), "**", "strong"))


def markdown(md: Column) -> Column:
    """A subset of Markdown as HTML, a block a line: headings of two marks (h3) and three (h4), paragraphs of the lines between them and blank
    lines, with code, strong text and links; all else is escaped text."""
    lines = F.split(strip_front_matter(md), "\r?\n")
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{2,3})[ \t]+\S", 1))
    text = lambda x: F.trim(F.regexp_replace(x, r"^#{2,3}[ \t]+", ""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        lines = F.transform(lines, _replacer(a, b))
    # each line says what it is; lines of a paragraph stay together, all others end one
    line = lambda x: F.when(level(x) > 0, F.concat(F.lit("\n\n"), level(x).cast("string"), text(x), F.lit("\n\n"))).when(F.trim(x) == "", F.lit("\n\n")).otherwise(F.concat(F.lit("p"), x, F.lit("\n")))
    blocks = F.filter(F.split(F.array_join(F.transform(lines, line), ""), "\n{2,}"), lambda x: F.trim(x) != "")

    def block(x: Column) -> Column:
        heading = F.regexp_extract(x, "^([23])", 1)
        body = _inline(F.substr(x, F.lit(2)))
        lines_ = _inline(F.regexp_replace(F.regexp_replace(x, "(?m)^p", ""), "\\n$", ""))
        return F.when(heading == "2", F.concat(F.lit("<h3>"), body, F.lit("</h3>"))).when(heading == "3", F.concat(F.lit("<h4>"), body, F.lit("</h4>"))).otherwise(F.concat(F.lit("<p>"), lines_, F.lit("</p>")))

    return F.array_join(F.transform(blocks, block), "\n")


def _replacer(a: str, b: str):
    return lambda x: F.replace(x, F.lit(a), F.lit(b))
