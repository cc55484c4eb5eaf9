"""Personal data: regular expressions propose spans, checksums confirm them, words near a span adjust its score.

Base kinds (email, ip, card, phone) are found leftmost and non-overlapping a kind; a match that fails its check is dropped
and not retried. Further kinds are added where their own evidence reaches the threshold: `iban` (mod-97), `ssn` and `local_phone`
(patterns that are weak alone, so they need a context word nearby). A span of a further kind never overlaps another span.

Defined results: a null text is an empty text and has no spans; repeated rows each get their own result; an empty table
gives an empty table; extra columns are kept, and one named like a result is replaced; spans of one start are in the order of their kinds;
of further kinds that would overlap, the one named first above stays. Every pattern and the sweep over spans take time linear in the text
(but for a logarithm), so a very long text, word or number does no harm.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import SPAN, Taken, append, aside, span_digests

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["iban", "ssn", "local_phone"]
ORDER = {k: i for i, k in enumerate(KINDS + EXTRA)}

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An IBAN's length by country, from the public IBAN registry.
IBAN_LENGTHS = """
AD 24 AE 23 AL 28 AT 20 AZ 28 BA 20 BE 16 BG 22 BH 22 BR 29 BY 28 CH 21 CR 22 CY 28 CZ 24 DE 22 DK 18 DO 28 EE 20 EG 29 ES 24 FI 18 FO 18 FR 27
GB 22 GE 22 GI 23 GL 18 GR 27 GT 28 HR 21 HU 28 IE 22 IL 23 IQ 23 IS 26 IT 27 JO 30 KW 30 KZ 20 LB 28 LC 32 LI 21 LT 20 LU 20 LV 21 LY 25 MC 27
MD 24 ME 22 MK 19 MR 27 MT 31 MU 30 NL 18 NO 15 PK 24 PL 28 PS 29 PT 25 QA 29 RO 24 RS 22 SA 24 SC 31 SE 24 SI 19 SK 24 SM 27 ST 25 SV 28 TL 23
TN 24 TR 26 UA 29 VA 22 VG 24 XK 20
"""
IBAN_OF = dict(zip(IBAN_LENGTHS.split()[::2], map(int, IBAN_LENGTHS.split()[1::2]), strict=True))
IBAN = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_OF.items()) + r")(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")

#: Where a score begins, what a near context word adds, and the words.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}
BOOST = 0.35
WORDS = {
    "email": "mail email e-mail contact",
    "ip": "ip host server address addr",
    "card": "card visa mastercard credit payment",
    "phone": "phone tel call mobile fax telefon téléphone",
    "iban": "iban bank account konto compte cuenta",
    "ssn": "ssn social security",
    "local_phone": "phone tel call mobile fax telefon téléphone",
}
CONTEXT = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, v.split())) + r")(?![^\W_])", re.I) for k, v in WORDS.items()}
WINDOW = 40
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def byte(digits: str) -> bool:
    """At most 255, however many zeros it begins with."""
    rest = digits.lstrip("0")
    return len(rest) < 4 and int(rest or "0") < 256


def emails(text: str) -> list[tuple[int, int]]:
    """As finditer() of the whole pattern: a match's local part is the run of its characters up to an @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        # without a match the run is not walked again: it lies left of this @
        end = max(end, at + 1) if start == at or not out or out[-1][1] <= at else end
        at = text.find("@", max(at + 1, end))
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Base spans."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not HAS_DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(byte(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return out


HAS_DIGIT = re.compile("[0-9]")


def near(kind: str, text: str, start: int, end: int) -> bool:
    return bool(CONTEXT[kind].search(text[max(0, start - WINDOW) : start]) or CONTEXT[kind].search(text[end : end + WINDOW // 2]))


def find(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans by start, then kind."""
    base = proposals(text)
    out = [(k, s, e, round(min(1.0, PRIOR[k] + BOOST * near(k, text, s, e)), 4), True) for k, s, e in base]
    if HAS_DIGIT.search(text):
        taken = Taken((s, e) for _, s, e in base)
        for kind, pattern, valid in (("iban", IBAN, mod97), ("ssn", SSN, None), ("local_phone", LOCAL_PHONE, None)):
            for m in pattern.finditer(text):
                s, e = m.span()
                if valid and not valid(m[0]):
                    continue
                score = min(1.0, PRIOR[kind] + BOOST * near(kind, text, s, e))
                if score >= THRESHOLD and taken.add(s, e):
                    out.append((kind, s, e, round(score, 4), False))
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def redact(text: str, spans: list[tuple]) -> str:
    """Each maximal run of overlapping spans becomes the tag of its first span."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i][:3]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def detect(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with a column of spans: kind, start and end in code points, score, base."""
    field = T.StructField(out, T.ArrayType(SPAN))
    return append(df, text, [field], lambda: lambda a: [[[dict(zip(SPAN.names, s, strict=True)) for s in find(x)] for x in a.to_pylist()]])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with personal data replaced by tags; a null text stays null."""
    named, back = aside(df, text)
    work = lambda a: [[redact(x, s) if (s := find(x)) else x for x in a.to_pylist()]]
    done = append(named.withColumn("_absent", F.col(text).isNull()), text, [T.StructField(text, T.StringType())], lambda: work)
    return done.withColumn(text, F.when(~F.col("_absent"), F.col(text))).select(*back)


def digests(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    found = detect(df.select(id_col, text), text, "_spans").drop(text)
    return found.select(id_col, *span_digests(found, "_spans", KINDS))
