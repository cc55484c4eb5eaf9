"""Secrets: a lexer reads name-literal pairs, constants are propagated, literals are scored by the names they reach.

Base kinds (assign, access, hex) are found leftmost and non-overlapping a kind; a match that fails its length is dropped
and not retried. Kind `literal` is added for a literal whose best name reaches the threshold and that no base span covers:

1. Tokens: comments, strings (escapes, prefixes, triple quotes), names, operators, marks, ends of lines.
2. Assignments: a target (`name`, `a.name`, `cfg["name"]`, `"name"`, `<name>`, the `key` of `key="name" value="..."`), an operator (`=`, `:`,
   `:=`, `=>`, `<-`, `+=`, `?=`), and a right side: strings side by side or joined by `+`, `.`, `..`, `&`, also over lines and in brackets; names;
   bare literals of configuration files; blocks of YAML after `|` or `>`, values after an anchor. Several targets at the start of a line take as
   many values, in order. What follows `or`, `||`, `??`, `?:`, and both sides of `x ? a : b` and `a if x else b`, are values of the target too,
   also after a call. `#define NAME value`, and calls of SETTERS with a name and a value, assign.
3. Propagation: a name on a right side stands for its last assignment before, else its first after, also through further names and in
   concatenations. A literal gets the score of the most sensitive target it reaches. What a comment assigns is read too, but binds no
   name outside of it.
4. Score: how telling the target's name is, and how random the whole value is that reaches it. Blanks lower it; a value that is a reference as
   a whole (`$NAME`, `${NAME}`) has none.

Defined results: a null text is an empty text and has no spans; repeated rows each get their own result; an empty table gives an empty
table; extra columns are kept, and one named like a result is replaced; spans of one start are in the order of their kinds; of equal
targets any gives the same score. Names, blanks, literals and texts may have any length: the time is linear but for a logarithm.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm.common import SPAN, Taken, append, span_digests

KINDS = ["assign", "access", "hex"]
ORDER = {k: i for i, k in enumerate([*KINDS, "literal"])}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")

TOKEN = re.compile(
    r"""(?P<define>(?:(?<=\n)|(?<![\s\S]))\#[\x20\t]*+define(?=[\x20\t]))
    |(?P<blank>[\x20\t\r\f\v]++|\\\n)
    |(?P<line>\n)
    |(?P<comment>(?:(?<=\s)|(?<![\s\S]))(?:\#|//))
    |(?P<open>/\*|<!--)
    |(?P<triple>(?<![A-Za-z0-9_])[rRbBfFuU]{0,2}(?:\"{3}|'{3}))
    |(?P<string>(?<![A-Za-z0-9_])[rRbBfFuU]{0,2}(?:"(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n])*+'|`[^`\n]*+`))
    |(?P<escape>\\.)
    |(?P<tag><(?P<tagname>[A-Za-z_][A-Za-z0-9_.-]*+)>(?P<tagged>[^<>\n]++)</(?P=tagname)>)
    |(?P<other>:/++|::+|==+|!=|<=|>=|=~)
    |(?P<set>:=|=>|<-|\+=|\?=|=|:)
    |(?P<name>[^\W\d][\w-]*+(?:\.[\w-]++)*+)
    |(?P<join>\+|\.\.?(?!\w)|&(?!&))
    |(?P<mark>[^\w])
    |(?P<number>\w+)""",
    re.X,
)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
REFERENCE = re.compile(r"\$(?:\{(\w++)\}|(\w++))(?![^\s\"';,)])")
IDENTIFIER = re.compile(r"[^\W\d][\w.]*+$")
BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[\x20\t]*+(?:\#[^\n]*+)?$")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
ESCAPED = re.compile(r"\\(.)", re.S)

#: How telling a part of a name is.
PARTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "private": 0.4, "access": 0.3, "signing": 0.4, "key": 0.4, "bearer": 0.8}
#: A text that holds none of these binds nothing.
BINDING = re.compile(r"[=:]|</|<-|\#[\x20\t]*+define|\w\([\"']")
#: A text that holds none of these has no sensitive name.
TELLING = re.compile("pass|pwd|secret|token|apikey|credential|auth|private|access|signing|key|bearer", re.I)
THRESHOLD = 1.0
LEAST = 8
#: What blanks leave of a score: up to so many, and each further one.
BLANKS, SPACED, FURTHER = 3, 0.6, 0.5
#: The last part of calls that bind a value to a name.
SETTERS = {"define", "set", "setenv", "put", "putenv", "setdefault", "setproperty"}
#: What begins or joins a condition: a colon after it isn't that of a type.
CLAUSES = {"if", "elif", "else", "while", "for", "in", "is", "try", "except", "with", "case", "and", "or", "not", "finally", "default"}
#: Tokens that a condition of `a if x else b` may have.
CONDITION = 24


def name_score(name: str) -> float:
    return min(1.0, sum({p: PARTS.get(p, 0.0) for p in (x.lower() for x in CAMEL.findall(name))}.values()))


def literal_score(found: Counter, reference: bool) -> float:
    """0 to 1 from a value's characters: long values of mixed characters; letters alone get little, words with blanks less."""
    n = found.total()
    if n < LEAST or reference:
        return 0.0
    mixed = sum(any(f(c) for c in found) for f in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: not (c.isascii() and c.isalnum())))
    entropy = -sum(c / n * math.log2(c / n) for c in found.values() if c / n)
    blanks = found[" "]
    spaced = 1.0 if not blanks else SPACED * FURTHER ** max(0, blanks - BLANKS)
    score = min(1.0, entropy / 4) * (0.4 if mixed < 2 else 1.0) * spaced
    return score if score >= 0.1 else 0.0


def tokens(text: str, start: int, end: int, comment: bool = False) -> list[tuple[str, int, int]]:
    """kind, start, end, without blanks; a comment is one token, unless what is read is a comment itself."""
    out, at, gone = [], start, set()
    while at < end:
        m = TOKEN.match(text, at, end)
        kind, at = m.lastgroup, m.end()
        if kind in ("tagged", "tagname"):
            kind = "tag"
        if kind == "comment":
            if not comment:
                stop = text.find("\n", at, end)
                out.append(("comment", at, stop if stop >= 0 else end))
                at = out[-1][2]
        elif kind == "open" and comment:
            pass
        elif kind in ("open", "triple"):
            close = {"/*": "*/", "<!--": "-->"}.get(m[0], m[0][-3:])
            stop = -1 if close in gone else text.find(close, at, end)
            if stop < 0:  # searched for once at most
                gone.add(close)
                continue
            out.append(("comment", at, stop) if kind == "open" else ("string", at, stop))
            at = stop + len(close)
        elif kind == "string":
            quote = m[0][-1]
            out.append(("string", m.start() + m[0].index(quote) + 1, at - 1))
        elif kind != "blank":
            out.append((kind, m.start(), at))
    return out


def brackets(text: str, found: list[tuple[str, int, int]]) -> dict[int, int]:
    """By token, where a round bracket that opens there is closed."""
    out, open_ = {}, []
    for i, (kind, s, _) in enumerate(found):
        if kind == "mark" and text[s] == "(":
            open_.append(i)
        elif kind == "mark" and text[s] == ")" and open_:
            out[open_.pop()] = i
    return out


class Lexer:
    """Assignments of a text in the order they are met: name, its literals and the names it refers to, by place."""

    def __init__(self, text: str):
        self.text = text
        self.names: list[str] = []
        self.parts: list[list[tuple[str, int, int, str]]] = []  # literal or name, start, end, what it says
        self.scopes: list[int] = []
        self.first: list[int] = []  # of assignments that are alternatives in one statement, the first one
        self.start = self.stop = self.bare = 0  # the run of characters met last, and the end of the last bare literal or block
        todo, scope = [(0, len(text))], 0
        while todo:
            start, end = todo.pop()
            self.bare = 0
            todo += self.read(tokens(text, start, end, scope > 0), scope)
            scope += 1

    def run(self, at: int) -> int:
        """Where the run of characters that a bare literal may hold ends."""
        if not self.start <= at < self.stop:
            m = BARE.match(self.text, at)
            self.start, self.stop = at, m.end() if m else at
        return self.stop

    def add(self, name: str, parts: list, scope: int, first: int | None = None) -> None:
        if name and parts:
            self.first.append(len(self.names) if first is None else first)
            self.names.append(name)
            self.parts.append(parts)
            self.scopes.append(scope)

    def alternatives(self, first: int) -> range:
        end = first + 1
        while end < len(self.first) and self.first[end] == first:
            end += 1
        return range(first, end)

    def read(self, found: list[tuple[str, int, int]], scope: int) -> list[tuple[int, int]]:
        text, comments, attribute, known = self.text, [], None, 0
        self.closing = brackets(text, found)
        for i, (kind, s, e) in enumerate(found):
            if kind == "comment":
                comments.append((s, e))
            elif kind == "tag":
                m = TOKEN.match(text, s, e)
                self.add(m["tagname"], [("literal", *m.span("tagged"), m["tagged"])], scope)
            elif kind == "define" and i + 1 < len(found) and found[i + 1][0] == "name":
                self.assign([text[slice(*found[i + 1][1:])]], found, i + 1, scope)
            elif kind == "name" and (name := self.setter(found, i)) is not None:
                self.assign([name], found, i + 3, scope)
            elif kind == "set" and s >= self.bare:
                names = self.targets(found, i)
                if not names:
                    continue
                parts, stop = self.assign(names, found, i, scope)
                if len(parts) == 1 and parts[0][0] == "literal" and text[s] == "=":  # key="name" value="..."
                    if names[-1].lower() in ("key", "name"):
                        attribute, known = parts[0][3], stop
                    elif names[-1].lower() == "value" and attribute is not None and stop - known <= 4:
                        self.add(attribute, parts, scope)
        return comments

    def assign(self, names: list[str], found: list, i: int, scope: int) -> tuple[list, int]:
        """Adds what stands right of token i: a value a name, if there are as many, else the first one for the last name; then its alternatives.
        The first value, and the token after it."""
        first, stop = parts, at = self.value(found, i)
        if len(names) > 1:
            several = [parts]
            while len(several) <= len(names) and self.says(found, at, ","):
                parts, at = self.value(found, at)
                several.append(parts)
            if len(several) == len(names):
                for name, parts in zip(names, several, strict=True):
                    self.add(name, parts, scope)
                return first, stop
        name, parts, at, own = names[-1], first, stop, len(self.names)
        if not parts and at + 1 < len(found) and found[at][0] == "name" and self.says(found, at + 1, "("):
            at = self.closing.get(at + 1, at) + 1  # a call: what it gives isn't known, but what may stand for it
        if self.says(found, at, "?") and not self.says(found, at + 1, "?") and not self.says(found, at + 1, ":"):
            parts, at = self.value(found, at)  # what stood before is a condition
            self.add(name, parts, scope, own)
            if self.says(found, at, ":"):
                self.add(name, self.value(found, at)[0], scope, own)
            return first, stop
        self.add(name, parts, scope, own)
        while (k := self.alternative(found, at)) is not None:
            parts, at = self.value(found, k)
            if at <= k:
                break
            self.add(name, parts, scope, own)
        return first, stop

    def says(self, found: list, i: int, what: str) -> bool:
        return 0 <= i < len(found) and self.text[found[i][1] : found[i][2]] == what and found[i][0] in ("mark", "set", "name", "other")

    def alternative(self, found: list, i: int) -> int | None:
        """The last token of an operator after which another value of the same target stands."""
        if self.says(found, i, "or"):
            return i
        if any(self.says(found, i, a) and self.says(found, i + 1, b) and found[i + 1][1] == found[i][2] for a, b in (("|", "|"), ("?", "?"), ("?", ":"))):
            return i + 1
        if self.says(found, i, "if"):
            return next((k for k in range(i + 1, min(len(found), i + CONDITION)) if self.says(found, k, "else")), None)
        return None

    def setter(self, found: list, i: int) -> str | None:
        """The name that a call of SETTERS binds."""
        text = self.text
        if i + 4 < len(found) and found[i + 2][0] == "string" and self.says(found, i + 1, "(") and self.says(found, i + 3, ",") and text[found[i][1] : found[i][2]].rsplit(".", 1)[-1].lower() in SETTERS:
            return text[found[i + 2][1] : found[i + 2][2]]
        return None

    def targets(self, found: list, i: int) -> list[str]:
        """The target; if a line begins with several, all of them."""
        last = self.target(found, i)
        if last is None:
            return []
        names, k = [last], i - 1
        while k >= 2 and found[k][0] == "name" and self.says(found, k - 1, ",") and found[k - 2][0] == "name":
            k -= 2
            names.append(self.text[found[k][1] : found[k][2]])
        return list(reversed(names)) if len(names) > 1 and (not k or found[k - 1][0] == "line") else [last]

    def target(self, found: list, i: int) -> str | None:
        """What stands left of an operator: a name, a quoted key, or the last key in brackets with what it belongs to."""
        text, keys, i = self.text, [], i - 1
        if i >= 2 and found[i][0] == "name" and text[found[i - 1][1]] == ":" and found[i - 1][0] == "set" and text[found[i + 1][1]] == "=" and found[i - 2][0] in ("name", "string") and not any(k >= 0 and text[found[k][1] : found[k][2]] in CLAUSES for k in (i - 2, i - 3)):
            i -= 2  # name: type = value
        while i >= 2 and text[found[i][1]] == "]" and found[i - 1][0] in ("string", "name") and text[found[i - 2][1]] == "[":
            keys.append(text[found[i - 1][1] : found[i - 1][2]])
            i -= 3
        if i >= 0 and found[i][0] in ("name", "string"):
            keys.append(text[found[i][1] : found[i][2]])
        return ".".join(reversed(keys)) if keys else None

    def value(self, found: list, i: int) -> tuple[list, int]:
        """The parts of a right side, and the token after it."""
        text, parts, depth, i, n = self.text, [], 0, i + 1, len(found)
        if i < n and text[found[i - 1][1]] == ":" and text[found[i][1]] in "|>" and (block := self.block(found, i)):
            self.bare = block[2]
            return [block], i + 1
        if i + 1 < n and text[found[i - 1][1]] == ":" and text[found[i][1]] in "&!" and found[i + 1][0] == "name" and found[i + 1][1] == found[i][2]:
            i += 2  # an anchor or a type of YAML
        wanted = True  # a term may follow
        while i < n:
            kind, s, e = found[i]
            if kind == "line":
                # a right side goes on after a join, in brackets, and where a join begins the next line
                if not depth and not (wanted and parts) and not (i + 1 < n and found[i + 1][0] == "join" and parts):
                    break
            elif kind == "mark" and text[s] == "(" and (wanted and not parts):
                depth += 1
            elif kind == "mark" and text[s] == ")" and depth:
                depth -= 1
            elif kind == "join" and parts and not wanted:
                wanted = True
            elif kind == "string" and (wanted or parts[-1][0] == "literal"):  # side by side
                parts.append(("literal", s, e, text[s:e]))
                wanted = False
            elif wanted and kind == "mark" and text[s] == "$" and (m := REFERENCE.match(text, s)):
                parts.append(("name", s, m.end(), m[1] or m[2]))
                wanted = False
                while i + 1 < n and found[i + 1][1] < m.end():
                    i += 1
            elif wanted and kind in ("name", "number", "mark", "join", "escape", "other", "set") and (kind in ("name", "number") or not parts) and (stop := self.run(s)) > s:
                code = stop < len(text) and text[stop] in "\"'`([{"
                if code and (at := text.find("=", s, stop)) > s:  # a=b="x"
                    code, stop = False, at
                if IDENTIFIER.match(text, s, stop):
                    if code and text[stop] in "([":
                        return [], i  # what a call or an index gives isn't known
                    parts.append(("name", s, stop, text[s:stop]))
                elif code and text[stop] in "\"'`":
                    break
                else:
                    parts.append(("literal", s, stop, text[s:stop]))
                    self.bare = stop
                wanted = False
                while i + 1 < n and found[i + 1][1] < stop:
                    i += 1
            elif kind == "comment" and depth:
                pass
            else:
                break
            i += 1
        return parts, i

    def block(self, found: list, i: int) -> tuple[str, int, int, str] | None:
        """The lines after `name: |` that are indented more than the line of the name."""
        text = self.text
        end = text.find("\n", found[i][1])
        if end < 0 or not BLOCK.match(text, found[i][1], end):
            return None
        begin = text.rfind("\n", 0, found[i][1]) + 1
        deep = lambda a, b: next((k - a for k in range(a, b) if text[k] not in " \t"), -1)
        own, first, last, at = deep(begin, end), -1, -1, end + 1
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            inside = deep(at, stop)
            if inside >= 0:
                if inside <= own:
                    break
                first, last = first if first >= 0 else at + inside, stop
            at = stop + 1
        return ("literal", first, last, "".join(x.strip() for x in text[first:last].split("\n"))) if first >= 0 else None


def pairs(text: str) -> list[tuple[str, int, int]]:
    """name, and start and end of a literal on its right side."""
    lexer = Lexer(text)
    return [(n, s, e) for n, parts in zip(lexer.names, lexer.parts, strict=True) for k, s, e, _ in parts if k == "literal"]


def literals(text: str) -> list[tuple[int, int, float]]:
    """Literals with the score of the most sensitive name that they reach."""
    lexer = Lexer(text)
    places = defaultdict(list)
    for i, (name, scope) in enumerate(zip(lexer.names, lexer.scopes, strict=True)):
        if lexer.first[i] == i:
            places[scope, name].append(i)
    refers: list[list[int]] = []
    for parts, scope, own in zip(lexer.parts, lexer.scopes, lexer.first, strict=True):
        ahead = []
        for kind, _, _, said in parts:
            if kind == "name" and (at := places.get((scope, said)) or places.get((0, said))):
                k = bisect_left(at, own)
                ahead.append(at[k - 1] if k else next((x for x in at[k : k + 2] if x != own), -1))
            else:
                ahead.append(-1)
        refers.append(ahead)
    value = values(lexer, refers)
    random = [literal_score(*v) for v in value]
    score = [name_score(n) + x / 2 if x else 0.0 for n, x in zip(lexer.names, random, strict=True)]
    best: dict[tuple[int, int], float] = {}
    done, opened = [False] * len(score), set()
    for i in sorted(range(len(score)), key=lambda i: -score[i]):  # the most sensitive first, so each assignment is reached once
        todo, reach = [i], score[i]
        if reach < THRESHOLD:
            break
        while todo:
            k = todo.pop()
            if done[k]:
                continue
            done[k] = True
            for (kind, s, e, said), to in zip(lexer.parts[k], refers[k], strict=True):
                if to >= 0:
                    if to not in opened:
                        opened.add(to)
                        several = lexer.alternatives(to)
                        todo += [x for x in several if len(several) == 1 or random[x] > 0]
                elif kind == "literal" or IDENTIFIER.match(said):
                    best.setdefault((s, e), reach)
    return [(s, e, x) for (s, e), x in best.items()]


def values(lexer: Lexer, refers: list[list[int]]) -> list[tuple[Counter, bool]]:
    """Of each assignment's whole value, its characters, and whether it is a reference and nothing else; names without a value here stand for
    themselves, others for the longest of the alternatives that they may have; cycles add nothing."""
    out: list[tuple[Counter, bool] | None] = [None] * len(refers)
    longest: dict[int, tuple[Counter, bool]] = {}
    busy = [False] * len(refers)
    for i in range(len(refers)):
        todo = [i]
        while todo:
            k = todo[-1]
            if out[k] is not None:
                todo.pop()
                continue
            if not busy[k]:
                busy[k] = True
                todo += [x for r in refers[k] if r >= 0 and r not in longest for x in lexer.alternatives(r) if out[x] is None and not busy[x]]
                continue
            found, reference = Counter(), len(refers[k]) == 1
            for (_, _, _, said), r in zip(lexer.parts[k], refers[k], strict=True):
                if r < 0:
                    more = Counter(ESCAPED.sub(r"\1", said) if "\\" in said else said), bool(REFERENCE.fullmatch(said))
                else:
                    more = (Counter(), False)
                    if r not in longest:
                        several = [out[x] for x in lexer.alternatives(r)]
                        more = max(filter(None, several), key=lambda v: v[0].total(), default=(Counter(), False))
                        if all(several):
                            longest[r] = more
                    more = longest.get(r, more)
                found.update(more[0])
                reference = reference and more[1]
            out[k] = found, reference
            todo.pop()
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Base spans."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def find(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans by start, then kind."""
    base = proposals(text)
    out = [(k, s, e, 1.0, True) for k, s, e in base]
    if BINDING.search(text) and TELLING.search(text):
        taken = Taken((s, e) for _, s, e in base)
        out += [("literal", s, e, round(min(1.0, x / 1.5), 4), False) for s, e, x in sorted(literals(text)) if taken.add(s, e)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def detect(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with a column of spans: kind, start and end in code points, score, base."""
    field = T.StructField(out, T.ArrayType(SPAN))
    return append(df, text, [field], lambda: lambda a: [[[dict(zip(SPAN.names, s, strict=True)) for s in find(x)] for x in a.to_pylist()]])


def digests(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    found = detect(df.select(id_col, text), text, "_spans").drop(text)
    return found.select(id_col, *span_digests(found, "_spans", KINDS))
