"""PII and secrets against the contract's patterns, read plainly."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import pii, secret_scan

PII_TEXT = st.text(alphabet="aB9@.+-() %_1470é\n", max_size=60)
SECRET_TEXT = st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "a1b2c3d4", "0f" * 9, "ſecret", "secret", "x", "\n", "db_pass", "é"]), max_size=14).map("".join)


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 14 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def plain_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


@settings(max_examples=1500, deadline=None)
@given(PII_TEXT)
def test_pii_base(text):
    assert [x[:3] for x in pii.find(text) if x[4]] == plain_pii(text)


@settings(max_examples=1500, deadline=None)
@given(SECRET_TEXT)
def test_secret_base(text):
    assert [x[:3] for x in secret_scan.find(text) if x[4]] == plain_secrets(text)


def test_method_adds_spans():
    text = "My ssn is 123-45-6789, IBAN DE89 3704 0044 0532 0130 00, call 212-555-0187."
    assert [x[0] for x in pii.find(text)] == ["ssn", "iban", "local_phone"]
    assert pii.redact(text, pii.find(text)) == "My ssn is <SSN>, IBAN <IBAN>, call <LOCAL_PHONE>."
    assert pii.find("no context 123-45-6789 and DE88 3704 0044 0532 0130 00") == []
    text = 'x1 = "k9$fQ2!zP0aa"\nprint(1)\ndb_password = x1\nname = "Peter Smith"\n'
    assert [(x[0], text[x[1] : x[2]]) for x in secret_scan.find(text)] == [("literal", "k9$fQ2!zP0aa")]


def test_long_words_take_linear_time():
    for c in ("a", "1", "1 ", "+1 ", "a.", "1.", "0a", "password"):
        pii.find(c * 60_000)
        secret_scan.find(c * 60_000)
    pii.find("a@" * 60_000)


def test_literals_of_any_length():
    long = "aB3$x9Kq" * 700
    for text, value in ((f'signing_key = "{long}"', long), (f"signing_key = {'aB3x9Kq/' * 700}", "aB3x9Kq/" * 700), (f"<signing_key>{long}</signing_key>", long), ('signing_key' + " " * 12 + '=' + "\t" * 12 + '"aB3$x9Kq2!zP"', "aB3$x9Kq2!zP"), ("x_" * 60 + 'signing_key = "aB3$x9Kq2!zP"', "aB3$x9Kq2!zP")):
        assert [(x[0], text[x[1] : x[2]]) for x in secret_scan.find(text)] == [("literal", value)]


SECRET = "aB3$x9Kq2!zP"
CODE = [
    ('cfg["db_pwd"] = "{}"', [SECRET]),
    ('m["a"]["db_pwd"] = "{}"', [SECRET]),
    ('self.db_pwd = "{}"', [SECRET]),
    ('db_pwd: str = "{}"', [SECRET]),
    ('x = pwd = "{}"', [SECRET]),
    ('x=pwd="{}"', [SECRET]),
    ('db_pwd = "k9$f" + "Q2!zP0aa"', ["k9$f", "Q2!zP0aa"]),
    ('A = "k9$fQ"\nB = "2!zP0aa"\ndb_pwd = A + B', ["k9$fQ", "2!zP0aa"]),
    ('const dbPwd = (\n  "aB3$x9" +\n  "Kq2!zP"\n);', ["aB3$x9", "Kq2!zP"]),
    ('db_pwd = """{}"""', [SECRET]),
    ("db_pwd = 'a\\'B3$x9Kq2!zP'", ["a\\'B3$x9Kq2!zP"]),
    ('db_pwd = LATER\nLATER = "{}"', [SECRET]),
    ('A = "{}"\nB = A\nC = B\ndb_pwd = C', [SECRET]),
    ('A = "{}"\ndb_pwd = A\nA = "something else"', [SECRET]),
    ("db_pwd: |\n  aB3$x9Kq2!\n  zPq8\nother: 1", ["aB3$x9Kq2!\n  zPq8"]),
    ("a:\n  db_pwd: >-\n    {}\n  b: 1", [SECRET]),
    ("[db]\npwd={}\n", [SECRET]),
    ("db_pwd    =    {}   # the key", [SECRET]),
    ("export DB_PWD=${{X}}\nX={}", [SECRET]),
    ('{{"db_pwd": "{}", "n": 1}}', [SECRET]),
    ("{{'db_pwd' => '{}'}}", [SECRET]),
    ('<add key="db_pwd" value="{}"/>', [SECRET]),
    ("<db_pwd>{}</db_pwd>", [SECRET]),
    ('# db_pwd = "{}"', [SECRET]),
    ('/* db_pwd = "{}" */', [SECRET]),
    ('# OLD = "{}"\ndb_pwd = OLD\n', []),
    ('db_pwd = get("{}")', []),
    ('db_pwd = conf["{}"]', []),
    ("a = b\nb = a\ndb_pwd = a", []),
    ("it's the key: don't \"quote\" = pass", []),
    ('title = "{}"', []),
    ('db_pwd == "{}"', []),
    ("see http://key/{}", []),
    ('db_pwd = "$ecretP4ss!9zQ"', ["$ecretP4ss!9zQ"]),
    ('db_pwd = "$DB_PASS_WORD_1"', []),
    ('db_pwd = "${{DB_PASS_WORD_1}}"', []),
    ('db_pwd = "aB3x 9Kq2!zPq7"', ["aB3x 9Kq2!zPq7"]),
    ('db_pwd = "correct horse battery staple"', ["correct horse battery staple"]),
    ('db_pwd = "a sentence that tells the user what a good word would have to look like"', []),
    ('user, db_pwd = "somebody", "{}"', [SECRET]),
    ('user, db_pwd, n = "somebody", "{}", 12', [SECRET]),
    ('connect(user, db_pwd="{}")', [SECRET]),
    ('db_pwd = x or "{}"', [SECRET]),
    ('db_pwd = x || y || "{}"', [SECRET]),
    ('db_pwd = get("n") ?? "{}"', [SECRET]),
    ('db_pwd = os.environ.get("n", f(x)) or "{}"', [SECRET]),
    ('db_pwd = x ?: "{}"', [SECRET]),
    ('db_pwd = x ? "{}" : "y"', [SECRET]),
    ('db_pwd = x ? "y" : "{}"', [SECRET]),
    ('db_pwd = "{}" if x else "y"', [SECRET]),
    ('db_pwd = "y" if len(x) > 3 else "{}"', [SECRET]),
    ('A = "{}"\ndb_pwd = x or A', [SECRET]),
    ('#define DB_PWD "{}"\n', [SECRET]),
    ('#define LIT "{}"\nchar *db_pwd = LIT;', [SECRET]),
    ('db_pwd <- "{}"', [SECRET]),
    ("define('DB_PWD', '{}');", [SECRET]),
    ('os.environ.setdefault("DB_PWD", "{}")', [SECRET]),
    ('print("pwd", "{}")', []),
    ("db_pwd: &a {}\n", [SECRET]),
    ("db_pwd: !str {}\n", [SECRET]),
    ("//registry.x/:_authToken={}", [SECRET]),
]


def test_constructs():
    for text, want in CODE:
        text = text.format(SECRET) if "{" in text else text
        assert [text[x[1] : x[2]] for x in secret_scan.find(text) if x[0] == "literal"] == want, text


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["pwd", "a", " = ", ": ", "|\n", ">\n", "\n", "  ", '"', "'", '"""', "+", "(", ")", "[", "]", "#", "//", "/*", "*/", "<!--", "-->", "$", "{", "}", "\\", "aB3$x9Kq2!", "é", "<a>", "</a>", "=", ".", "key", "value"]), max_size=25).map("".join))
def test_any_text_lexes(text):
    spans = secret_scan.find(text)
    added = [x for x in spans if not x[4]]
    assert all(0 <= x[1] < x[2] <= len(text) for x in added)
    assert all(a[2] <= b[1] for a, b in zip(added, added[1:]))
    assert not any(a[1] < b[2] and b[1] < a[2] for a in added for b in spans if b[4])


NAMES = ["db_pwd", "apiToken", "SIGNING_SECRET", "color", "path", "n", "A", "B"]
WAYS = ['{n} = {v}', '{n}: {v}', 'let {n} = {v};', 'self.{n} = {v}', 'export {n}={v}', '{n} := {v}', '{n} <- {v}', 'if x: {n} = x or {v}', '{n} = c ? {v} : 1', '  {n} = (\n  {v})', '{n} = {v} # note', '{n} = f(1) || {v}']


@st.composite
def programs(draw):
    """A text of assignments, and the literals that reach a sensitive name, by what was written and not by reading it."""
    lines, bound, at, n = [], [], 0, draw(st.integers(1, 8))
    for k in range(n):
        name, way = draw(st.sampled_from(NAMES)), draw(st.sampled_from(WAYS))
        kind = draw(st.sampled_from(["strong", "strong", "weak", "name", "both"]))
        strong = f"aB{k}$x9Kq2!zP"
        ref = draw(st.sampled_from(["A", "B"]))
        parts = {"strong": [strong], "weak": ["ab"], "name": [(ref,)], "both": [(ref,), strong]}[kind]
        if "self." in way or ":" in way and "?" not in way:
            bound_name = f"self.{name}" if "self." in way else name
        else:
            bound_name = name
        value = " + ".join(p[0] if isinstance(p, tuple) else f'"{p}"' for p in parts)
        lines.append(way.format(n=name, v=value))
        bound.append((bound_name, parts))
    return "\n".join(lines) + "\n", bound


@settings(max_examples=500, deadline=None)
@given(programs())
def test_programs(program):
    text, bound = program

    def behind(i, ref, seen):
        """Which assignment a name on the right of assignment i stands for."""
        before = [k for k in range(i) if bound[k][0] == ref]
        after = [k for k in range(i + 1, len(bound)) if bound[k][0] == ref]
        return before[-1] if before else after[0] if after else None

    def literals_of(i, seen):
        if i in seen:
            return []
        out = []
        for p in bound[i][1]:
            if not isinstance(p, tuple):
                out.append(p)
            elif (k := behind(i, p[0], seen)) is not None:
                out += literals_of(k, seen | {i})
        return out

    want = set()
    for i, (name, _) in enumerate(bound):
        if any(x in name.lower() for x in ("pwd", "token", "secret")):
            found = literals_of(i, frozenset())
            if any(len(x) > 8 for x in found):
                want |= {x for x in found if len(x) > 8}
    got = {text[x[1] : x[2]] for x in secret_scan.find(text) if not x[4]}
    assert {x for x in got if len(x) > 8} == {x for x in want if not any(b[4] and text[b[1] : b[2]].rstrip('"').endswith(x) for b in secret_scan.find(text))}, text


def seconds(f, text):
    began = time.perf_counter()
    f(text)
    return time.perf_counter() - began


def test_time_grows_with_the_text():
    kinds = ["a", "a.", "a ", "a=", 'a="', "a = ", "a:'b", "<a>", "<a>b", "=", " ", '"', "a=`b ", "'\\", "/*", '"""', "a=a+", "a: |\n", "(", "a=(\n", "a=b\n", "pwd=x+\n", "<!--", "# ", "a=+", "a=.", "a=x ", "[", "a[b]=", "a=$", 'pwd="aB3$x9Kq2!" ', "pwd=1,", "a,", "a,b=", "a if ", "a or ", "a=b?", "a=b||", "a=f(", "define('a','b", "#define a\n", "a:&b "]
    for c in kinds:
        assert seconds(secret_scan.find, "key = " + c * 20_000) < 3, c
    chain = "".join(f"x{i} = x{i - 1} + x{i - 1}\n" for i in range(1, 3000))
    assert [x[0] for x in secret_scan.find('x0="aB3$"\n' + chain + "pwd = x2999")] == ["literal"]
    many = "A = x" + ' or "aB3$x9Kq2!"' * 10_000 + "\n"
    assert seconds(secret_scan.find, many + "pwd = A\n" * 10_000) < 6
    for c in ("555-123-4567 phone ", "10.0.0.1 ", "call 212-555-0187, ", "DE89 3704 0044 0532 0130 00 ", "1.2.3." + "0" * 6_000 + " "):
        assert seconds(pii.find, c * (20_000 if len(c) < 99 else 50)) < 5, c


def test_long_numbers_and_names():
    text = "1.2.3." + "0" * 5_000 + " and " + "9" * 6_000 + ".1.1.1"
    assert [x[:3] for x in pii.find(text)] == [("ip", 0, 5_006)]
    long = SECRET * 9_000
    assert [text[x[1] : x[2]] for text in [f'{"n_" * 50_000}pwd = "{long}"'] for x in secret_scan.find(text)] == [long]


def plain_further(text):
    """Spans beside the base ones, one after another against all that were taken."""
    taken = [x[1:] for x in plain_pii(text)]
    out = []
    for kind in pii.EXTRA:
        if kind == "iban":
            found = [(s, e) for s in range(len(text)) for e in range(s + 15, min(len(text), s + 70) + 1) if plain_iban(text, s, e)]
        else:
            pattern = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])" if kind == "ssn" else r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
            found = [m.span() for m in re.finditer(pattern, text)]
            found = [(s, e) for s, e in found if kind != "ssn" or text[s : s + 3] not in ("000", "666") and text[s] != "9" and text[s + 4 : s + 6] != "00" and text[e - 4 : e] != "0000"]
        for s, e in found:
            words = re.split(r"[\W_]+", text[max(0, s - 40) : s].lower()) + re.split(r"[\W_]+", text[e : e + 20].lower())
            near = any(w in pii.WORDS[kind].split() for w in words)
            if (kind == "iban" or near) and not any(s < b and a < e for a, b in taken):
                taken.append((s, e))
                out.append((kind, s, e))
    return sorted(out, key=lambda x: x[1])


def plain_iban(text, s, e):
    part = text[s:e]
    code = part.replace(" ", "")
    if re.match("[A-Za-z0-9]", text[s - 1 : s]) or re.match("[A-Za-z0-9]", text[e : e + 1]) or "  " in part or part[:1] == " " or part[-1:] == " " or " " in part[:4]:
        return False
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", code) or pii.IBAN_OF.get(code[:2]) != len(code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 33", " IS MY", " ", ", ", "phone", "call", "ssn", "social ", "123-45-6789", "000-12-3456", "212-555-0187", "(212) 555 0187", "4111 1111 1111 1111", "10.1.2.3", "+1 212 555 0187", "a@b.co", "x" * 45, "é"]), max_size=12).map("".join))
def test_further_spans(text):
    assert [x[:3] for x in pii.find(text) if not x[4]] == plain_further(text)


def test_spark(spark):
    rows = [(1, "mail a.b@c.de, +1 (212) 555-0187", "x"), (1, "mail a.b@c.de, +1 (212) 555-0187", "x"), (2, None, None), (None, "", "é"), (3, "é 10.0.0.256 10.0.0.1 token = 'abcdefgh12'", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.digests(df).collect()
    assert len(found) == 5
    got = {(r.doc_id, r.spans): r for r in found}
    assert got[3, "ip:13:21"].n_ip == 1
    assert got[1, "email:5:13,phone:15:32"].base_sha256 == hashlib.sha256(b"email:5:13,phone:15:32").hexdigest()
    assert got[2, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    secrets = secret_scan.digests(df).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in secrets) == [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 0, ""), (3, 1, "assign:22:41")]
    assert secret_scan.detect(df).columns == ["doc_id", "text", "spans", "secrets"]
    assert pii.digests(df.where("false")).collect() == [] and secret_scan.digests(df.where("false")).count() == 0
    assert [r.text for r in pii.redacted(df).where("doc_id = 2").collect()] == [None]
    assert {r.text for r in pii.redacted(df).where("doc_id = 1").collect()} == {"mail <EMAIL>, <PHONE>"}
    assert pii.detect(df).columns == ["doc_id", "text", "spans", "pii"]
