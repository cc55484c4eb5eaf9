"""Hosts, paths and rules read plainly; the tree rebuilt with dictionaries."""

import re
from collections import Counter, defaultdict

import pytest

from tesserae.llm import url_filter

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_kind(part):
    return "nothing" if part is None else "number" if part == "0" else "wildcard" if part == "*" else "mixed" if "0" in part else "word"


def plain_verdicts(urls, depth=8):
    rows = []
    for u in urls:
        host, path = plain_parts(u)
        parts = ["%2A" if p == "*" else re.sub("[0-9]+", "0", p) for p in path.split("/") if p]
        rows.append((host, path, *plain_rule(host, path), parts if len(parts) <= depth else [*parts[: depth - 1], "%2F".join(parts[depth - 1 :])]))
    template = [""] * len(rows)
    for d in range(depth):
        seen = Counter((r[0], t, r[4][d]) for r, t in zip(rows, template, strict=True) if len(r[4]) > d)
        total = Counter()
        for (h, t, _), n in seen.items():
            total[h, t] += n
        for i, r in enumerate(rows):
            if len(r[4]) > d:
                n = seen[r[0], template[i], r[4][d]]
                template[i] += "/" + (r[4][d] if n >= 2 and n >= 0.02 * total[r[0], template[i]] else "*")
    pages, labelled, blocked, after = Counter(), Counter(), Counter(), defaultdict(Counter)
    for r, t in zip(rows, template, strict=True):
        parts = t.split("/")[1:]
        for k in range(len(parts) + 1):
            x = "".join("/" + p for p in parts[:k])
            pages[r[0], x] += 1
            labelled[r[0], x] += r[3] is not None
            blocked[r[0], x] += r[3] == "block"
            after[r[0], x][plain_kind(parts[k] if k < len(parts) else None)] += 1
    known = sum(r[3] is not None for r in rows)
    prior = sum(r[3] == "block" for r in rows) / (known + 0.5 * (len(rows) - known)) if rows else 0.0
    smooth = lambda b, l, n, above: (b + 2 * above) / (l + 0.5 * (n - l) + 2)  # noqa: E731, E741
    share, evidence = {}, {}
    for h, x in pages:
        if not x:
            share[h, x], evidence[h, x] = smooth(blocked[h, x], labelled[h, x], pages[h, x], prior), labelled[h, x]
    for d in range(1, depth + 1):
        families = defaultdict(list)
        for h, x in pages:
            if x.count("/") == d:
                families[h, x.rsplit("/", 1)[0]].append(x)
        for (h, parent), kids in families.items():
            shares = lambda x, h=h: [after[h, x][k] / pages[h, x] for k in url_filter.KINDS]
            alike = []
            for x in sorted(kids, key=lambda x: ([-s for s in shares(x)], x)):
                if alike:
                    y = alike[-1][-1]
                    n0, n1 = pages[h, y], pages[h, x]
                    chi = 0.0
                    for k in url_filter.KINDS:
                        a, b = after[h, y][k], after[h, x][k]
                        chi += ((n1 / n0) ** 0.5 * a - (n0 / n1) ** 0.5 * b) ** 2 / (a + b) if a + b else 0.0
                    if chi < 9.488:
                        alike[-1].append(x)
                        continue
                alike.append([x])
            for family in alike:
                groups = []
                for x in sorted((x for x in family if labelled[h, x]), key=lambda x, h=h: (blocked[h, x] / labelled[h, x], x)):
                    n1, b1 = labelled[h, x], blocked[h, x]
                    if groups:
                        n0, b0 = labelled[h, groups[-1][-1]], blocked[h, groups[-1][-1]]
                        both = (b0 + b1) / (n0 + n1)
                        spread = both * (1 - both) * (1 / n0 + 1 / n1)
                        if (b0 / n0 - b1 / n1) ** 2 / spread < 3.841 if spread else b0 * n1 == b1 * n0:
                            groups[-1].append(x)
                            continue
                    groups.append([x])
                for g, mine in [(g, g) for g in groups] + [(family, [x for x in family if not labelled[h, x]])]:
                    b, l, n = (sum(c[h, x] for x in g) for c in (blocked, labelled, pages))  # noqa: E741
                    for x in mine:
                        share[h, x], evidence[h, x] = (smooth(b, l, n, share[h, parent]), l) if l else (share[h, parent], evidence[h, parent])
    out = []
    for r, t in zip(rows, template, strict=True):
        rejected = evidence[r[0], t] >= 3 and share[r[0], t] >= 0.5
        out.append((r[0], r[1], r[2], r[3] or ("block" if rejected else "allow"), t, evidence[r[0], t], round(share[r[0], t], 9)))
    return out


ODD = [None, "", "no scheme/en/7", "http://", "https://A.Example.COM/en/7x", "http://example.com/EN/7", "http://notcom/en/", "x://com/en/", "http://h.net?q=/de/", "http://h.net#/de/8", "a://b://c/d", "http://EXAMPLE.net/de/8/*/*//a/b/c/d/e/f/g/h/i", "http://é.ORG/es/é?x#y", "http://user@m.org:80/es/1", "http://long.com/" + "a" * 100_000 + "/en/1", "http://deep.com" + "/en" * 50 + "/7", "http://deep.com" + "/en" * 49]


def test_odd_urls(spark):
    urls = ODD + ODD[-3:] + [f"http://one.com/{'en' if i % 3 else 'fr'}/{i}" for i in range(40)] + [f"http://big.org/{s}/{i}/z" for s in ("es", "it", "a" * 300) for i in range(30)] + [f"http://mix.com/x{i}/{'en' if i % 2 else 'y'}" for i in range(9)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r[0]: tuple(r)[1:] for r in url_filter.judge(df).collect()}
    want = plain_verdicts(urls)
    for i in range(len(urls)):
        assert got[i][:6] == want[i][:6] and got[i][6] == pytest.approx(want[i][6]), urls[i]
    assert url_filter.judge(df.where("false")).count() == 0


def test_templates_without_a_rule(spark):
    """Branches shaped like mostly blocked ones are rejected; others, and hosts with little evidence, are allowed."""
    urls = [f"http://spam.com/{k}/{i}" for k, n in (("en", 60), ("fr", 10), ("it", 10)) for i in range(n)]
    urls += [f"http://spam.com/about/team/{k}-{i}/x" for k in "abcdefgh" for i in range(20)]
    urls += [f"http://fine.com/{k}/{i}" for k, n in (("en", 9), ("fr", 40), ("it", 40)) for i in range(n)]
    urls += [f"http://good.net/{k}/{i}" for k in ("de", "fr") for i in range(300, 340)] + ["http://few.com/en/1", "http://few.com/fr/1", "http://none.it/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {urls[r.page_id]: r.verdict for r in url_filter.judge(df).where("rule is null").collect()}
    by = Counter((u.split("/")[2], u.split("/")[3], v) for u, v in got.items())
    want = {("spam.com", "fr", "block"): 10, ("spam.com", "it", "block"): 10, ("spam.com", "about", "allow"): 160, ("fine.com", "fr", "allow"): 40, ("fine.com", "it", "allow"): 40}
    assert by == want | {("good.net", "fr", "allow"): 40, ("few.com", "fr", "allow"): 1, ("none.it", "en", "allow"): 1}


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = df.select("page_id", "url").collect()
    want = {r.page_id: w for r, w in zip(rows, plain_verdicts([r.url for r in rows]), strict=True)}
    got = {r[0]: tuple(r)[1:] for r in url_filter.judge(df).collect()}
    assert {i: g[:6] for i, g in got.items()} == {i: w[:6] for i, w in want.items()}
    assert {g[3] for g in got.values() if g[2] is None} == {"allow", "block"}
