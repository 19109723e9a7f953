"""Op 3: URL parts and rules by hand, reputations against plain Python."""

import random
import re

from subscope.llm import hosts
from subscope.llm.queries import RULES

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com", "https://Example.com/en/1", "http://www.example.com/en/x?y#z",
    "http://a.www.example.com/en/", "http://example.com/fr/", "ftp://x.net/es/1", "http://net/es/", "http://x.net?q=/es/",
    "http://x.net#/fr/", "a://b://c.com/d", "http://x.org/A/B?c", "http://com/", "http://ÄB.com/é", "://h.com/p",
    "http://notexample.com/en/", "http://x.net/fr", "http://u:p@h.net:80/fr/\n/x", "http://h.com\\x/",
]


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    fit = [(h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def plain_shrunk(units):
    num = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in units.values())
    den = sum(n * (n - 1) * m * (1 - m) for n, k, m in units.values())
    rho = min(max(num / den if den else 0.0, 1e-4), 0.9999)
    c = 1 / rho - 1
    return {u: (c * m + k, c * (1 - m) + n - k) for u, (n, k, m) in units.items()}


def test_rules_and_reputations(spark):
    rng = random.Random(6)
    rows = list(enumerate(URLS))
    rates = {"good.a.org": 0.97, "bad.b.org": 0.03, "x.a.org": 0.9, "bad.c.net": 0.1, "few.c.net": 0.5}
    for h, rate in rates.items():
        for _ in range(60 if h != "few.c.net" else 2):
            rows.append((len(rows), f"http://{h}/p{len(rows)}"))
    label = {i: rng.random() < rates.get(plain(u)[0], 0.8) for i, u in rows if rng.random() < 0.8}
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(list(label.items()), "page_id long, good boolean")
    got = {r.page_id: r for r in hosts.judge(pages, labels, RULES).collect()}
    host = {i: plain(u)[0] for i, u in rows}
    count = {}
    for i, h in host.items():
        n, k = count.get(h, (0, 0))
        count[h] = (n + (i in label), k + label.get(i, False))
    dom, suf = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]

    def total(key):
        out = {}
        for h, (n, k) in count.items():
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + k)
        return out

    n0, k0 = map(sum, zip(*count.values()))
    mean = lambda ab: ab[0] / sum(ab)
    s = plain_shrunk({u: (n, k, (k0 + 1) / (n0 + 2)) for u, (n, k) in total(suf).items()})
    d = plain_shrunk({u: (n, k, mean(s[suf(u)])) for u, (n, k) in total(dom).items()})
    h = plain_shrunk({u: (n, k, mean(d[dom(u)])) for u, (n, k) in count.items()})
    assert len(got) == len(rows)
    for i, u in rows:
        hp = plain(u)
        rule, action = plain_rule(*hp)
        a, b = h[hp[0]]
        upper = a / (a + b) + 1.645 * (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5
        r = got[i]
        assert (r.host, r.path, r.rule) == (*hp, rule), u
        assert r.verdict == (action or ("block" if upper < 0.5 else "allow"))
        assert abs(r.reputation - a / (a + b)) < 1e-6
    assert {got[i].verdict for i, u in rows if "bad.b.org" in (u or "")} == {"block"}


def test_empty_repeated_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/")],
                                  "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    got = hosts.judge(pages, none, RULES).collect()
    assert [r.verdict for r in got] == ["allow"] * 3
    assert hosts.judge(pages.limit(0), none, []).count() == 0
