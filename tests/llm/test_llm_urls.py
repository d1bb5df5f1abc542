"""The URL filter against a plain Markov model in memory."""

import collections
import hashlib
import math
import re

import duckdb
import pytest

from marketday.llm import urls

SCHEMA = "page_id bigint, url string, html string, host string, n int, gram string, verdict string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "h", "x", 1, "g", "v") for i, u in rows], SCHEMA).repartition(3)


def host_path(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(url, rules):
    host, path = host_path(url)
    best = None
    for verdict, text in rules:
        own, begin = text[: text.index("/")], text[text.index("/") :]
        if (host == own or host.endswith("." + own)) and path.startswith(begin) and (best is None or len(text) > len(best[1])):
            best = (verdict, text)
    return best or (None, None)


def brute(rows, rules, order=urls.ORDER):
    def spelled(u):
        s = urls.START * order + u + urls.END
        return [s[i : i + order + 1] for i in range(len(u) + 1)]

    def held(u):
        return hashlib.md5(u.encode()).hexdigest()[0] in urls.HELD

    texts = [(u or "") for _, u in rows]
    ruled = [rule_of(u, rules)[0] for _, u in rows]
    alphabet = {g[-1] for u in texts for g in spelled(u)}
    models = {}
    for kind in ("allow", "block"):
        seen = collections.Counter()
        for u, r in zip(texts, ruled):
            if r == kind and not held(u):
                for g in spelled(u):
                    for k in range(order + 1):
                        seen[g[order - k :]] += 1
        after = collections.defaultdict(dict)
        for g, n in seen.items():
            after[(len(g), g[:-1])][g[-1]] = n
        models[kind] = after

    def chance(kind, g):
        p = 1 / len(alphabet)
        for k in range(order + 1):
            nexts = models[kind].get((k + 1, g[order - k : -1]), {})
            total = sum(nexts.values())
            if total:
                p = (nexts.get(g[-1], 0) + len(nexts) * p) / (total + len(nexts))
        return p

    def rounded(x):  # halves away from zero
        return int(math.copysign(math.floor(abs(x) + 0.5), x))

    grams = {g for u in texts for g in spelled(u)}
    ratio = {g: rounded((math.log(chance("allow", g)) - math.log(chance("block", g))) * urls.FINE) for g in grams}
    norm = [rounded(sum(ratio[g] for g in spelled(u)) / (len(u) + 1)) for u in texts]
    marked = [(n // urls.BIN, r) for u, n, r in zip(texts, norm, ruled) if r and held(u)]
    a, b = (sum(r == k for _, r in marked) for k in ("allow", "block"))
    edge = 0
    if a and b:
        cuts = {s for s, _ in marked}
        edge = urls.BIN * min(cuts, key=lambda c: (-sum(b if r == "allow" else 0 for s, r in marked if s >= c) - sum(a if r == "block" else 0 for s, r in marked if s < c), abs(c), c))
    out = []
    for (i, u), r, n in zip(rows, ruled, norm):
        out.append((i, *host_path(u), rule_of(u, rules)[1], r or ("allow" if n >= edge else "block"), n, edge))
    return collections.Counter(out)


ODD = [
    (900, None), (901, ""), (902, "no scheme"), (903, "HTTP://WWW.Example.COM/en/A?x=/de/"), (904, "ftp://example.com"), (905, "http://example.com?/en/"),
    (906, "http://notexample.com/en/"), (907, "http://sub.www.example.com/en/x#y"), (908, "a://b://c.com/"), (909, "http://é.net/es/😀\nz"),
    (910, "http://x.org/" + "long/" * 20_000), (None, "http://no.id.org/"), (903, "http://other.net/fr/"),
]


def urls_of(n):
    return [(i, f"http://h{i % 7}.{'example' if i % 2 else 'shop'}.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'es', 'fr')[i % 4]}/{i * 37 % 101}") for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        urls_of(150) + ODD + ODD[:4] + [(5, "http://hot.example.net/es/1")] * 80 + [(2000 + i, "http://hot.org/en/1") for i in range(90)],
        urls_of(3),
        [(1, "http://only.org/")],  # nothing to learn from
        [(1, None), (1, None)],
    ],
)
def test_url_filter(spark, rows):
    got = urls.digest(frame(spark, rows))
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert collections.Counter(map(tuple, got.collect())) == brute(rows, urls.RULES)


def test_own_rules_and_columns(spark):
    rules = (("block", "org/"), ("allow", "h1.shop.org/en/"), ("allow", "net/"))
    rows = urls_of(60)
    out = urls.filter_urls(frame(spark, rows), rules)
    assert {"page_id", "url", "html", "n", "gram", "host", "path", "rule", "verdict", "log_ratio", "threshold"} == set(out.columns)
    got = out.select("page_id", "host", "path", "rule", "verdict", "log_ratio", "threshold").collect()
    assert collections.Counter(map(tuple, got)) == brute(rows, rules)


def test_urls_of_nothing(spark):
    assert urls.digest(frame(spark, []).limit(0)).collect() == []


def test_url_filter_sql(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    out = urls.digest(pages)
    theirs = con.execute(f"SELECT {', '.join(out.columns)} FROM ({urls.SQL})").fetchall()
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(theirs)
