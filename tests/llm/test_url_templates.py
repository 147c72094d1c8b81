"""Url parts, rules and the template tree."""

import duckdb
import pandas as pd

from tessera.llm import queries
from tessera.llm import url_templates as ut

URLS = [None, "", "no scheme/en/", "http://", "http://A.Example.NET/en/1?x#y", "https://example.net/EN/2", "https://notexample.net/en/3",
        "https://x.example.com/de/4", "https://example.com/de", "ftp://a.org/fr/5", "http://a.org", "http://a.org?q=/fr/", "http://net/",
        "http://Ünï.NET/ä/1", "a://b://c/d", "http://h.com/a/b/c/d/e/f", "http://h.com//", "http://h.com/\n/x", "http://h.org/fr/1#/?"]
URLS += [f"http://many.com/slug{chr(97 + i)}x/{i}" for i in range(26)] + [f"http://mix.example.com/{s}/{i}.html" for i in range(9) for s in ("de", "en", "de/x")]


def want_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    return host, path


def want_rule(host, path):
    best = None
    for kind, h, p in ut.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = kind, h + p
    return best


def test_parts_rules_and_sql(spark):
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)] + [(3, URLS[4], "twice")], "page_id long, url string, verdict string")
    got = ut.judge(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        u = URLS[r.page_id] if not (r.page_id == 3 and r.host) else URLS[4]
        assert (r.host, r.path) == want_parts(u)
        rule = want_rule(r.host, r.path)
        assert r.rule == (rule and rule[1])
        assert r.verdict == rule[0] if rule else r.verdict in ("allow", "block")
    pages = df.drop("verdict").toPandas()  # noqa: F841  read by the SQL
    have = duckdb.sql(queries.OP7_SQL).df()
    key = lambda rows: sorted(map(str, rows))
    assert key((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == key(
        tuple(None if pd.isna(v) else v for v in r) for r in have[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False))


def test_empty(spark):
    assert ut.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_unlabelled_branches_follow_their_host(spark):
    rows = [("p", f"/x/{i}", "block") for i in range(9)] + [("p", "/y/z", None), ("q", "/x/1", "allow"), ("q", "/y/z", None), ("r", "/y/z", None)]
    tree = {(r.host, r.typed): r.reject for r in ut.template_tree(spark.createDataFrame(rows, "host string, path string, verdict string")).collect()}
    # all hosts: (9 + 1) / (10 + 4) blocked
    assert tree[("p", "/y/z")] and tree[("r", "/y/z")] and tree[("q", "/y/z")]
    more = rows + [("q", f"/x/{i}", "allow") for i in range(9)]
    tree = {(r.host, r.typed): r.reject for r in ut.template_tree(spark.createDataFrame(more, "host string, path string, verdict string")).collect()}
    assert tree[("p", "/y/z")] and not tree[("q", "/y/z")] and not tree[("r", "/y/z")]


def test_tree_generalises_merges_and_rejects(spark):
    rows = [("h", f"/user{chr(97 + i)}/page", "block") for i in range(25)] + [("h", "/userzz/page", None)]  # a wildcard branch
    rows += [("g", f"/a/{i}", "block") for i in range(9)] + [("g", f"/b/{i}", "block") for i in range(3)] + [("g", f"/c/{i}", "allow") for i in range(30)]
    rows += [("g", "/d/1", None)]
    tree = {(r.host, r.typed): r.reject for r in ut.template_tree(spark.createDataFrame(rows, "host string, path string, verdict string")).collect()}
    assert tree[("h", "/userzz/page")] is True
    assert tree[("g", "/a/<n>")] and not tree[("g", "/c/<n>")] and not tree[("g", "/d/<n>")]
