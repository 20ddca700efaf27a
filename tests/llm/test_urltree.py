"""Hosts, paths, rules, and templates learned from labelled pages."""

from __future__ import annotations

import re
from urllib.parse import quote

import pytest

from tallmat.llm import urltree
from tallmat.llm.urltree import ALLOW, BLOCK, Rule

RULES = [Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/")]
URLS = {
    "http://A.Example.NET/en/1?x=/de/": ("a.example.net", "/en/1", "example.net/en/", ALLOW),
    "https://example.net/EN/1": ("example.net", "/EN/1", "net/", BLOCK),
    "https://badexample.net/en/1": ("badexample.net", "/en/1", "net/", BLOCK),
    "http://net": ("net", "", None, ALLOW),
    "http://net/": ("net", "/", "net/", BLOCK),
    "http://x.net?/en/": ("x.net", "", None, ALLOW),
    "http://x.net#a/b": ("x.net", "", None, ALLOW),
    "ftp://example.com/de/?q#f": ("example.com", "/de/", "example.com/de/", BLOCK),
    "http://example.com/de": ("example.com", "/de", None, ALLOW),
    "http://ÄÖ.org/fr/://x": ("ÄÖ.org", "/fr/://x", "org/fr/", ALLOW),
    "example.net/en/": ("", "", None, ALLOW),
    "://": ("", "", None, ALLOW),
    "": ("", "", None, ALLOW),
    None: ("", "", None, ALLOW),
    "http://" + "a/" * 5000: ("a", "/" + "a/" * 4999, None, ALLOW),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    out = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urltree.judge(df, RULES).collect()}
    assert out == URLS


def plain_shape(path):
    parts = ["<hex>" if re.fullmatch("[0-9a-fA-F-]{16,}", s) else re.sub("[0-9]+", "#", s) for s in path.split("/")[1:]]
    return parts if len(parts) <= 8 else parts[:7] + ["/".join(parts[7:])]


def plain_templates(pages):
    """The tree by recursion: ``(host, path, bad)`` to ``{(host, path): (template, purity, rejected)}``."""
    out = {}

    def purity(group, parent):
        bad, good = (sum(p[2] == k for p in group) for k in (1, 0))
        return (bad + 2 * parent) / (bad + good + 2)

    def grow(host, prefix, group, above):
        here = purity(group, above)
        done = [p for p in group if len(plain_shape(p[1])) == len(prefix)]
        if done:
            labelled = [p for p in done if p[2] is not None]
            # Pages that end here are a node of their own only where others go on; a node's purity counts all below it.
            for p in done:
                out[p[:2]] = ("/" + "/".join(prefix), here, bool(labelled) and here >= 0.8)
        below = {}
        for p in group:
            if len(plain_shape(p[1])) > len(prefix):
                below.setdefault(plain_shape(p[1])[len(prefix)], []).append(p)
        everyone = [p for ps in below.values() for p in ps]
        grown = {}
        for segment, ps in below.items():
            square, share = 0.0, len(ps) / len(everyone)
            for kind in (1, 0, None):
                whole = sum(p[2] == kind for p in everyone)
                if whole:
                    square += (sum(p[2] == kind for p in ps) - whole * share) ** 2 / (whole * share)
            apart = len(below) == 1 or square * len(everyone) > 9.21 * (len(everyone) - len(ps))
            grown.setdefault(segment if len(ps) >= 5 and apart else "*", []).extend(ps)
        for branch, ps in grown.items():
            grow(host, [*prefix, branch], ps, here)

    for host in {p[0] for p in pages}:
        group = [p for p in pages if p[0] == host]
        grow(host, [], group, 0.5)
    return out


def labelled_pages():
    rows = []
    for i in range(60):
        rows.append(("shop.a", f"/item/{i}", None))
        rows.append(("shop.a", f"/casino/{'xyzw'[i % 4]}{chr(97 + i % 26)}/{i}", 1 if i % 3 else None))
        rows.append(("shop.a", f"/news/{chr(97 + i % 26)}{i % 7}/story-{i}.html", 0 if i % 2 else None))
        rows.append(("b.org", f"/{chr(97 + i % 26)}{chr(97 + i % 5)}/{i}", [1, 0, None][i % 3]))
        rows.append(("c.org", "/only", 1 if i == 0 else None))
        rows.append(("deep.org", "/a" * 12 + f"/{i}", 1))
    return rows + [("c.org", "", None), ("c.org", "/", None), ("", "", 1), ("d.org", "/*/x", 0), ("d.org", "/" + "0f" * 8, 1)]


def test_templates_equal_a_plain_version(spark):
    pages = labelled_pages()
    rows = [(i, f"http://{quote(h)}{p}" if h else None, b) for i, (h, p, b) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, known int").repartition(4)
    labels = df.where("known IS NOT NULL").selectExpr("page_id", "known AS bad")
    out = urltree.judge(df, labels=labels)
    assert out.columns == [*df.columns, "host", "path", "rule", "verdict", "template", "purity"]
    plain = plain_templates(pages)
    for r in out.collect():
        template, purity, rejected = plain[r["host"], r["path"]]
        assert r["template"] == template and r["purity"] == pytest.approx(purity), r
        assert r["verdict"] == (BLOCK if rejected else ALLOW) and r["rule"] is None
    judged = {r["url"]: r["verdict"] for r in out.collect()}
    assert all(v == BLOCK for u, v in judged.items() if u and "/casino/" in u)
    assert all(v == ALLOW for u, v in judged.items() if u and ("/news/" in u or "/item/" in u))


def test_odd_rows_and_an_empty_table(spark):
    rows = [(1, "http://x.net/a"), (1, "http://x.net/a"), (None, "http://x.net/b"), (2, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS Shape", "3 AS verdict", "4 AS rejected", "5 AS bad")
    out = urltree.judge(df, RULES, spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id bigint, bad int"))
    assert out.columns == [*df.columns, "_host", "path", "rule", "_verdict", "template", "purity"] and out.count() == 4
    assert urltree.judge(df.limit(0), RULES).count() == 0
