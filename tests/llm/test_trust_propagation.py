"""Rules and hosts in plain Python, ranks against a dense iteration."""

import numpy as np
import pytest

from assayline.llm import trust_propagation as tp
from assayline.llm.queries import op7_trust_propagation


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:stop]


def rule_of(host, path):
    fits = [r for r in tp.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


PAGES = [
    (1, "http://Good.COM/a", '<a href="http://friend.org/x">x</a> <a HREF=\'//other.org/\'>'),
    (2, "https://friend.org/?q=1", '<a href="http://far.org/">'),
    (3, "https://bad.example.com/en/1", '<a href="/en/2">'),
    (4, "http://spammer.org#x", '<a href="https://bad.example.com/en/1"> <a href="https://bad.example.com/en/1">'),
    (5, "http://www.example.com/en/", None),
    (6, "http://x.net/es/1", ""),
    (7, "http://x.net/it/1", "nothing"),
    (8, None, "<a href=http://good.com>"),
    (9, "no scheme", ""),
    (10, "a://b://c/d", ""),
    (11, "http://com", ""),
    (12, "http://alone.org/é?x#y", ""),
    (1, "http://Good.COM/a", ""),
    (13, "http://other.org/z", "<a href='http://spammer.org'>"),
]


def ranks(links, seeds, damping=0.85, iterations=400):
    """links: {(src, dst): n}; seeds: {host: weight}."""
    total, out = sum(seeds.values()), {}
    for (s, _), n in links.items():
        out[s] = out.get(s, 0) + n
    base = {h: (1 - damping) * w / total for h, w in seeds.items() if w} if total else {}
    rank = dict(base)
    for _ in range(iterations):
        new = dict(base)
        for (s, d), n in links.items():
            if rank.get(s):
                new[d] = new.get(d, 0) + damping * rank[s] * n / out[s]
        rank = new
    return rank


def test_judged_pages(spark):
    table = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in PAGES], "page_id long, url string, html string, host string, rank int")
    got = tp.judge_urls(table).collect()
    assert len(got) == len(PAGES)
    links = {("good.com", "friend.org"): 1, ("good.com", "other.org"): 1, ("friend.org", "far.org"): 1, ("spammer.org", "bad.example.com"): 2, ("other.org", "spammer.org"): 1}
    allowed, blocked = {}, {}
    for _, url, _ in PAGES:
        host, path = split(url)
        rule = rule_of(host, path)
        if rule and host:
            side = allowed if rule.verdict == "allow" else blocked
            side[host] = side.get(host, 0) + 1
    trust, distrust = ranks(links, allowed), ranks({(d, s): n for (s, d), n in links.items()}, blocked)
    by_id = {r["page_id"]: r for r in got}
    for page_id, url, _ in PAGES:
        host, path = split(url)
        rule, r = rule_of(host, path), by_id[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
        assert r["trust"] == pytest.approx(t) and r["distrust"] == pytest.approx(d)
        assert r["verdict"] == (rule.verdict if rule else "block" if d > t else "allow")
    assert by_id[4]["verdict"] == "block" and by_id[2]["verdict"] == "allow" and by_id[7]["verdict"] == "block" and by_id[12]["verdict"] == "allow"


def test_far_hosts_and_a_cycle_equal_an_exact_solve(spark):
    # A chain beyond any small number of passes, behind a cycle of two, and a component no seed reaches.
    hosts = [f"h{i:02d}" for i in range(24)] + ["x", "y"]
    links = {(f"h{i:02d}", f"h{i + 1:02d}"): 1 for i in range(23)} | {("h01", "h00"): 3, ("x", "y"): 1}
    edges = spark.createDataFrame([(s, d, n) for (s, d), n in links.items()], "src string, dst string, links long")
    seeds = spark.createDataFrame([("h00", 2.0, 0.0), ("h23", 0.0, 1.0)], "host string, trusted double, blocked double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in tp.propagate(edges, seeds, damping=0.5, tolerance=1e-12).collect()}
    for place, (turned, seed) in enumerate(((links, "h00"), ({(d, s): n for (s, d), n in links.items()}, "h23"))):
        step = np.zeros((26, 26))
        for (s, d), n in turned.items():
            step[hosts.index(d), hosts.index(s)] = n / sum(m for (a, _), m in turned.items() if a == s)
        want = np.linalg.solve(np.eye(26) - 0.5 * step, 0.5 * np.array([h == seed for h in hosts]))
        assert all(got.get(h, (0.0, 0.0))[place] == pytest.approx(w, abs=1e-11) for h, w in zip(hosts, want))
        assert all(got[h][place] > 0 for h in hosts[:24])
    assert "x" not in got
    with pytest.raises(RuntimeError):
        tp.propagate(edges, seeds, passes=3)


def test_empty_table(spark):
    assert tp.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op7_trust_propagation(spark, folder).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(urls[r["page_id"]])
        rule = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
