import re
from urllib.parse import urlsplit

import numpy as np
import pytest

from nearfold.llm import linkgraph

URLS = {
    "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "https://example.org/en/1x?q#f": ("example.org", "/en/1x", "example.org/en/1", "block"),
    "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://w.com/fr/": ("w.com", "/fr/", "com/fr/", "allow"),
    "http://com/de/5": ("com", "/de/5", "com/de/", "block"),
    "http://w.com": ("w.com", "", None, "allow"),
    "http://w.org?x=/a": ("w.org", "", None, "allow"),
    "http://w.net/a://b/c": ("w.net", "/a://b/c", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
}


def test_rules(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] + [(90, None, "<a href=//b.com/>"), (None, "http://w.net/", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    found = {r["page_id"]: tuple(r)[1:] for r in linkgraph.judge(pages).collect()}
    for k, u in enumerate(URLS):
        assert found[k] == URLS[u], u
    assert found[90] == ("", "", None, "allow") and found[None] == ("w.net", "/", None, "allow")
    assert linkgraph.judge(pages.limit(0)).count() == 0


def solved(edges, seeds, hosts, damping=0.85):
    """The scores as the solution of a linear system."""
    n = len(hosts)
    m, t = np.zeros((n, n)), np.array([seeds.get(h, 0.0) for h in hosts])
    for (a, b), w in edges.items():
        m[hosts.index(b), hosts.index(a)] = w
    out = m.sum(axis=0)
    m = m / np.where(out == 0, 1, out)
    return dict(zip(hosts, np.linalg.solve(np.eye(n) - damping * m, (1 - damping) * t)))


def test_propagation_solves_its_equation(spark):
    rng = np.random.default_rng(1)
    hosts = [f"h{k}" for k in range(12)]
    edges = {(hosts[a], hosts[b]): int(rng.integers(1, 5)) for a, b in rng.integers(0, 12, (25, 2)) if a != b}
    seeds = {"h0": 1.0, "h3": 2.0}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    found = dict(map(tuple, linkgraph.propagate(df, spark.createDataFrame(list(seeds.items()), "host string, weight double"), tolerance=1e-5).collect()))
    for h, score in solved(edges, seeds, hosts).items():
        assert found.get(h, 0.0) == pytest.approx(score, abs=2e-4)
    assert linkgraph.propagate(df, spark.createDataFrame([], "host string, weight double")).count() == 0


def test_seeds_that_do_not_reach_a_host_leave_its_verdict(spark):
    """n.net is linked by a trusted host and links, as one of two, a blocked one; its verdict stays however many other seeds there are."""
    edges = spark.createDataFrame([("good.org", "n.net", 1), ("n.net", "bad.com", 1), ("n.net", "x.net", 3), ("y.net", "bad.com", 1)], "src string, dst string, n long")
    own = [("good.org", 1, 1, 0), ("bad.com", 1, 0, 1), ("n.net", 1, 0, 0), ("x.net", 1, 0, 0), ("y.net", 1, 0, 0)]
    kinds = "host string, pages long, allowed long, blocked long"
    verdicts = []
    for others in ([], [(f"t{k}.org", 1, 1, 0) for k in range(100)], [(f"b{k}.com", 1, 0, 1) for k in range(100)]):
        found = linkgraph.host_verdicts(spark.createDataFrame(own + others, kinds), edges, tolerance=1e-3).collect()
        verdicts.append({r["host"]: (r["verdict"], round(r["trust"], 6), round(r["distrust"], 6)) for r in found if r["host"] in dict((h, 0) for h, *_ in own)})
    assert verdicts[0] == verdicts[1] == verdicts[2] and verdicts[0]["y.net"][0] == "block" and verdicts[0]["x.net"][0] == "allow"


def test_hosts_near_blocked_seeds_are_blocked(spark):
    def link(*hosts):
        return "".join(f'<p><A class=x HREF="https://{h}/p">t</a><a href="/local">l</a>' for h in hosts)

    rows = [
        (1, "http://good.org/x", link("friend.net", "good.org")), (2, "http://friend.net/", link("other.net")), (3, "http://other.net/", ""),
        (4, "http://bad.com/de/1", link("good.org")), (5, "http://farm.net/1", link("bad.com", "BAD.com")), (6, "http://farm2.net/", link("farm.net")), (7, "http://alone.net/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r["src"], r["dst"]): r["n"] for r in linkgraph.host_edges(pages.withColumn("host", linkgraph.host_of(pages["url"]))).collect()}
    assert edges == {("good.org", "friend.net"): 1, ("friend.net", "other.net"): 1, ("bad.com", "good.org"): 1, ("farm.net", "bad.com"): 2, ("farm2.net", "farm.net"): 1}
    found = {r["host"]: r["verdict"] for r in linkgraph.judge(pages, tolerance=1e-3).collect()}
    assert found == {"good.org": "allow", "friend.net": "allow", "other.net": "allow", "bad.com": "block", "farm.net": "block", "farm2.net": "block", "alone.net": "allow"}


def test_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    found = linkgraph.op6_urls(spark, "/root/testdata/sf0.001")
    assert "Python" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        parts = urlsplit(pages[r["page_id"]])
        host, path = parts.netloc.lower(), parts.path
        fits = [(h + p, v) for v, h, p in linkgraph.RULES if re.search(rf"(^|\.){re.escape(h)}$", host) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert tuple(r) == (r["page_id"], host, path, rule, verdict)
