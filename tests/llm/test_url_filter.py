import random
import re
from collections import Counter, defaultdict

import pytest

from inkveil.llm.url_filter import BLOCK_SHARE, DAMPING, RULES, judge_urls, op9_url_filters, spread


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.target), r.verdict == "block"), default=None)


def brute(pages):
    seeds, links = {"trust": Counter(), "distrust": Counter()}, Counter()
    for _, url, html in pages:
        host, path = split(url)
        if r := rule_of(host, path):
            seeds["trust" if r.verdict == "allow" else "distrust"][host] += 1
        to = set()
        for link in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s<>]+)""", html or ""):
            if m := re.match("(?i)(https?:)?//([^/?#]+)", link):
                to.add(m[2].lower())
            elif not re.match("[A-Za-z][A-Za-z0-9+.-]*:|#", link):
                to.add(host)
        links.update((host, x) for x in to if host)
    scores = {}
    for kind, seed in seeds.items():
        edges = defaultdict(list)
        for (a, b), n in links.items():
            edges[a if kind == "trust" else b].append((b if kind == "trust" else a, n))
        x = {h: (1 - DAMPING) * s for h, s in seed.items()}
        for _ in range(60 if links else 0):
            y = Counter({h: (1 - DAMPING) * s for h, s in seed.items()})
            for a, out in edges.items():
                for b, n in out:
                    y[b] += DAMPING * x.get(a, 0) * n / sum(k for _, k in out)
            x = y
        scores[kind] = x
    out = []
    for i, url, _ in pages:
        host, path = split(url)
        t, d = scores["trust"].get(host, 0), scores["distrust"].get(host, 0)
        r = rule_of(host, path)
        out.append((i, host, path, r and r.target, r.verdict if r else "block" if d > BLOCK_SHARE * (t + d) else "allow"))
    return out


KEY = lambda r: tuple(str(x) for x in r)


def test_query_against_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, op9_url_filters(spark, sf_dir).collect()), key=KEY) == sorted(brute(pages), key=KEY)


def test_links_carry_trust_and_distrust(spark):
    a = lambda *hosts: " ".join(f'<A HREF="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://good.org/a", a("Friend.net")), (2, "http://friend.net/a", a("far.net", "friend.net")), (3, "http://bad.com/de/1", ""),
        (4, "http://spam.net/", a("bad.com")), (5, "http://spam.net/2", "<a href='//bad.com/de/'>"), (6, "http://farm.net/", a("spam.net")), (7, "http://far.net/x?y", a("unseen.net")),
        (8, None, None), (9, "nothing", a("bad.com")), (10, "x://WWW.Example.ORG", ""), (11, "x://sub.example.org/es/z#f", ""), (12, "x://example.org/en/12", ""), (12, "x://example.org/en/12", ""), (13, "http://bad.com/en/", None),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = sorted(map(tuple, judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()), key=KEY)
    assert got == sorted(brute(pages), key=KEY)
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[i] for i in (2, 4, 6, 7, 8, 9, 13)] == ["allow", "block", "block", "allow", "allow", "allow", "block"]
    assert judge_urls(df.limit(0)).count() == 0


def test_generated_graph_with_hubs_circles_and_dead_ends(spark):
    rng = random.Random(11)
    host = lambda: "hub.net" if rng.random() < 0.3 else f"h{rng.randrange(1500)}.{rng.choice(['net', 'org', 'com'])}"
    link = lambda: rng.choice(["/own", "other?x", "#place", "mailto:a@b.c", "javascript:void(0)"]) if rng.random() < 0.5 else f"//{host()}/a"
    pages = [(i, f"http://{host()}/{rng.choice(['fr', 'de', 'en'])}/{i}", "".join(f'<a href="{link()}">' for _ in range(rng.randrange(4)))) for i in range(3000)]
    got = judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=KEY) == sorted(brute(pages), key=KEY)


def test_small_scores_spread_on(spark):
    pages = [(0, "http://bad.com/de/1", "")] + [(i, f"http://h{i}.net/", "<a href='//bad.com/de/1'>") for i in range(1, 201)] + [(201, "http://two.net/", "<a href='//h1.net/'>"), (202, "http://three.net/", "<a href='//two.net/'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.verdict for r in judge_urls(df).collect()} == {"block"}
    chain = spark.createDataFrame([("trust", f"h{i}", f"h{i + 1}", 1.0) for i in range(5)], "kind string, source string, target string, share double")
    with pytest.raises(RuntimeError):
        spread(spark.createDataFrame([("trust", "h0", 1.0)], "kind string, node string, seed double"), chain, rounds=3)
