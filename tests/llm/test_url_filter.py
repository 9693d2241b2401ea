import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from juryframe.llm import url_filter
from juryframe.llm.queries import URL_RULES, op6_url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(t), k, t) for k, t in URL_RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def tables(spark):
    def make(urls, outcomes):
        pages = spark.createDataFrame([(i, u, None, None) for i, u in urls], "page_id long, url string, host string, bad int")
        return pages, spark.createDataFrame(outcomes, "page_id long, bad boolean")

    return make


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?q#f", "http://example.com", "http://example.com/", "http://example.com/en/", "http://www.example.com/en/", "http://x.www.example.com/en/1", "http://net/es/", "http://a.net/fr/", "http://anet/fr/", "http://a.org?x=/en/", "http://a.org#y/z", "ftp://b.org/p?http://c.com/", "http://Ünï.ÄB.org/é\n/x?", "http://1.2.3.4/a", "http://shop.co.uk/a", "http://b.shop.co.uk:80/a", "x" * 20_000 + "://long.org/" + "y" * 50_000]


def test_parts_and_rules(tables):
    pages, outcomes = tables(list(enumerate(URLS)), [])
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, outcomes, URL_RULES).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        kind, rule = rule_of(host, path)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
        assert found[i]["verdict"] == (kind or "allow")


def test_hierarchy(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.org",), ("x.b.org",), ("1.2.3.4",), ("",), ("com",)], "host string")
    found = {r[0]: (r[1], r[2]) for r in hosts.select("host", url_filter.domain_of(F.col("host")), url_filter.suffix_of(F.col("host"))).collect()}
    other = hosts.select("host", url_filter.domain_of(F.col("host"), ("b.co.uk", "co.uk"))).collect()
    assert {r[0]: r[1] for r in other}["a.b.co.uk"] == "a.b.co.uk"
    assert found == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.org": ("b.org", "org"), "x.b.org": ("b.org", "org"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "": ("", ""), "com": ("com", "com")}


def test_names(spark):
    hosts = ["a.org", "a.org.", "a.org:8080", "me:word@a.org:80", "me@a.org", "a.org..:"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0] for r in df.select(url_filter.name_of(F.col("host"))).collect()} == {"a.org"}


def beta_above(a, b, limit):
    """P(rate > limit) by a fine sum over the logarithm of the odds."""
    import numpy as np

    t = np.linspace(-40, 40, 400_001)
    logs = -a * np.logaddexp(0, -t) - b * np.logaddexp(0, t)
    w = np.exp(logs - logs.max())
    return w[1 / (1 + np.exp(-t)) > limit].sum() / w.sum()


def test_beta(spark):
    from juryframe.llm.beta import beta_cdf

    rows = [(0.5, 0.5, 0.3), (1.0, 9.0, 0.05), (80.0, 900.0, 0.09), (3.5, 20_000.0, 0.0002), (900.0, 80.0, 0.93), (40_000.0, 60_000.0, 0.401)]
    df = spark.createDataFrame(rows, "a double, b double, x double")
    for r in df.select("a", "b", "x", beta_cdf(F.col("x"), F.col("a"), F.col("b")).alias("p")).collect():
        assert 1 - r["p"] == pytest.approx(beta_above(r["a"], r["b"], r["x"]), abs=2e-4)


def shrunk(keys, counts, means):
    """The posterior of each key by the formulas of the module, in plain Python."""
    used = [k for k in keys if counts[k][0]]
    s = sum(counts[k][0] * (counts[k][1] / counts[k][0] - means[k]) ** 2 / (means[k] * (1 - means[k])) for k in used)
    n, c = sum(counts[k][0] for k in used), len(used)
    rho = (s - c) / (n - c) if n > c else 0
    strength = min(max(1 / rho - 1, url_filter.WEAKEST), url_filter.STRONGEST) if rho > 0 else url_filter.STRONGEST
    return {k: (strength * means[k] + counts[k][1], strength * (1 - means[k]) + counts[k][0] - counts[k][1]) for k in keys}


def test_reputation_against_plain_python(tables):
    urls, outcomes, bad_of = [], [], {"spam.evil.org": 0.9, "x.evil.org": 0.7, "fine.org": 0.0, "a.good.net": 0.02, "b.good.net": 0.0}
    for h, (host, rate) in enumerate(bad_of.items()):
        for i in range(60):
            urls.append((1000 * h + i, f"http://{host}/p{i}"))
            outcomes.append((1000 * h + i, i < 60 * rate))
    urls += [(9001, "http://new.evil.org/"), (9002, "http://new.good.net/"), (9003, "http://other.de/")]
    found = {r["host"]: r for r in url_filter.judge_urls(*tables(urls, outcomes), []).collect()}
    hosts = {h: (60, sum(i < 60 * r for i in range(60))) for h, r in bad_of.items()} | {"new.evil.org": (0, 0), "new.good.net": (0, 0), "other.de": (0, 0)}
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    grouped = lambda f: {k: tuple(map(sum, zip(*[hosts[h] for h in hosts if f(h) == k], strict=True))) for k in {f(h) for h in hosts}}
    doms, sufs = grouped(domain), grouped(suffix)
    mean = lambda p: p[0] / sum(p)
    top = (sum(b for _, b in hosts.values()) + url_filter.LIMIT) / (sum(n for n, _ in hosts.values()) + 1)
    post_s = shrunk(sufs, sufs, dict.fromkeys(sufs, top))
    post_d = shrunk(doms, doms, {d: mean(post_s[suffix(d)]) for d in doms})
    post_h = shrunk(hosts, hosts, {h: mean(post_d[domain(h)]) for h in hosts})
    for h, (a, b) in post_h.items():
        above = beta_above(a, b, url_filter.LIMIT)
        assert found[h]["rate"] == pytest.approx(a / (a + b)) and found[h]["above"] == pytest.approx(above, abs=2e-3)
        assert found[h]["verdict"] == ("block" if above >= url_filter.SURE else "allow")
    assert found["spam.evil.org"]["verdict"] == "block" and found["fine.org"]["verdict"] == "allow"
    assert found["new.evil.org"]["rate"] > found["new.good.net"]["rate"]


def test_odd_outcomes_and_repeats(tables):
    urls = [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (2, None)]
    found = url_filter.judge_urls(*tables(urls, [(1, True), (1, None), (None, True), (7, False), (1, False)]), URL_RULES).collect()
    assert len(found) == 4


def test_empty(tables):
    assert url_filter.judge_urls(*tables([], []), URL_RULES).count() == 0
    assert url_filter.judge_urls(*tables([], [(1, True)]), []).count() == 0


def test_ports_share_a_reputation(tables):
    urls = [(i, f"http://spam.org{':8080' if i % 2 else ''}/{i}") for i in range(40)]
    found = url_filter.judge_urls(*tables(urls, [(i, True) for i in range(0, 40, 2)]), []).collect()
    assert {r["verdict"] for r in found} == {"block"} and {r["host"] for r in found} == {"spam.org", "spam.org:8080"}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    sf_dir, verdicts = f"/root/testdata/{size}", set()
    found = defaultdict(list)
    for r in op6_url_filter(spark, sf_dir).collect():
        found[r["page_id"]].append(r)
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        (mine,) = found[r["page_id"]]
        kind, rule = rule_of(*parts(r["url"]))
        assert (mine["host"], mine["path"], mine["rule"]) == (*parts(r["url"]), rule) and (kind is None or mine["verdict"] == kind)
        verdicts |= {mine["verdict"]} if kind is None else set()
    assert verdicts == {"allow", "block"} or size == "sf0.001"
