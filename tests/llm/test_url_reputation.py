import math
import re

import pytest

from skyledger.llm import url_reputation as op

S = op.Settings()


def split(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = found.groups() if found else ("", "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in op.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


def is_suffix(two):
    second, _, last = two.rpartition(".")
    usual = second in op.SECOND_LABELS and re.fullmatch("[a-z]{2}", last) or second and last in op.WILDCARDS
    return two in op.HOSTING or bool(usual) and two not in op.EXCEPTIONS


@pytest.mark.parametrize(
    "host, domain, suffix",
    [
        ("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.in", "b.co.in", "co.in"), ("www.x.com.sg", "x.com.sg", "com.sg"), ("me.github.io", "me.github.io", "github.io"),
        ("a.b.example.com", "example.com", "com"), ("x.go.com", "go.com", "com"), ("a.b.anything.ck", "b.anything.ck", "anything.ck"), ("a.www.ck", "www.ck", "ck"),
        ("co.uk", "co.uk", "co.uk"), ("localhost", "localhost", "localhost"), ("1.2.3.4", "1.2.3.4", "1.2.3.4"), ("u@h.ac.jp:80", "h.ac.jp", "ac.jp"), ("", "", ""),
    ],
)
def test_domains_and_suffixes(spark, host, domain, suffix):
    frame = spark.createDataFrame([(host,)], "host string")
    assert tuple(frame.select(*op._names(frame["host"])).first()) == (domain, suffix)


def reputation(hosts):
    """host -> (n, g): posterior mean and bound, level by level."""
    bare = {h: re.sub(":[0-9]*$", "", re.sub("^.*@", "", h)) for h in hosts}
    two = {h: ".".join(b.split(".")[-2:]) for h, b in bare.items()}
    special = {h: is_suffix(two[h]) for h in hosts}
    domain = {h: ".".join(bare[h].split(".")[-3:]) if special[h] else two[h] for h in hosts}
    suffix = {h: two[h] if special[h] else bare[h].split(".")[-1] for h in hosts}

    def grouped(name):
        sums = {}
        for h, (n, g) in hosts.items():
            a, b = sums.get(name[h], (0, 0))
            sums[name[h]] = (a + n, b + g)
        return sums

    def shrink(groups, parent):
        seen = {k: v for k, v in groups.items() if v[0]}
        over = sum((g - n * parent[k]) ** 2 / n - parent[k] * (1 - parent[k]) for k, (n, g) in seen.items())
        scale = sum(parent[k] * (1 - parent[k]) * (n - 1) for k, (n, _) in seen.items())
        share = min(max(over / scale if scale > 0 else 0, 1 / (1 + S.strongest)), 1 / (1 + S.weakest))
        s = 1 / share - 1
        return {k: (g + s * parent[k]) / (n + s) for k, (n, g) in groups.items()}, s

    n, g = (sum(v[k] for v in hosts.values()) for k in (0, 1))
    suffixes, domains = grouped(suffix), grouped(domain)
    of_suffix, _ = shrink(suffixes, dict.fromkeys(suffixes, (g + 1) / (n + 2)))
    home = {domain[h]: suffix[h] for h in hosts}
    of_domain, _ = shrink(domains, {d: of_suffix[home[d]] for d in domains})
    of_host, s = shrink(hosts, {h: of_domain[domain[h]] for h in hosts})
    return {h: (m, m - S.deviations * math.sqrt(m * (1 - m) / (hosts[h][0] + s + 1))) for h, m in of_host.items()}


URLS = [
    "http://a.Example.NET/en/1", "http://example.net/en", "http://net/", "http://net", "http://notnet/x", "https://x.org/fr/2?q=/en/", "http://b.example.com/de/#x",
    "http://b.example.com/de", "http://EXAMPLE.com/de/", None, "", "no scheme", "http://", "://h?x://y/z", "http://u@h.co.uk:80/a", "http://1.2.3.4/p", "http://ÉÀ.fr/É\n?x",
    "http://b.example.com/?/de/", "http://good.example.com/a", "http://bad.example.com/a",
]


@pytest.mark.parametrize("with_labels", [True, False])
def test_equals_brute_force(spark, with_labels):
    good = [("good.example.com", 1)] * 40 + [("bad.example.com", 0)] * 38 + [("bad.example.com", 1)] * 2 + [("b.example.com", k % 2) for k in range(9)]
    good += [("x.org", 1), ("1.2.3.4", None), ("elsewhere.info", 0), ("", 1)]
    good = good if with_labels else []
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(URLS + URLS[:2])], "page_id long, url string, verdict string")
    outcomes = spark.createDataFrame(good, "host string, good int")
    hosts = {split(u)[0]: [0, 0] for u in URLS}
    for h, y in good:
        if h in hosts and y is not None:
            hosts[h][0] += 1
            hosts[h][1] += y
    want = reputation({h: tuple(v) for h, v in hosts.items()})
    got = {r.page_id: r for r in op.judge_urls(pages, outcomes).collect()}
    assert len(got) == len(URLS) + 2
    for k, url in enumerate(URLS):
        host, path = split(url)
        rule, (mean, bound) = rule_of(host, path), want[host]
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule.text)
        assert got[k].mean == pytest.approx(mean) and got[k].bound == pytest.approx(bound)
        assert got[k].verdict == (rule.verdict if rule else "allow" if bound >= S.least else "block")
    if with_labels:
        assert got[18].verdict == "allow" and got[19].verdict == "block"
    assert op.judge_urls(pages.limit(0), outcomes).count() == 0


def test_labels_come_by_document_of_the_path(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7"), (2, "http://a.b/en/7.html"), (3, "http://c.d/x"), (4, None), (5, "http://a.b/de/99999999999999999999")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in op.outcomes_by_document(pages, labels).collect()] == [("a.b", 0)] * 2
