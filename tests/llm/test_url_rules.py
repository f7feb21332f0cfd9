import re

import rows as R

from routewright.llm import url_rules as U

SCHEMA = "page_id bigint, url string, html string"


def _host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path):
    fits = [
        r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])
    ]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


def _pages():
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://WWW.EXAMPLE.ORG/es/1?x#y", "x://Org/", "x://org",
        "x://notorg/", "x://a.org?q/es/", "x://example.org/en/1", "x://example.org/en/2", "x://\u00c9.com/fr/",
        "x://com/de/#f", "x://a://b.com/de/", "x://h.net/de/7", "x://h.net/fr/7", "x://deep.com/" + "p/" * 500,
    ]
    urls += [f"https://h{i % 7}.example.{t}/{p}/{i}" for i in range(40) for t, p in
             (("com", "de"), ("com", "fr"), ("org", "es"), ("org", "en"), ("net", "es"), ("net", "fr"))]
    return [(i, u, None) for i, u in enumerate(urls)] + [(3, "x://org/", None)] * 2


def test_rules_hosts_and_paths(spark):
    pages = _pages()
    df = R.clashing(spark.createDataFrame(pages, SCHEMA).repartition(4))
    got = U.judge(df).collect()
    want = []
    for page_id, url, _ in pages:
        host, path = _host_path(url)
        rule, verdict = _rule(host, path)
        want.append((page_id, host, path, rule, verdict))
    key = lambda r: (r[0], r[1], r[2])
    got = sorted(got, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert (g.page_id, g.host, g.path, g.rule) == w[:4]
        assert g.verdict == w[4] if w[4] else g.verdict in ("allow", "block")


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    data = [(["a", "b"], "block")] * 6 + [(["a"], "allow")] * 5 + [(["c", "b"], "allow")] * 4
    data += [(["c"], "block")]
    support, confidence = 0.1, 0.7
    got = U.mine(spark.createDataFrame(data, "tokens array<string>, verdict string"), support, confidence)
    n, want = len(data), {}
    for size in (1, 2):
        for need in combinations("abc", size):
            met = [v for t, v in data if set(need) <= set(t)]
            for v in ("allow", "block"):
                hits = met.count(v)
                if met and hits / n >= support and hits / len(met) >= confidence:
                    want[need, v] = hits / len(met)
    kept = {
        k: c for k, c in want.items()
        if not any(v == k[1] and set(s) < set(k[0]) and x >= c for (s, v), x in want.items())
    }
    assert {(tuple(r.tokens), r.verdict): round(r.confidence, 6) for r in got.collect()} == {
        k: round(c, 6) for k, c in kept.items()
    }


def test_mining_looks_at_all_tokens(spark):
    # Ten common tokens say nothing; the rarest ones tell the verdict.
    common = [f"t{i:02}" for i in range(10)]
    data = [([*common, "x"], "block")] * 6 + [([*common, "y"], "allow")] * 5 + [(common, "allow")] * 2
    got = U.mine(spark.createDataFrame(data, "tokens array<string>, verdict string"), 0.1, 0.8)
    assert {(tuple(r.tokens), r.verdict, r.confidence, round(r.support, 6)) for r in got.collect()} == {
        (("x",), "block", 1.0, round(6 / 13, 6)),
        (("y",), "allow", 1.0, round(5 / 13, 6)),
    }


def test_surest_rule_wins(spark):
    sets = spark.createDataFrame([(["a", "b", "z"],), (["z"],), (["b"],)], "tokens array<string>")
    rules = spark.createDataFrame(
        [(["a", "b"], "block", 0.9, 0.5, "b"), (["b"], "allow", 0.8, 0.6, "b")],
        "tokens array<string>, verdict string, confidence double, support double, key string",
    )
    got = {tuple(r.tokens): r.met.verdict for r in U.match(sets, rules).collect()}
    assert got == {("a", "b", "z"): "block", ("b",): "allow"}


def test_without_rows_or_labels(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    got = U.judge(spark.createDataFrame([(1, "x://h.net/a", None)], SCHEMA)).collect()
    assert got[0].verdict == "allow" and got[0].rule is None
