import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tagmill.llm import urlfilter as m


def test_query_matches_sql(spark, sf_dir, same_as_sql):
    same_as_sql(m.op8_url_filter(spark, sf_dir), m.OP8_SQL, sf_dir)


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, urls, rules=m.RULES):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in m.judge(df, rules).orderBy("page_id").collect()]


URLS = ["http://EXAMPLE.com/en/7x", "http://example.com/en/8", "x://a.com/en", "x://a.com/en/", "x://xexample.com/en/7", "x://net/de/", "x://example.net/de/81?a=/b", "x://ORG/es/#", "a.com/en/", None, "", "://", "x://a.com?/en/", "x://.com/en/", "x://com./en/", "x://É.com/en/a", "x://a.b.example.net/de/8#q", "x://u://com/en/", "x://a.com/en/7\ny", "x://" + "a." * 3000 + "com/en/" + "y" * 100_000]


def test_corner_cases(spark):
    assert judged(spark, URLS) == [brute(u, m.RULES) for u in URLS]


HOST = st.lists(st.sampled_from(["a", "b", "com", "net", ""]), min_size=1, max_size=4).map(".".join)
PATH = st.lists(st.sampled_from(["/", "x", "y", "/x"]), max_size=3).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(HOST, PATH), min_size=1, max_size=60), st.dictionaries(st.tuples(HOST.filter(lambda h: h.strip(".")), PATH), st.sampled_from(["allow", "block"]), max_size=8))
def test_any_rules(spark, urls, rules):
    urls, rules = [f"x://{h}{p}" for h, p in urls], [(v, h, p) for (h, p), v in rules.items()]
    # of two rules for one key string but another split, the one with the longer host is named alike
    got = judged(spark, urls, rules)
    assert [g[:3] for g in got] == [brute(u, rules)[:3] for u in urls]


def test_cascade_is_exact_on_its_universe():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 50_000).astype(np.uint64)
    listed, rest = keys[:300], keys[300:]
    first = m.Bloom(listed, 0.05, 1)
    c = m.cascade(first, listed, rest[first.has(rest)])
    assert c.has(listed).all() and not c.has(rest).any() and len(c.levels) > 2


def test_empty_rules_and_tables(spark):
    assert judged(spark, ["x://a.com/en/"], []) == [("a.com", "/en/", None, "allow")]
    df = spark.createDataFrame([], "page_id long, url string")
    assert m.judge(df).count() == 0


def test_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x://a.com/en/", "h")] * 2 + [(None, None, None)], "page_id long, url string, keys string")
    assert sorted(str(r["verdict"]) for r in m.judge(df).collect()) == ["allow", "block", "block"]
