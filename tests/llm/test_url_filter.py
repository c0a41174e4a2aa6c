import random
import re

from diffmill.llm import url_filter as U


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group(0)


def judge(url, rules):
    host, path = host_path(url)
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    key = max((k for k, _ in fits), key=len)
    return host, path, key, "block" if ("block") in {v for k, v in fits if k == key} else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/x", "http://a.example.org/en/12?q=/es/", "http://notexample.org/es/",
    "http://b.com/fr/", "http://b.com/de/#x", "http://b.com", "http://b.com?x=/fr/", "x://É.com/fr/é", "http://org/", "http://a://b.com/fr/",
    "ftp://" + "a." * 3000 + "com/de/", "http://example.org/es", "http://example.org:80/es/", "http://.org/\n/x", "http://c.org/" + "y" * 5000,
]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = U.judge_urls(pages, U.rule_table(spark, rules)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(i, *judge(u, rules)) for i, u in enumerate(urls)]


def test_base_rules(spark):
    check(spark, URLS, U.RULES)


def test_many_rules(spark):
    rng = random.Random(4)
    part = lambda: rng.choice("abc")
    host = lambda: ".".join(part() for _ in range(rng.randrange(1, 4)))
    rules = [(rng.choice(("allow", "block")), host(), "/" + "".join(part() for _ in range(rng.randrange(3)))) for _ in range(60)]
    # two rules of one length fit at once only by their host; keep the paths of each host apart in length
    rules = list({(h, len(p)): (v, h, p) for v, h, p in rules}.values())
    rules = [r for r in rules if not any(len(r[1] + r[2]) == len(o[1] + o[2]) and r is not o and o[1].endswith(r[1]) for o in rules)]
    urls = [f"http://{host()}/{''.join(part() for _ in range(rng.randrange(4)))}" for _ in range(300)]
    check(spark, urls, rules)


def test_cascade_is_exact(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key", "id % 7 = 0 as listed")
    cascade = U.Cascade(keys)
    assert len(cascade.filters) > 2
    assert keys.where(cascade.lists(keys.key) != keys.listed).count() == 0
    for listed in ("true", "false"):
        alike = spark.range(50).selectExpr("concat('k', id) as key", f"{listed} as listed")
        assert alike.where(U.Cascade(alike).lists(alike.key) != alike.listed).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/x", 5), (1, "http://a.com/de/x", 5)], "page_id long, url string, host int")
    pages = pages.withColumns({c: pages.host for c in ("path", "key", "rule", "verdict", "_key0")})
    assert [r.verdict for r in U.judge_urls(pages, U.rule_table(spark)).collect()] == ["block", "block"]
    assert U.judge_urls(pages.limit(0), U.rule_table(spark)).collect() == []
    assert {r.verdict for r in U.judge_urls(pages, U.rule_table(spark, [])).collect()} == {"allow"}
    both = [("allow", "com", "/de/"), ("block", "com", "/de/"), ("block", "com", "/de/")]
    assert {r.verdict for r in U.judge_urls(pages, U.rule_table(spark, both)).collect()} == {"block"}
