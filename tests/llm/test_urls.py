import random
import re

from factloom.llm import urls
from factloom.llm.queries import QUERIES, URL_RULES

RULES = "host string, path string, verdict string"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return host.translate(LETTERS), re.split("[?#]", rest[len(host) :])[0]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[0], f[1], f[3] == "block"), default=(0, 0, None, default))
    return host, path, best[2], best[3]


def check(spark, rows, rules, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(pages, spark.createDataFrame(rules, RULES), **options).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *brute(u, rules))) for i, u in rows)


ODD = [
    (1, "http://example.com/en/1"), (2, "HTTPS://WWW.Example.COM/en/1?x=/fr/"), (3, "https://www.example.com/EN/1"), (4, None), (5, ""),
    (6, "no scheme"), (7, "https://"), (8, "https:///en/"), (9, "https://a.net/fr/#x"), (10, "https://net/es/"), (11, "https://badexample.com/en/"),
    (12, "https://example.com?/en/"), (13, "https://example.com"), (14, "https://example.com./en/"), (15, "https://user@example.com:80/en/"),
    (16, "x://y://example.com/en/"), (17, "https://.com/"), (18, "https://a..com/en/"), (19, "https://ÀÉ.com/é"), (None, "https://m.example.com/en/x"),
    (20, "https://m.example.com/en/x"), (20, "https://m.example.com/en/x"), (21, "https://example.com/" + "long/" * 40_000), (22, "https://www.example.com/en/\nx?y"),
]


def test_odd_rows(spark):
    check(spark, ODD, URL_RULES)
    check(spark, ODD, URL_RULES, ranges=1)
    check(spark, ODD, URL_RULES, ranges=40, sample=2)


def test_nested_rules_ties_and_repeats(spark):
    """Many nested hosts and paths over few labels, more ranges than rows of some; ties go to the longer host, clashes to block."""
    random.seed(3)
    labels, steps = ["a", "b", "aa", "com", "é"], ["/", "/a", "/a/", "/ab", "/a/b/", ""]
    host = lambda: ".".join(random.choices(labels, k=random.randint(1, 4)))
    rules = [(host(), random.choice(steps), random.choice(["allow", "block"])) for _ in range(150)] + [("com", "/a/", "allow"), ("com", "/a/", "block")]
    rows = [(k, f"http://{host()}{random.choice(steps)}{random.choice(steps)}?q") for k in range(1500)]
    rows += [(2000 + k, "http://a.b.com/a/b/") for k in range(800)]  # one url holds a third of the rows
    check(spark, rows, rules)
    check(spark, rows, rules, ranges=23, sample=8)


def test_no_rules_null_rules_default_and_empty(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string")
    none = spark.createDataFrame([(None, "/", "block"), ("com", "/", None)], RULES)
    got = urls.judge_urls(pages, none, default="block").collect()
    assert len(got) == len(ODD) and all(r.rule is None and r.verdict == "block" for r in got)
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame(URL_RULES, RULES)).count() == 0


def test_kept_columns(spark):
    """Kept columns come back as they were, large ids and nulls among them; those that clash give way."""
    rows = [(2**60 + 1, "http://a.com/", "old", "x.y", [1]), (None, "http://a.net/fr/", "old", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, `a.b` string, list array<int>")
    got = urls.judge_urls(pages, spark.createDataFrame(URL_RULES, RULES), keep=("page_id", "verdict", "a.b", "list")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(2**60 + 1, "x.y", [1], "a.com", "/", "com/", "allow"), (None, None, None, "a.net", "/fr/", "net/fr/", "block")], key=repr)


def test_query(spark, sf):
    got = QUERIES["op13_url_filters"](spark, sf)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(r.page_id, *brute(r.url, URL_RULES)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
