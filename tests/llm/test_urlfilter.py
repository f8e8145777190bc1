import random
import re

from quern.llm import urlfilter

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(ASCII), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_equals_brute_force(spark):
    rng = random.Random(1)
    labels, paths = ["a", "b", "com", "Example", "www", "com-x", "net", "é"], ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/"]
    urls = ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#x", "/"]) for _ in range(500)]
    urls += [None, "", "nourl", "://", "http://com", "HTTP://WWW.EXAMPLE.COM/en/?a", "x://com./", "x://a..com/en/", "http://u:p@com:80/en/", "http://com/en/\n/x", *["http://www.example.com/en/hot"] * 300, "http://www.example.com/en/" + "x" * 300_000, "http://" + "a." * 20_000 + "net/es/?" + "y" * 100_000]
    rules = urlfilter.RULES + [("b.com", "", "block"), ("example", "/en", "allow"), ("a", "/", "block"), ("a", "/", "allow"), ("www.b.com", "/e", "block")]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = urlfilter.filter_urls(df, urlfilter.rules_table(spark, rules), ranges=7).collect()
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(got) == len(urls) and all(tuple(r)[1:] == want[r.page_id] for r in got)


def test_empty_tables_and_kept_columns(spark):
    df = spark.createDataFrame([(1, "http://com/x", "v"), (1, "http://com/x", "v"), (None, "http://net/es/", None)], "page_id long, url string, rule string")
    none = urlfilter.rules_table(spark).where("false")
    assert [r.verdict for r in urlfilter.filter_urls(df, none, default="block").collect()] == ["block"] * 3
    got = urlfilter.filter_urls(df.withColumnRenamed("rule", "extra"), urlfilter.rules_table(spark), keep=("extra",)).collect()
    assert sorted((r.rule, r.extra) for r in got if r.extra) == [("com/", "v")] * 2
    assert urlfilter.filter_urls(df.where("false"), urlfilter.rules_table(spark)).count() == 0
    assert urlfilter.filter_urls(df, urlfilter.rules_table(spark, [("", "/e", "block")])).where("verdict = 'block'").count() == 1
