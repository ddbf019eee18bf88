from pyspark.sql import functions as F

from stagecast.llm.url_filter import canonical, judge_urls, listed_hits


def judged(spark, urls, listed=(), **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    names = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r["page_id"]: r for r in judge_urls(pages, names, **more).collect()}


def test_hosts_paths_and_rules(spark):
    got = judged(spark, ["http://A.Example.COM/en/1?x=/y#z", "https://www.example.com/en/2", "http://example.com/fr/",
                         "https://x.net/es/1", "http://x.org/es/1", "http://com", "http://notexample.com/en/",
                         "a://b.com/://c", "no scheme", "", None, "http://x.net?/es/", "http://É.com/p"])
    want = [("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
            ("example.com", "/fr/", "com/", "allow"), ("x.net", "/es/1", "net/es/", "block"), ("x.org", "/es/1", None, "allow"),
            ("com", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"), ("b.com", "/://c", "com/", "allow"),
            ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.net", "", None, "allow"),
            ("É.com", "/p", "com/", "allow")]
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(want))] == want


def test_listed_urls_are_blocked_unless_a_rule_decides(spark):
    got = judged(spark, ["http://www.x.org/a.html?utm_source=f&b=2&a=1#t", "https://m.x.org:443/a?a=1&b=2", "http://x.org/b",
                         "http://y.com/a"], ["x.org/a?a=1&b=2", "y.com/a", None, "x.org/a?a=1&b=2"])
    assert [got[i]["verdict"] for i in range(4)] == ["block", "block", "allow", "allow"]
    assert got[3]["listed"] and got[3]["rule"] == "com/"


def test_false_positives_of_a_crowded_filter_are_removed(spark):
    listed = spark.range(3000).select(F.concat(F.lit("l.org/"), "id").alias("url"))
    urls = listed.limit(40).select(F.col("url").alias("canonical")).union(
        spark.range(500).select(F.concat(F.lit("u.org/"), "id")))
    got = listed_hits(urls, listed, n_blocks=4).groupBy("listed").count().collect()
    assert {r["listed"]: r["count"] for r in got} == {True: 40, False: 500}


def test_empty_tables_and_repeats(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://x.org/a"), (1, "http://x.org/a"), (None, "http://x.org/a")], "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame([("x.org/a",)], "url string"))
    assert [r["verdict"] for r in got.collect()] == ["block"] * 3


def test_canonical_of_urls_without_scheme_is_null(spark):
    df = spark.createDataFrame([("x.org/a",), (None,), ("h://x.org//",)], "url string")
    assert [r[0] for r in df.select(canonical(F.col("url"))).collect()] == [None, None, "x.org"]


def test_very_long_urls_are_judged_whole(spark):
    long = "x" * 300_000
    got = judged(spark, [f"http://h.org/{long}?a=1", f"http://h.org/{long}y", f"http://{long}.com/en/"], [f"h.org/{long}?a=1"])
    assert [got[i]["verdict"] for i in range(3)] == ["block", "allow", "allow"]
    assert got[1]["path"] == f"/{long}y" and got[2]["host"] == f"{long}.com" and got[2]["rule"] == "com/"
