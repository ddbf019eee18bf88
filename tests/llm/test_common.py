import random

from pyspark.sql import functions as F

from stagecast.llm.common import maybe_in, min_components, words


def test_components_of_random_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 60)] + [(500 - i, 501 - i) for i in range(50)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, None), (None, 8), (999, 999)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    got = min_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {n: root(n) for n in nodes} and len(got) == len(nodes)


def test_no_edges(spark):
    assert min_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_filter_never_misses(spark):
    df = spark.range(2000)
    keys = df.where("id % 7 = 0").select(F.col("id").alias("key"))
    got = maybe_in(df, F.col("id"), keys)
    assert got.where("id % 7 = 0 and not maybe").count() == 0
    assert got.where("id % 7 <> 0 and maybe").count() < 20


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\x0b\x0cc ",), ("é x",), ("",), (None,), ("\n",)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["a", "b", "c"], ["é", "x"], [], [], []]


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A chain in ascending order, as drifting copies in crawl order make it."""
    from stagecast.llm import common
    tags, whole = [], common.stash
    monkeypatch.setattr(common, "stash", lambda df, tag: tags.append(tag) or whole(df, tag))
    n = 10_000
    got = common.min_components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.count() == n + 1 and got.where("component <> 0").count() == 0
    assert tags.count("pointers") < 2 * n.bit_length() + 4 < 33
