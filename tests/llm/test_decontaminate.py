import random

from stagecast.llm.decontaminate import (candidates, contained_items, decontaminated, item_sketches, least_hits)
from stagecast.llm.common import row_keys

VOCAB = [f"w{i}" for i in range(3000)]


def shingles(text, width=5):
    w = tuple((text or "").encode().lower().split())
    if not w:
        return set()
    return {w[i:i + width] for i in range(max(1, len(w) - width + 1))}


def brute(docs, items):
    out = set()
    for d, text in docs:
        has = shingles(text)
        for i, asked in items:
            want = shingles(asked)
            if want and 100 * len(want & has) >= 80 * len(want):
                out.add((d, i, len(want), len(want & has)))
    return out


def planted(seed=0):
    rng = random.Random(seed)

    def prose(n):
        return rng.choices(VOCAB, k=n)
    items = [(i, " ".join(prose(n))) for i, n in enumerate([1, 3, 4, 5, 6, 9, 20, 36, 37, 60, 120, 400, 900])]
    docs = []
    for d in range(150):
        text = prose(rng.choice([3, 20, 200, 5000]))
        for _ in range(rng.randint(0, 2)):
            i, t = rng.choice(items)
            w = t.split()
            cut = rng.choice([0, 0, len(w) // 10, len(w) // 4, len(w) // 2])
            if cut and rng.random() < 0.5:
                w[len(w) // 2] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() if rng.random() < 0.1 else x for x in w[:len(w) - cut]]
        docs.append((d, " \n".join(text) if d % 2 else "\t".join(text)))
    docs += [(1000 + i, t) for i, t in items]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_matches_brute_force(spark):
    docs, items = planted()
    got = contained_items(*frames(spark, docs, items))
    want = brute(docs, items)
    assert {(r["id"], r["item"], r["n_item"], r["n_shared"]) for r in got.collect()} == want
    assert len(want) > 60


def test_blocks_of_the_benchmark_find_the_same(spark):
    docs, items = planted(1)
    d, b = frames(spark, docs, items)
    k1, k2 = row_keys("doc_id", "text")
    rows, named = d.select(k1.alias("k1"), k2.alias("k2"), "text"), b.withColumnRenamed("item_id", "item")
    whole = {tuple(r) for r in candidates(rows, named).collect()}
    assert whole == {tuple(r) for r in candidates(rows, named, block_probes=40).collect()}


def test_sketch_sizes_follow_the_partition(spark):
    docs, items = planted()
    rows = item_sketches(spark.createDataFrame(items, "item long, text string")).groupBy("item", "size", "part", "need").count().collect()
    for r in rows:
        assert r["count"] == min(r["size"], 32) and 2 ** r["part"] <= r["size"] < 2 ** (r["part"] + 1)
        assert r["need"] == (-(-r["size"] * 8 // 10) if r["size"] <= 32 else least_hits(32))
    assert 5 <= least_hits(32) <= 14


def test_filtering_keeps_clean_rows_and_all_columns(spark):
    docs, items = planted(2)
    bad = {d for d, *_ in brute(docs, items)}
    d = spark.createDataFrame([(i, t, "x", 1, 2, "m") for i, t in docs] + [(None, None, "x", 1, 2, "m"), (None, "", "x", 1, 2, "m"),
                              (7777, docs[0][1] if 0 not in bad else "clean", "x", 1, 2, "m")] * 2,
                              "doc_id long, text string, item_id string, k1 int, block int, maybe string")
    b = spark.createDataFrame(items + [(50, None), (51, " "), (None, "")], "item_id long, text string")
    got = decontaminated(d, b)
    assert got.columns == d.columns
    assert sorted((r["doc_id"] for r in got.collect() if r["doc_id"] is not None)) == sorted(
        [i for i, _ in docs if i not in bad] + [7777, 7777])
    assert got.where("doc_id is null").count() == 4


def test_empty_tables(spark):
    d, b = frames(spark, [], [])
    full, items = frames(spark, [(1, "a b c d e f")], [(1, "a b c d e f")])
    assert contained_items(d, items).count() == contained_items(full, b).count() == 0
    assert decontaminated(full, b).count() == 1 and decontaminated(d, items).count() == 0
