import numpy as np
import pandas as pd

from stagecast.llm.topk_search import op5_topk_search, search_range, top_k, whole_vectors


def brute(vectors, ids, k):
    out = []
    for q in ids:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, [int(x) for x in v]) for i, v in vectors.items()], "vec_id long, v array<bigint>")


def test_matches_brute_force_over_many_ranges_with_ties(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.integers(-3, 4, 6).tolist() for i in range(400)}
    df = frame(spark, vectors)
    got = top_k(df, df.where("vec_id % 20 = 0"), k=5, range_rows=90, query_rows=6)
    assert sorted(map(tuple, got.collect())) == sorted(brute(vectors, range(0, 400, 20), 5))


def test_blocks_are_pruned_yet_exact():
    rng = np.random.default_rng(2)
    v = np.sort(rng.integers(0, 1000, 512))[:, None].repeat(4, axis=1)
    rows = pd.DataFrame({"vec_id": np.arange(512), "v": list(v)})
    got = search_range(pd.DataFrame({"vec_id": [600], "v": [np.ones(4, int)]}), rows, 3, block_rows=16)
    want = sorted(((-int(x.sum()), i) for i, x in enumerate(v)))[:3]
    assert got[["vec_id", "score"]].values.tolist() == [[i, -s] for s, i in want]


def test_large_weights_stay_exact():
    big = 1 << 29
    rows = pd.DataFrame({"vec_id": [1, 2], "v": [[big, 1], [big, 2]]})
    got = search_range(pd.DataFrame({"vec_id": [9], "v": [[big, 1]]}), rows, 2)
    assert got["score"].tolist() == [big * big + 2, big * big + 1]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], "x"), (50, [1.0, 0.0], "x"), (1, [0.0, nan], "x"), (2, [inf, 0.0], "x"), (3, None, "x"),
            (4, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (5, [-0.001, 1.0], "x"), (5, [-0.001, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    whole = whole_vectors(df)
    assert {r["vec_id"]: r["v"] for r in whole.collect()} == {0: [128, 128], 50: [256, 0], 5: [-1, 256]}
    got = top_k(whole, whole.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 50, 32768), (0, 2, 5, 32640), (0, 3, 5, 32640), (50, 1, 0, 32768), (50, 2, 5, -256), (50, 3, 5, -256)]


def test_empty_and_single(spark):
    none = whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert top_k(none, none).count() == 0
    one = whole_vectors(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    assert top_k(one, one).count() == 0


def test_query_schema(spark):
    df = op5_topk_search(spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_rows_of_one_id_all_take_part(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(int(i), tuple(rng.integers(-3, 4, 5).tolist())) for i in rng.integers(0, 60, 150)} | {(0, (9, 9, 9, 9, 9)), (0, (-9, 0, 0, 0, 0))})
    rows += rows[:9]                                       # equal rows are rows of their own
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    whole = whole_vectors(df)
    assert whole.count() == len(rows)
    want = []
    for q in range(0, 60, 10):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for i, v in rows if i == q for j, w in rows if j != q)
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]
    for size in (8192, 40):
        got = top_k(whole, whole.where("vec_id % 10 = 0"), k=5, range_rows=size, query_rows=4)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_oracle_lists_equal_rows_too(spark):
    import duckdb
    from stagecast.llm.topk_search import OP5_SQL
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(0, 130, 2)]
    rows += rows[:7] + [(8, None), (9, [float("nan")] * 4)]
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    whole = whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = top_k(whole, whole.where("vec_id % 50 = 0"), range_rows=20, query_rows=2)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(OP5_SQL).fetchall())
