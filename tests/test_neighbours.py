import math
import random

from pyspark.sql import functions as F

from stagecast.operators import neighbours as NB


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else list(v)


def brute(queries, known, k):
    out = []
    for q, v in queries:
        scored = sorted((-round(sum(a * b for a, b in zip(unit(v), unit(w))), 12), i) for i, w in known)
        out += [(q, i, r + 1) for r, (_, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, queries, known, k=5, **more):
    queries, known = ([(i, v and [float(x) for x in v]) for i, v in t] for t in (queries, known))
    q = spark.createDataFrame(queries, "q long, z array<double>")
    d = spark.createDataFrame(known, "d long, z array<double>")
    got = NB.nearest(q, d, k, "q", "d", 4, **more).collect()
    return sorted((r["q"], r["d"], r["rank"]) for r in got)


def points(rng, n, spread):
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(centres)] for _ in range(n)]


def test_search_equals_all_pairs(spark):
    rng = random.Random(4)
    known = list(enumerate(points(rng, 700, 0.4)))
    queries = list(enumerate(points(rng, 60, 1.0)))
    assert run(spark, queries, known, cell_rows=16) == brute(queries, known, 5)


def test_crowded_cell_ties_and_zero_vectors(spark):
    """Half of the rows lie in one narrow spot, many are equal; ties go to the least key."""
    rng = random.Random(5)
    spot = [[1 + rng.gauss(0, 1e-3), 1.0, 1.0, 1.0] for _ in range(300)]
    known = list(enumerate(spot + [[2.0, 0.0, 0.0, 0.0]] * 40 + [[0.0] * 4] * 3 + points(rng, 200, 1.0)))
    queries = [(0, [1.0, 1.0, 1.0, 1.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0] * 4), (3, [-1.0, -1.0, -1.0, -1.0]), (4, [1.0005, 1, 1, 1.0])]
    got, want = run(spark, queries, known, cell_rows=8), brute(queries, known, 5)
    assert got == want
    assert [d for q, d, _ in got if q == 1] == [300, 301, 302, 303, 304] and [d for q, d, _ in got if q == 2] == [0, 1, 2, 3, 4]


def test_few_leaves_are_visited(spark):
    rng = random.Random(6)
    known = spark.createDataFrame([(i, unit(v)) for i, v in enumerate(points(rng, 3000, 0.3))], "point long, u array<double>")
    queries = spark.createDataFrame([(i, unit(v)) for i, v in enumerate(points(rng, 40, 0.3))], "query long, u array<double>")
    levels, leaves = NB.cell_tree(known, 4, 32)
    assert leaves.count() == 3000 and leaves.groupBy("level", "cell").count().agg(F.max("count")).first()[0] <= 32
    compared = NB.visited_leaves(queries, levels, 5).agg(F.sum("rows")).first()[0]
    assert 40 * 5 <= compared < 0.35 * 40 * 3000


def test_fewer_known_than_k_and_empty(spark):
    known, queries = [(1, [1.0, 0, 0, 0]), (2, [0.0, 1, 0, 0]), (None, [1.0, 1, 1, 1]), (4, None)], [(7, [1.0, 0.1, 0, 0]), (8, None)]
    assert run(spark, queries, known) == [(7, 1, 1), (7, 2, 2)]
    assert run(spark, queries, known[3:]) == [] and run(spark, [], known) == []


def test_imputation_by_hand(spark):
    known = spark.createDataFrame([(1, 1.0, 5.0, 10.0, 0.0), (2, 2.0, 5.0, 20.0, 10.0), (3, 4.0, 5.0, 40.0, None), (9, None, 5.0, 99.0, 1.0)],
                                  "title long, a double, b double, y double, age double")
    unknown = spark.createDataFrame([(5, 4.0, 5.0), (6, 1.0, 5.0), (7, None, 5.0)], "title long, a double, b double")
    got = {r["title"]: r for r in NB.knn_impute(unknown, known, ["a", "b"], "y", years="age", k=1).collect()}
    assert got[5]["kNN_nearest"] == 3 and abs(got[5]["kNN_prediction"] - 40) < 1e-9 and got[5]["kNN_neighbors"] == 1
    assert got[6]["kNN_nearest"] == 1 and abs(got[6]["kNN_prediction"] - 10) < 1e-9      # 1 and 2 point the same way: least key
    assert got[7]["kNN_prediction"] is None and got[7]["kNN_neighbors"] == 0
    two = {r["title"]: r for r in NB.knn_impute(unknown, known, ["a", "b"], "y", years="age", k=2).collect()}
    w = 0.5 * math.exp(-1.0) + 0.5
    assert abs(two[6]["kNN_prediction"] - (10 + 20 * w) / (1 + w)) < 1e-9
    few = NB.knn_impute(unknown, known.where("title < 3"), ["a", "b"], "y").collect()
    assert all(r["kNN_prediction"] is None for r in few)


def test_what_is_compared_does_not_grow_with_the_table(spark):
    """Vectors in all directions: a query compares a few leaves, however many rows there are."""
    rng = random.Random(7)
    many = [(i, unit([rng.gauss(0, 1) for _ in range(4)])) for i in range(24000)]
    queries = spark.createDataFrame([(i, unit([rng.gauss(0, 1) for _ in range(4)])) for i in range(100)], "query long, u array<double>")
    known = spark.createDataFrame(many, "point long, u array<double>")
    levels, leaves = NB.cell_tree(known, 4, 64)
    proved = NB.proved_at_home(queries, levels, NB.leaf_arrays(leaves, 64), 5)
    plain, told = (NB.visited_leaves(q, levels, 5).agg(F.sum("rows")).first()[0] for q in (queries, proved))
    assert told <= plain < 0.15 * 100 * 24000 and told < 0.02 * 100 * 24000
