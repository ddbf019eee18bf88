"""Exact nearest neighbours by cosine similarity over a tree of cells, and imputation from them.

Known rows are unit vectors; rows without an angle (all features at their mean) are the zero vector, whose
similarity to everything is 0. A cell of level L is a cube of side 2 / 2**L. Cells with more than
``cell_rows`` distinct vectors are cut into their halves along every axis, level by level, so a crowded spot
becomes a deep branch, not a large leaf. Each cell keeps the range of its rows' coordinates.

The distance of a query to the nearest and to the farthest place of a cell's box bounds the product with any
of its rows (q.u = (|q|^2 + |u|^2 - |q - u|^2) / 2), to the second order of the box's side, where the sum of
the axes' products is only good to the first. A query first meets the leaf that it lies in: the k-th best of
its rows, or the box of a cell above it with k rows, proves a k-th best similarity. Then it goes down the tree
level by level and leaves out cells whose greatest possible product is below what is proved; more is proved on
the way. Only the rows of the leaves that remain are compared, a leaf's rows as one array, of which the k best
go on. Nothing is approximate: the result is that of comparing all pairs, ties by ascending key. Everything is
joins by cell and windows by query; the driver sees only whether a level still has crowded cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecast.session import cut

#: Distinct vectors of a leaf, and the level at which cells are leaves whatever they hold.
CELL_ROWS, DEEPEST = 64, 15
#: Similarities are compared after rounding to so many places; bounds leave room for that.
PLACES, SLACK = 12, 1e-9


def standardized(df: DataFrame, features: Sequence[str], known: DataFrame) -> DataFrame:
    """``df`` plus ``z`` array<double>: features less their mean over the population deviation in ``known``.

    The statistics are one row; a feature without deviation gives 0. Rows with a null or NaN feature have a
    null ``z``.
    """
    stats = F.broadcast(known.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                                           *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).alias("_stats")))
    z = [F.when(F.col("_stats")[f"s{i}"] > 0, (F.col(c) - F.col("_stats")[f"m{i}"]) / F.col("_stats")[f"s{i}"]).otherwise(
        F.when(F.col(c).isNotNull(), F.lit(0.0))) for i, c in enumerate(features)]
    sound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])
    return df.crossJoin(stats).withColumn("z", F.when(sound, F.array(*z))).drop("_stats")


def unit(z: Column) -> Column:
    """A vector over its length; the zero vector stays."""
    length = F.sqrt(F.aggregate(z, F.lit(0.0), lambda t, x: t + x * x))
    return F.transform(z, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def _cell(u: Column, dims: int, level: int) -> Column:
    """Number of the cell of a level: one place of 15 bits for each axis."""
    most = F.lit((1 << level) - 1)
    at = [F.greatest(F.lit(0), F.least(most, F.floor((u[i] + 1.0) * float(1 << level) / 2.0))).cast("long") for i in range(dims)]
    return reduce(lambda a, b: a + b, [F.shiftleft(a, DEEPEST * i) for i, a in enumerate(at)])


def _dot(a: Column, b: Column, dims: int) -> Column:
    return reduce(lambda t, x: t + x, [a[i] * b[i] for i in range(dims)])


def cell_tree(points: DataFrame, dims: int, cell_rows: int = CELL_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """Cells by level, and ``(level, cell, point, u)`` of the leaves, from ``points(point, u)``.

    A level's table is ``(cell, parent, rows, lows, highs, shortest, longest, leaf)``, the latter the least and
    greatest square of a vector's length; a cell's children are the cells of the next level that name it as parent.
    """
    levels, leaves, left, level = [], None, points, 0
    while True:
        level += 1
        keyed = left.withColumn("cell", _cell(F.col("u"), dims, level))
        cells = cut(keyed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("rows"), F.first(_cell(F.col("u"), dims, level - 1)).alias("parent"),
            F.array(*[F.min(F.col("u")[i]) for i in range(dims)]).alias("lows"),
            F.array(*[F.max(F.col("u")[i]) for i in range(dims)]).alias("highs"),
            F.min(_dot(F.col("u"), F.col("u"), dims)).alias("shortest"), F.max(_dot(F.col("u"), F.col("u"), dims)).alias("longest"))
            .withColumn("leaf", (F.col("rows") <= cell_rows) | F.lit(level >= DEEPEST)))
        levels.append(cells)
        placed = keyed.join(cells.select("cell", "leaf"), "cell")
        own = placed.where("leaf").select(F.lit(level).alias("level"), "cell", "point", "u")
        leaves = own if leaves is None else leaves.unionByName(own)
        if not cells.where("not leaf").limit(1).count():
            return levels, leaves
        left = cut(placed.where("not leaf").select("point", "u"))


BOX = ("lows", "highs", "shortest", "longest")


def _bounds(dims: int) -> tuple[Column, Column]:
    """Least and greatest product of the query ``u`` with any vector of a cell (its ``BOX`` columns)."""
    q, lows, highs = F.col("u"), F.col("lows"), F.col("highs")

    def total(term) -> Column:
        return reduce(lambda t, x: t + x, [term(q[i], lows[i], highs[i]) for i in range(dims)])
    far = total(lambda x, a, b: F.pow(F.greatest(x - a, b - x), F.lit(2.0)))
    near = total(lambda x, a, b: F.pow(F.greatest(a - x, x - b, F.lit(0.0)), F.lit(2.0)))
    own = _dot(q, q, dims)
    return (F.greatest(total(lambda x, a, b: F.least(x * a, x * b)), (own + F.col("shortest") - far) / 2.0),
            F.least(total(lambda x, a, b: F.greatest(x * a, x * b)), (own + F.col("longest") - near) / 2.0))


def leaf_arrays(leaves: DataFrame, cell_rows: int) -> DataFrame:
    """``(level, cell, points)``: the vectors of a leaf as arrays of some four times ``cell_rows`` at most."""
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("level", "cell")) / (4 * cell_rows))
    return leaves.withColumn("part", F.pmod(F.col("point"), parts)).groupBy("level", "cell", "part").agg(
        F.collect_list("u").alias("points")).drop("part")


def _similarities(points: Column, q: Column, dims: int) -> Column:
    return F.transform(points, lambda u: F.round(_dot(q, u, dims), PLACES))


def proved_at_home(queries: DataFrame, levels: Sequence[DataFrame], arrays: DataFrame, k: int, dims: int = 60 // DEEPEST) -> DataFrame:
    """``queries`` plus ``floor``: what the cells that a query lies in prove of its k-th best similarity."""
    every = reduce(DataFrame.unionByName, [c.select(F.lit(i).alias("level"), "cell", "rows", "leaf", *BOX) for i, c in enumerate(levels, 1)])
    homes = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), _cell(F.col("u"), dims, i).alias("cell")) for i in range(1, len(levels) + 1)]))
    home = queries.select("query", "u", homes.alias("at")).select("query", "u", "at.level", "at.cell").join(
        every.where(F.col("rows") >= k), ["level", "cell"])
    home = cut(home.select("query", "u", "level", "cell", "leaf", _bounds(dims)[0].alias("floor")))
    best = F.sort_array(_similarities(F.col("points"), F.col("u"), dims), asc=False)
    inside = home.where("leaf").join(arrays, ["level", "cell"]).where(F.size("points") >= k).select("query", (best[k - 1] - SLACK).alias("floor"))
    proved = home.select("query", "floor").unionByName(inside).groupBy("query").agg(F.max("floor").alias("floor"))
    return queries.join(proved, "query", "left")


def visited_leaves(queries: DataFrame, levels: Sequence[DataFrame], k: int, dims: int = 60 // DEEPEST) -> DataFrame:
    """``(query, u, level, cell, rows, floor)``: the leaves that may hold one of a query's k best, for ``queries(query, u)``.

    ``floor``, a column of ``queries`` where something is proved already, carries down what is proved of the
    k-th best similarity.
    """
    floor = F.col("floor") if "floor" in queries.columns else F.lit(None).cast("double").alias("floor")
    front = queries.select("query", "u", F.lit(0).cast("long").alias("at"), floor)
    found = None
    by_least = Window.partitionBy("query").orderBy(F.desc("least"))
    low, high = _bounds(dims)
    for level, cells in enumerate(levels, 1):
        met = front.join(cells.select(F.col("parent").alias("at"), "cell", "rows", "leaf", *BOX), "at")
        met = met.select("query", "u", "floor", "cell", "rows", "leaf", low.alias("least"), high.alias("most"))
        met = met.where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - SLACK))
        proved = F.max(F.when(F.col("_sum") >= k, F.col("least"))).over(Window.partitionBy("query"))
        met = met.withColumn("_sum", F.sum("rows").over(by_least)).withColumn("floor", F.greatest("floor", proved))
        met = met.where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - SLACK))
        met = cut(met.select("query", "u", "floor", "cell", "rows", "leaf"))
        own = met.where("leaf").select("query", "u", F.lit(level).alias("level"), "cell", "rows", "floor")
        found = own if found is None else found.unionByName(own)
        front = met.where("not leaf").select("query", "u", F.col("cell").alias("at"), "floor")
    return found


def nearest(queries: DataFrame, known: DataFrame, k: int, query_key: str, known_key: str, dims: int,
            cell_rows: int = CELL_ROWS, vector: str = "z") -> DataFrame:
    """``(query_key, known_key, rank, similarity)``: each query's k known rows of greatest cosine similarity.

    Both tables hold a key and ``vector`` array<double> of ``dims`` (at most four) numbers; rows with a null
    vector or key take no part. Similarities are rounded to 12 places; equal ones rank by ascending key.
    Known rows of one vector are one point of the tree, which keeps their k least keys (no more of them can
    be among the k best). Fewer than k known rows: all of them.
    """
    if not 1 <= dims * DEEPEST <= 60:
        raise ValueError(f"cells hold at most {60 // DEEPEST} axes, not {dims}")
    q = queries.where(F.col(query_key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(query_key).alias("query"), unit(F.col(vector)).alias("u"))
    rows = known.where(F.col(known_key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(known_key).alias("key"), unit(F.col(vector)).alias("u"))
    place = Window.partitionBy("u").orderBy("key")
    rows = cut(rows.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r").withColumn("point", F.xxhash64("u")))
    levels, leaves = cell_tree(rows.select("point", "u").distinct(), dims, cell_rows)
    arrays = cut(leaf_arrays(leaves, cell_rows))
    visits = visited_leaves(cut(proved_at_home(q, levels, arrays, k, dims)), levels, k, dims)
    # of an array go on: what reaches the floor, and the k best of it with their equals
    met = visits.join(arrays, ["level", "cell"]).withColumn("s", _similarities(F.col("points"), F.col("u"), dims))
    met = met.withColumn("least", F.greatest(F.col("floor") - SLACK, F.try_element_at(F.sort_array("s", asc=False), F.lit(k))))
    some = F.filter(F.arrays_zip("points", "s"), lambda p: F.col("least").isNull() | (p["s"] >= F.col("least")))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    points = met.select("query", F.explode(some).alias("p")).select("query", F.col("p.points").alias("u"), F.col("p.s").alias("similarity"))
    near = points.withColumn("_r", F.rank().over(Window.partitionBy("query").orderBy(F.desc("similarity")))).where(F.col("_r") <= k)
    return (near.join(rows.select("u", "key"), "u").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("query").alias(query_key), F.col("key").alias(known_key), F.col("rank").cast("int").alias("rank"), "similarity"))


def recency_weight(similarity: Column, years: Column, share: float = 0.5, decay: float = 0.1) -> Column:
    """similarity x (share x exp(-decay x years) + 1 - share); unknown years count as recent."""
    return similarity * (F.lit(share) * F.exp(-F.lit(decay) * F.coalesce(years, F.lit(0.0))) + F.lit(1.0 - share))


def knn_impute(unknown: DataFrame, known: DataFrame, features: Sequence[str], target: str, key: str = "title",
               years: str | None = None, k: int = 5, share: float = 0.5, decay: float = 0.1, least_known: int = 3,
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """X01 — ``(key, kNN_neighbors, kNN_nearest, kNN_similarity, kNN_prediction)`` for each row of ``unknown``.

    Features are standardised by the known rows (those with a target); the prediction is the mean of the k
    nearest targets weighted by ``recency_weight``. Without ``least_known`` known rows, without a whole set
    of features or with weights that add up to 0, the prediction is NULL.
    """
    sound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])
    train = known.where(F.col(target).isNotNull() & sound)
    near = nearest(standardized(unknown, features, train).select(F.col(key).alias("_query"), "z"),
                   standardized(train, features, train).select(F.col(key).alias("_known"), "z"),
                   k, "_query", "_known", len(features), cell_rows)
    facts = train.select(F.col(key).alias("_known"), F.col(target).cast("double").alias("_y"),
                         (F.col(years).cast("double") if years else F.lit(0.0)).alias("_years"))
    w = recency_weight(F.col("similarity"), F.col("_years"), share, decay)
    enough = F.broadcast(train.agg((F.count(F.lit(1)) >= least_known).alias("_enough")))
    voted = near.join(facts, "_known").withColumn("_w", w).groupBy("_query").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("_known", "rank").alias("_first"), F.max("similarity").alias("_sim"),
        (F.sum(F.col("_w") * F.col("_y")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_pred"))
    out = unknown.select(F.col(key)).join(voted, F.col(key) == F.col("_query"), "left").crossJoin(enough)
    return out.select(key, F.coalesce(F.when(F.col("_enough"), F.col("_n")), F.lit(0)).cast("bigint").alias("kNN_neighbors"),
                      F.when(F.col("_enough"), F.col("_first")).alias("kNN_nearest"),
                      F.when(F.col("_enough"), F.col("_sim")).alias("kNN_similarity"),
                      F.when(F.col("_enough"), F.col("_pred")).alias("kNN_prediction"))
