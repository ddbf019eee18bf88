"""Exact top-k inner products with block-at-a-time pruning.

Vectors are lists of (component, integer weight). Rows are dealt into ranges of ids, each cut into
blocks of ``block_rows`` vectors that keep, for every component, the largest and least weight of the
block, and a forward index: the block's weights as one matrix. A query's bound for a block is the sum
over its components of the larger of query weight times either extreme. Each query visits the blocks of
a range in falling order of its own bounds and ends when the next bound is below its k-th best score so
far (ties are visited, as a smaller id may still win); queries that visit the same block at the same
step are scored together. Within a range, blocks are cut from rows ordered by the number and weight of
their greatest component, which draws the extremes of a block together. The k best of each range are
merged in a last step.

The starting k-th score comes from a first pass in which each chunk of queries is scored against its
own range only, so that other ranges are pruned from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagecast.llm.common import stash, table

BLOCK_ROWS, RANGE_ROWS, QUERY_ROWS = 128, 8192, 512
EXACT = float(1 << 53)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, v array<bigint>)`` with ``floor(scale * x)`` of each component x as a double.

    Rows with a null id, a null vector or a null, NaN or infinite component take no part. Rows that
    repeat an id all take part, whether their vectors are equal or not.
    """
    x = F.col("v").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(sound, F.lit(False)))
            .select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows as one matrix of ``width`` columns; shorter vectors have zeros behind their end."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


#: Below every score, with a negative that exists; above every id.
LOW, NO_ID = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def search_range(queries: pd.DataFrame, rows: pd.DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> pd.DataFrame:
    """The k best rows of one range for each query (``vec_id``, ``v``, ``floor``): query_id, vec_id, score.

    ``floor`` is a score that the query's final k-th best is known to reach, or null.
    """
    width = max([len(v) for v in queries["v"]] + [len(v) for v in rows["v"]])
    q, d = _matrix(queries["v"], width), _matrix(rows["v"], width)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(width, 1) < EXACT
    kind = np.float64 if exact else np.int64       # products of floats are exact below 2**53
    q, d = q.astype(kind), d.astype(kind)
    q_ids, d_ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
    peak = d.argmax(axis=1) if width else np.zeros(len(d), dtype=np.int64)
    order = np.lexsort((d_ids, d[np.arange(len(d)), peak] if width else peak, peak))
    d, d_ids = d[order], d_ids[order]
    starts = np.arange(0, len(d), block_rows)
    high = np.maximum.reduceat(d, starts, axis=0)
    low = np.minimum.reduceat(d, starts, axis=0)
    bound = (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)
    floor = queries["floor"].fillna(LOW).to_numpy().astype(np.int64) if "floor" in queries else np.full(len(q), LOW)
    best = np.full((len(q), k), LOW)
    best_ids = np.full((len(q), k), NO_ID)
    own_order = np.argsort(-bound, axis=1, kind="stable")
    left = np.arange(len(q))
    for step in range(len(starts)):
        blocks = own_order[left, step]
        left = left[bound[left, blocks] >= np.maximum(best[left, -1], floor[left])]
        if not len(left):
            break
        blocks = own_order[left, step]
        for b in np.unique(blocks):
            open_q = left[blocks == b]
            ids = d_ids[starts[b]:starts[b] + block_rows]
            scores = (q[open_q] @ d[starts[b]:starts[b] + block_rows].T).astype(np.int64)
            own = q_ids[open_q][:, None] == ids[None, :]
            scores = np.concatenate([best[open_q], np.where(own, LOW, scores)], axis=1)
            ids = np.concatenate([best_ids[open_q], np.where(own, NO_ID, ids[None, :])], axis=1)
            place = np.lexsort((ids, -scores), axis=1)[:, :k]
            best[open_q] = np.take_along_axis(scores, place, axis=1)
            best_ids[open_q] = np.take_along_axis(ids, place, axis=1)
    found = best_ids != NO_ID
    return pd.DataFrame({"query_id": np.repeat(q_ids, k)[found.ravel()], "vec_id": best_ids[found],
                         "score": best[found]})


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs(cell, part, is_query, vec_id, v, floor)``: one group for each chunk of queries and range."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        asked = group[group["is_query"]].sort_values("vec_id")
        rows = group[~group["is_query"]]
        if asked.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_range(asked, rows, k)
    return pairs.groupBy("cell", "part").applyInPandas(one, "query_id long, vec_id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, range_rows: int = RANGE_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best rows of ``vectors`` but its own.

    Both tables are ``(vec_id long, v array<bigint>)``, as ``whole_vectors`` gives them. Rows of one id are
    rows of their own, equal ones too, which do not meet each other; a query id with several
    has the k best pairs of all of them. All rows if there are fewer than k; no row for a query alone. The stated query set meets
    all rows in blocks: each range is sent once for each chunk of queries, each query once for each
    range; a task holds one range and one chunk, both of bounded size.
    """
    spark = vectors.sparkSession
    n, asked = (max(1, x) for x in (vectors.count(), queries.count()))
    parts, cells = -(-n // range_rows), -(-asked // query_rows)
    rows = stash(vectors.repartitionByRange(parts, "vec_id").withColumn("part", F.spark_partition_id()), "ranges")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    chunk = queries.withColumn("cell", F.pmod(F.xxhash64(F.lit(7), "vec_id", "v"), F.lit(cells)).cast("int"))
    none = F.lit(None).cast("long").alias("floor")
    first = _merged(_search(
        chunk.select("cell", F.pmod("cell", F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("is_query"),
                     "vec_id", "v", none)
        .unionByName(rows.join(spark.range(cells).select(F.col("id").cast("int").alias("cell")),
                               F.pmod("cell", F.lit(parts)) == F.col("part"))
                     .select("cell", "part", F.lit(False).alias("is_query"), "vec_id", "v", none)), k), k)
    first = stash(first, "first-range")
    floor = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    own = F.pmod(F.col("cell"), F.lit(parts)).cast("int")
    other_parts = F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p != own)
    other_cells = F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: F.pmod(c, F.lit(parts)) != F.col("part"))
    rest = _search(
        chunk.join(floor, "vec_id", "left").select("cell", F.explode(other_parts).alias("part"),
                                                   F.lit(True).alias("is_query"), "vec_id", "v", "floor")
        .unionByName(rows.select(F.explode(other_cells).alias("cell"), "part", F.lit(False).alias("is_query"),
                                 "vec_id", "v", none)), k)
    return _merged(first.select("query_id", "vec_id", "score").unionByName(rest), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50; candidates: every other row."""
    vectors = stash(whole_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP5_SQL = """
WITH e AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding])),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([a[1] * a[2] for a in list_zip(q.v, d.v)]) AS BIGINT) AS score
      FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
