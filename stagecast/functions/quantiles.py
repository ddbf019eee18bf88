"""Exact percentiles (linear interpolation, numpy / SQL percentile_cont semantics), scale-safe and lazy.

Spark's exact ``percentile`` merges every distinct value of a group in one task. Here values are only ever
counted, and counts narrowed down to those around the wanted ranks; the same steps for any size:

1. one pass over the rows counts them by group and bucket, a bucket being a stretch of the logarithm of the
   value (``PER_E`` to a factor of e; any sign). Partial aggregation leaves a small table, whose running sums
   per group name the buckets that hold the wanted ranks;
2. one more pass counts the values of those buckets alone, as ``(value, count)`` pairs (a value costs one
   pair however often it occurs), and running sums over the pairs of a bucket give the values at the ranks.

Bucket numbers never decrease with the value, so nothing is approximate. No list of values is gathered,
nothing is collected or checkpointed, no job runs ahead: the result is a lazy table that reads its input
twice. The windows hold the buckets of a group (some 14,000 for values up to a million) and the distinct
values of a bucket, which differ by a thousandth of their size at most (all of those within a thousandth of
0 are in one).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets to a factor of e.
PER_E = 1024


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"r{c}"]) for c in cols])


def _back(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Join on columns that may be null; the right side's columns other than ``cols`` are added."""
    r = right.select(*[F.col(c).alias(f"r{c}") for c in cols], *[c for c in right.columns if c not in cols])
    return left.join(r, _same(left, r, cols)).drop(*[f"r{c}" for c in cols])


def bucket_of(v: Column) -> Column:
    """Number of the bucket of a value: never decreases with it."""
    size = F.floor(F.least(F.log1p(F.abs(v)), F.lit(800.0)) * PER_E)
    return (F.signum(v) * size).cast("long")


def _times(weight: str | None) -> Column:
    """How many values the rows of a group stand for."""
    return F.sum(weight) if weight else F.count(F.lit(1))


def rank_buckets(d: DataFrame, keys: Sequence[str], probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Step 1: ``(keys, n, _b, _want)``, the buckets that hold wanted ranks and these, counted from the bucket's start.

    Two ranks belong to a probability, the one below its place and the one above (``side`` 0 and 1).
    """
    sums = d.groupBy(*keys, bucket_of(F.col("_v")).alias("_b")).agg(_times(weight).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b"))
    placed = sums.withColumn("_upto", upto).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
    before = F.col("_upto") - F.col("_c")
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), (pick((F.col("n") - 1) * float(p)).cast("long") - before).alias("r"))
                      for i, p in enumerate(probs) for s, pick in enumerate((F.floor, F.ceil))])
    here = F.filter(ranks, lambda x: (x["r"] >= 0) & (x["r"] < F.col("_c")))
    return placed.select(*keys, "n", "_b", here.alias("_want")).where(F.size("_want") > 0)


def bucket_pairs(d: DataFrame, buckets: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Step 2: ``(keys, n, _b, _want, _v, _c)``, how often each value of these buckets occurs."""
    near = _back(d.withColumn("_b", bucket_of(F.col("_v"))), buckets, [*keys, "_b"])
    return near.groupBy(*keys, "n", "_b", "_want", "_v").agg(_times(weight).alias("_c"))


def exact_percentiles(df: DataFrame, value: str | Column, probs: Sequence[float], group: Sequence[str] | str | None = None,
                      prefix: str = "p", weight: str | None = None) -> DataFrame:
    """Per group (or globally): columns ``{prefix}{i}`` with the exact percentile probs[i], plus ``n``.

    NULL and NaN values are ignored; a group without values gives no row (global: one row of NULLs).
    A NULL group is a group. With ``weight`` a row stands for so many equal values (a whole number, 1 or more):
    a table that already counts its values need not be read row by row.
    """
    groups = [group] if isinstance(group, str) else list(group or [])
    keys = [f"_k{j}" for j in range(max(1, len(groups)))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    named = [F.col(g).alias(k) for g, k in zip(groups, keys)] or [F.lit(0).alias("_k0")]
    held = [F.col(weight).cast("long").alias("_w")] if weight else []
    d = df.select(*named, v.alias("_v"), *held).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    w = "_w" if weight else None
    pairs = bucket_pairs(d, rank_buckets(d, keys, probs, w), keys, w)
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    here = F.filter("_want", lambda x: (x["r"] < F.col("_upto")) & (x["r"] >= F.col("_upto") - F.col("_c")))
    found = pairs.withColumn("_upto", upto).select(*keys, "n", "_v", F.explode(here).alias("e")).select(
        *keys, "n", "_v", F.col("e.i").alias("_i"), F.col("e.side").alias("_side"))

    def at(i: int) -> Column:
        x, y = (F.max(F.when((F.col("_i") == i) & (F.col("_side") == s), F.col("_v"))) for s in (0, 1))
        h = (F.max("n") - 1) * float(probs[i])
        return F.when(x == y, x).otherwise(x + (h - F.floor(h)) * (y - x))
    names = [f"{prefix}{i}" for i in range(len(probs))]
    one = found.groupBy(*keys).agg(F.max("n").alias("n"), *[at(i).alias(c) for i, c in enumerate(names)])
    if groups:
        return one.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], "n", *names)
    # one row also where there are no values
    return one.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(c).alias(c) for c in names])


def exact_median(df: DataFrame, value: str | Column, group: Sequence[str] | str | None = None, alias: str = "median",
                 weight: str | None = None) -> DataFrame:
    """Exact median per group (or globally) via ``exact_percentiles``."""
    return exact_percentiles(df, value, [0.5], group, weight=weight).withColumnRenamed("p0", alias)
