"""Mixing sources to target word counts by entropy balancing.

Among all document rates between 0 and ``most`` (2), the balanced ones meet each source's word target
with the least change, in bounded entropy, from one copy each. Their dual is convex with one
multiplier a source, and the rates are exponential tilts: ``most / (1 + exp(-l * z))`` with z the
document's size over its source's mean. Newton steps for all sources at once find the multipliers;
each step is one aggregation over the table of (source, size, documents of that size), kept inside a
bracket by bisection, until the constraint holds to a millionth. Rates are then rounded into copies:
running sums of expected copies over a source's sizes are rounded, which leaves each source within one
document's size of its target. Everything is DataFrame code; the driver sees one convergence flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagecast.llm.common import packed, row_key, stash, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
WORD = "[^\\x20\\x09-\\x0D]+"
#: Relative error at which a constraint holds; steps between two looks at the flag; steps in all
#: (bisection alone needs fewer to reach the error).
ENOUGH, STEPS, MAX_STEPS = 1e-6, 4, 120
#: Documents of one (source, size) that one task orders.
BUCKET_ROWS = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A key in code-point order with null behind all others."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, n, target)`` of ``sizes(source key, size, n)``, one row a source.

    Sources in key order weigh ``weights``, repeating, and share ``share`` times all words; a target
    stops at ``most`` times its source's words and the excess goes to the others by weight until none
    is above. This water level is the largest of the levels that follow if the k sources with the
    least words for their weight are full. Windows run over one row a source, not over documents.
    """
    src = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    place = (F.row_number().over(Window.orderBy("source")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    src = src.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "source")
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    src = src.withColumn("level", (F.sum("source_size").over(everything) * share - full) / open_w)
    src = src.withColumn("level", F.max("level").over(everything))
    return src.select("source", "source_size", "n", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _rate(l: Column, size: Column, mean: Column, most: int) -> Column:
    return F.lit(float(most)) / (F.lit(1.0) + F.exp(F.least(F.lit(700.0), -l * size / mean)))


def _step(state: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """One safeguarded Newton step of every source's multiplier."""
    joined = sizes.join(state, "source")
    r = _rate(F.col("l"), F.col("size"), F.col("mean"), most)
    words = F.col("size") * F.col("n")
    got = joined.groupBy("source").agg(
        F.sum(words * r).alias("words"),
        F.sum(words * F.col("size") / F.col("mean") * r * (1 - r / most)).alias("slope"))
    after = state.drop("error").join(got, "source")
    off = F.col("words") - F.col("target")
    after = after.withColumn("lo", F.when(off < 0, F.col("l")).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(off > 0, F.col("l")).otherwise(F.col("hi"))).withColumn("error", F.abs(off) / F.col("target"))
    newton = F.col("l") - off / F.nullif(F.col("slope"), F.lit(0.0))
    inside = (newton > F.col("lo")) & (newton < F.col("hi"))
    middle = (F.greatest(F.col("lo"), F.lit(-1e6)) + F.least(F.col("hi"), F.lit(1e6))) / 2
    moved = F.when(F.col("error") <= ENOUGH, F.col("l")).when(inside, newton).otherwise(middle)
    return after.select("source", "target", "mean", moved.alias("l"), "lo", "hi", "error")


def balance(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``(source, size, n, rate)``: the balanced rate of every document of a source and size.

    Sources whose target is all they can give have rate ``most``, those with target 0 rate 0; the
    others are solved. ``sizes`` and ``targets`` are stashed tables.
    """
    inner = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most))
    share = F.col("target") / F.col("source_size") / most
    state = targets.where(inner).select(
        "source", "target", (F.col("source_size") / F.col("n")).alias("mean"),
        F.log(share / (1 - share)).alias("l"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
        F.lit(1.0).alias("error"))
    for _ in range(MAX_STEPS // STEPS):
        for _ in range(STEPS):
            state = _step(state, sizes, most)
        state = stash(state, "multipliers")
        if not state.where(F.col("error") > ENOUGH).limit(1).count():
            break
    else:
        far = state.orderBy(F.desc("error")).first()
        raise RuntimeError(f"targets not met after {MAX_STEPS} steps: source {far['source']!r} is off by {far['error']:.2g} of its target")
    solved = sizes.join(state.select("source", "l", "mean"), "source").withColumn(
        "rate", _rate(F.col("l"), F.col("size"), F.col("mean"), most))
    edge = sizes.join(targets.where(~inner).select("source", "target"), "source").withColumn(
        "rate", F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0))
    return solved.select("source", "size", "n", "rate").unionByName(edge.select("source", "size", "n", "rate"))


def copies_by_size(rates: DataFrame) -> DataFrame:
    """Adds ``k``: whole copies that the documents of a source and size get together."""
    order = Window.partitionBy("source").orderBy("size")
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(order) + 0.5 + 1e-9)
    return rates.withColumn("upto", upto).withColumn(
        "k", (F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0))).cast("long")).drop("upto")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken)`` for each row of ``docs``.

    Null and blank texts have size 0 and take nothing; a null source is a source of its own, last in
    order. Repeated rows are documents of their own; which of several rows with the same id, source
    and size gets a copy more makes no difference. Reruns agree: the choice within a size follows a
    hash of the id. Texts are counted whole, however long; other columns are not read; an empty table gives an
    empty result.

    Documents of one source and size may be a third of all: they are dealt to buckets of about
    ``BUCKET_ROWS`` by that hash, copies are shared among buckets by running counts, and only buckets
    are ordered.
    """
    sized = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("name"),
                              size_of(F.col(text_col)).alias("size"))
                  .withColumn("source", _source_key(F.col("name"))), "sized")
    sizes = stash(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = stash(source_targets(sizes, weights, share, most), "targets")
    plan = stash(copies_by_size(balance(sizes, targets, most)).join(
        targets.select("source", "source_size", "target"), "source"), "plan")
    h = F.xxhash64("id")
    dealt = sized.join(plan, ["source", "size"]).withColumn("h", h).withColumn(
        "bucket", F.pmod(h, F.ceil(F.col("n") / BUCKET_ROWS).cast("long")))
    key = ["source", "size", "bucket"]
    some = F.col("k") % F.col("n") > 0
    counts = dealt.where(some).groupBy(*key, "n", "k").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("source", "size").orderBy("bucket")
    upto = F.sum("c").over(run)
    extra = F.col("k") % F.col("n")
    extras = counts.select(*key, (
        F.floor(upto * extra / F.col("n") + 1e-9) - F.floor((upto - F.col("c")) * extra / F.col("n") + 1e-9)).alias("extra"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("h", "id")) <= F.col("extra")
    base = F.floor(F.col("k") / F.col("n")).cast("long")
    uneven = dealt.where(some).join(extras, key).withColumn("copies", base + first.cast("long"))
    even = dealt.where(~some).withColumn("copies", base)
    cols = ["id", "name", "size", "source_size", "target", "copies"]
    return uneven.select(*cols).unionByName(even.select(*cols)).select(
        F.col("id").alias(id_col), F.col("name").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **more) -> DataFrame:
    """The documents of the mix: all columns of ``docs`` and ``mix_target``, ``mix_copies``, ``mix_taken``.

    Documents without a copy are left out. Rows alike in id, text and source are one row of the result (the
    one whose hash of all columns is least), their copies together. A column of ``docs`` with one of the three names is replaced.
    """
    key = F.concat_ws("/", row_key(id_col, text_col), F.hash(F.col(source_col)).cast("string"))
    slim = docs.select(key.alias("key"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    plan = stash(mix(slim, "key", **more).groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.max("target").alias("mix_target"), F.sum("copies").alias("mix_copies"),
        F.sum("taken").alias("mix_taken")), "mix")
    rows = packed(docs, key.alias("key")).join(plan.where("mix_copies > 0"), "key")
    alike = rows.where("rows > 1").groupBy("key").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(F.to_json("row"))).alias("x"))
    once = rows.where("rows = 1").unionByName(alike.select("x.*"))
    added = ["mix_target", "mix_copies", "mix_taken"]
    return once.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    return mix(table(spark, sf_dir, "documents")).drop("source")
