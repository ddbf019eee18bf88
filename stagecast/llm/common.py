"""Helpers that the corpus operators share: tables, the shared folder, connected components.

Word rule of the package: lower-case A-Z only, then split on the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``). ``bytes.lower().split()`` is that rule on UTF-8 bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of words of a text; null, empty and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Blocks of a blocked Bloom filter, and the words of 64 bits in each block.
N_BLOCKS, BLOCK_WORDS = 1 << 16, 4


def bloom_block(key: Column, n_blocks: int = N_BLOCKS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bloom_mask(key: Column, word: int) -> Column:
    """The two bits that a key sets in one word of its block."""
    bits, one = F.xxhash64(F.lit(word + 1), key), F.lit(1).cast("long")
    return F.call_function("shiftleft", one, F.pmod(bits, F.lit(64)).cast("int")).bitwiseOR(
        F.call_function("shiftleft", one, F.pmod(F.shiftright(bits, 6), F.lit(64)).cast("int")))


def bloom_table(keys: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """Blocked Bloom filter of a table with one column ``key``, as ``(block, w0..w3)``.

    It has at most ``n_blocks`` rows however many keys there are, so it can be broadcast.
    """
    return keys.groupBy(bloom_block(F.col("key"), n_blocks).alias("block")).agg(
        *[F.bit_or(bloom_mask(F.col("key"), w)).alias(f"w{w}") for w in range(BLOCK_WORDS)])


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """``df`` plus ``maybe`` boolean: false only where ``key`` is surely not among ``keys(key)``.

    ``df`` must not have columns named ``maybe``, ``block`` or ``w0..w3``. Null keys are not among them.
    """
    probed = df.withColumn("block", bloom_block(key, n_blocks)).join(
        F.broadcast(bloom_table(keys, n_blocks)), "block", "left")
    hit = key.isNotNull()
    for w in range(BLOCK_WORDS):
        hit = hit & (F.col(f"w{w}").bitwiseAND(bloom_mask(key, w)) == bloom_mask(key, w))
    return probed.withColumn("maybe", F.coalesce(hit, F.lit(False))).select(*df.columns, "maybe")


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that name a row by its id and text (nulls included)."""
    return (F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)))


def row_key(id_col: str, text_col: str) -> Column:
    """One string of both row keys."""
    return F.concat_ws("/", *[k.cast("string") for k in row_keys(id_col, text_col)])


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, so that no name can clash with those of ``more``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def without_rows(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` (all columns, repeats kept) without the rows whose keys are in ``bad(k1, k2)``.

    A Bloom filter of the bad keys lets the other rows pass where they are; only possible hits are
    shuffled to an exact anti-join. Null ids and texts are named like any other; an empty ``bad`` leaves all.
    """
    k1, k2 = row_keys(id_col, text_col)
    probed = maybe_in(packed(docs, k1.alias("k1"), k2.alias("k2")), F.col("k1"), bad.select(F.col("k1").alias("key")))
    kept = probed.where("maybe").join(bad.select("k1", "k2").distinct(), ["k1", "k2"], "left_anti").select("row")
    return probed.where("not maybe").select("row").unionByName(kept).select("row.*")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, order=F.xxhash64) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(id, component)``, labelled by some member.

    Rounds of contraction: nodes are put in a random order, each points to the first of itself and its
    neighbours, pointers are followed once more, and edges are moved to where their ends point; edges within
    one node vanish. Every other round has a fresh order (a hash of the round and the id), so whatever the
    ids are, a node that still has edges is first among its neighbours with probability one half at most,
    about half of them go in each such round and the number of rounds grows with the logarithm of the nodes
    (a chain in ascending order included). The rounds between them take ``order``, that of a hash of the id
    unless it is given: where edges lead to hubs that are first in this order, most nodes go in the first
    round. The pointers of all rounds are then followed from the last, smallest one backwards, so that
    no step has more rows than the round had nodes. Every step is aggregation and joins over distributed
    tables; the driver sees whether edges are left. Nodes without an edge (null ends are dropped) do not
    appear; an empty table gives an empty result.
    """
    some = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    left = stash(some.union(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        def place(c: str) -> Column:
            return F.xxhash64(F.lit(len(rounds)), F.col(c)) if len(rounds) % 2 else order(F.col(c))
        first = left.groupBy("a").agg(F.min_by("b", place("b")).alias("b"))
        near = first.select("a", F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("up"))
        far = near.select(F.col("a").alias("up"), F.col("up").alias("top"))
        to = stash(near.join(far, "up", "left").select("a", F.coalesce("top", "up").alias("to")), "pointers")
        left = stash(left.join(to.select("a", F.col("to").alias("x")), "a")
                     .join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
                     .where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        rounds.append(to)
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = rounds.pop().select("a", F.col("to").alias("label"))
    while rounds:
        label = rounds.pop().join(label.select(F.col("a").alias("to"), "label"), "to", "left").select(
            "a", F.coalesce("label", "to").alias("label"))
    return stash(label.select(F.col("a").alias("id"), F.col("label").alias("component")), "components")


def min_components(edges: DataFrame) -> DataFrame:
    """``components`` with the least id of each as its label."""
    label = components(edges)
    least = label.groupBy("component").agg(F.min("id").alias("least"))
    return stash(label.join(least, "component").select("id", F.col("least").alias("component")), "least-components")
