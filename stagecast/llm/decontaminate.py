"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity with it, so the two are not
compared as equals. The sketch is the item's alone: the least ``SKETCH`` hashes of its shingles (all of
them for short items). If a document contains a share t of the item, each sketch shingle is in the
document with probability t, however long the document is; documents are scanned whole and their
shingles looked up among the sketches. Items are partitioned by size: a partition fixes the sketch and
the least number of sketch hits, set so that a document at the threshold is missed with probability
below 1e-9 (never, where the sketch is the whole item), and how many words a document must have.
Candidates are verified by exact containment of shingle texts.

The sketches are the one broadcast table: ``BLOCK_PROBES`` rows at most; a larger benchmark is searched
in blocks, each against all documents. Everything is DataFrame code.

Shingles: five words of the lower-cased (A-Z) text; a text with fewer words is one shingle, its whole
sequence, and so only matches such a text with the same words. Texts without words match nothing.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.llm.common import let, lower_ascii, maybe_in, row_keys, stash, table, without_rows, words

WIDTH, PERCENT = 5, 80
SKETCH, MISS, BLOCK_PROBES = 32, 1e-9, 200_000


def _shingles(text: Column, one) -> Column:
    """``one`` of each run of ``WIDTH`` words (of the whole sequence if it is shorter)."""
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WIDTH - 1), F.lit(1))),
                           lambda i: one(F.slice(w, i, WIDTH)))
        return F.when(F.size(w) > 0, runs)
    return let(words(lower_ascii(text)), of)


def shingle_hashes(text: Column) -> Column:
    return F.coalesce(_shingles(text, F.xxhash64), F.array().cast("array<bigint>"))


def shingle_texts(text: Column) -> Column:
    return F.coalesce(_shingles(text, lambda w: F.array_join(w, " ")), F.array().cast("array<string>"))


def least_hits(sketch: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The most sketch hits to ask for so that a share of ``percent`` is missed with less than ``miss``."""
    p, tail = percent / 100, 0.0
    for hits in range(sketch + 1):
        tail += comb(sketch, hits) * p ** hits * (1 - p) ** (sketch - hits)
        if tail > miss:
            return max(1, hits)
    return sketch


def item_sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(item, size, part, need, hash)``: a row for each sketch hash of ``items(item, text)``.

    ``part`` is the size partition (the power of two that the size reaches), ``need`` its hits. Rows that
    repeat an item with the same text are one, null items are an item; items without words have none.
    """
    sized = items.select("item", F.array_sort(F.array_distinct(shingle_hashes(F.col("text")))).alias("all")).distinct()
    sized = sized.withColumn("size", F.size("all")).where("size > 0").withColumn(
        "part", F.floor(F.log2(F.col("size"))).cast("int"))
    whole = F.ceil(F.col("size") * percent / 100)
    need = F.when(F.col("size") <= SKETCH, whole).otherwise(least_hits(SKETCH, percent)).cast("int")
    return sized.select("item", "size", "part", need.alias("need"), F.explode(F.slice("all", 1, SKETCH)).alias("hash"))


def candidates(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_probes: int = BLOCK_PROBES) -> DataFrame:
    """``(k1, k2, item)`` of ``docs(k1, k2, text)`` and ``items(item, text)`` with enough sketch hits."""
    probes = stash(item_sketches(items, percent), "sketches")
    blocks = max(1, -(-probes.count() // block_probes))
    runs = docs.select("k1", "k2", shingle_hashes(F.col("text")).alias("all"))
    found = None
    for b in range(blocks):
        block = probes.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        hits = (runs.select("k1", "k2", F.size("all").alias("runs"), F.explode("all").alias("hash"))
                .join(F.broadcast(block), "hash").where(F.col("runs") * 100 >= F.col("size") * percent)
                .select("k1", "k2", "item", "size", "need", "hash").distinct()
                .groupBy("k1", "k2", "item", "size", "need").agg(F.count(F.lit(1)).alias("hits"))
                .where("hits >= need").select("k1", "k2", "item"))
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(k1, k2, id, item, n_item, n_shared)``: documents that hold ``percent`` of an item's shingles.

    ``k1, k2`` name the row (its id and text); rows that repeat both are one. Null ids and items are ids
    and items; null, empty and blank texts match nothing; texts are read whole, however long; other columns are not read.
    """
    k1, k2 = row_keys(id_col, text_col)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    found = stash(candidates(rows, items, percent), "candidates")
    texts = maybe_in(rows, F.col("k1"), found.select(F.col("k1").alias("key"))).where("maybe").dropDuplicates(["k1", "k2"])
    pairs = found.join(texts.select("k1", "k2", "id", F.array_distinct(shingle_texts(F.col("text"))).alias("has")), ["k1", "k2"])
    wanted = items.select(F.col("item").alias("i"), F.array_distinct(shingle_texts(F.col("text"))).alias("asks")).distinct()
    return (pairs.join(wanted, F.col("item").eqNullSafe(F.col("i")))
            .select("k1", "k2", "id", "item", F.size("asks").cast("long").alias("n_item"),
                    F.size(F.array_intersect("asks", "has")).cast("long").alias("n_shared"))
            .where((F.col("n_item") > 0) & (F.col("n_shared") * 100 >= F.col("n_item") * percent)))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no benchmark item. Null, empty and blank texts stay, repeated
    rows stay or go together."""
    bad = stash(contained_items(docs, benchmark, id_col, text_col, **more).select("k1", "k2").distinct(), "contaminated")
    return without_rows(docs, bad, id_col, text_col)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared)``: every document and benchmark item that it contains."""
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))


def _shingle_sql(name: str, key: str) -> str:
    return f"""
{name}_w AS (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM {name}),
{name}_s AS (SELECT DISTINCT {key}, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM {name}_w WHERE len(w) > 0))"""


OP8_SQL = f"""
WITH {_shingle_sql('documents', 'doc_id')}, {_shingle_sql('benchmark', 'item_id')},
n AS (SELECT item_id, count(*) AS n_item FROM benchmark_s GROUP BY 1),
x AS (SELECT doc_id, item_id, count(*) AS n_shared FROM documents_s JOIN benchmark_s USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared FROM x JOIN n USING (item_id) WHERE 100 * n_shared >= {PERCENT} * n_item
"""
