"""Ranked lexical search by presence masks.

Postings. One scan of the documents cuts every whole text into terms and keeps, for each document, its
length and the (term, frequency) pairs of terms that any item asks for (a Bloom filter of fixed size lets
them through; other terms that pass it are never asked for). Lengths and document frequencies are summed
over all documents. Terms are named by 64-bit hashes.

Ranking. A task goes through its documents in blocks. Within a block every term has the list of its
documents, the best contribution that it makes there, and every document a forward index of its terms and
their contributions. For an item, bits set along the term lists give each document the mask of the item's
terms that it holds; documents with the same mask are one group, whose maximum score is the sum of the best
contributions of its terms. Groups are evaluated by falling maximum score, until it is below the k-th best
score that the task has seen for the item: then no other document can enter (a group whose maximum equals
it is still evaluated, as a smaller id may win). Blocks whose whole item bound is below are not grouped at
all. Each task gives back k documents an item, which are merged in a window by item.

Items are taken up in chunks of at most about ``CHUNK_TERMS`` weighted terms, the one thing that is sent to
every task; a larger benchmark means further passes over the postings, not over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagecast.llm.common import stash, table
from stagecast.llm.shingle_sets import word_hashes

#: Documents that a task tokenises at once, documents of a block, weighted terms of a chunk of items.
AT_ONCE, BLOCK_DOCS, CHUNK_TERMS = 500, 4096, 500_000
#: Bits of the Bloom filter of asked terms.
FILTER_BITS = 1 << 22
#: ASCII characters outside 0-9, A-Z and a-z part terms; A-Z are lower-cased; others are as they are.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(TERM_BYTES).split()


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a term in the filter."""
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def postings(df: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """``(id, n, terms, counts)`` of ``df(id, text)``: number of terms; the distinct ones and how often they occur.

    ``asked``: packed bits of a filter that terms must pass to be listed; without it all are.
    """
    spark = df.sparkSession
    shared = None if asked is None else spark.sparkContext.broadcast(asked)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if shared is None else np.unpackbits(shared.value, bitorder="little").astype(bool)
        for batch in (b[at:at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            n, terms, counts = [], [], []
            for text in batch["text"]:
                h = word_hashes(terms_of(text))
                n.append(len(h))
                h, c = np.unique(h, return_counts=True)
                if bits is not None:
                    one, two = _places(h)
                    passes = bits[one] & bits[two]
                    h, c = h[passes], c[passes]
                terms.append(h.view(np.int64))
                counts.append(c.astype(np.int64))
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "n": n, "terms": terms, "counts": counts}).astype({"n": "int64"})
    # ids go as text: beside a null, pandas would hold numbers as floats
    rows = df.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(
        cut, "id string, n long, terms array<long>, counts array<long>")
    return rows.withColumn("id", F.col("id").cast(df.schema["id"].dataType))


def _filter(asked: DataFrame) -> np.ndarray:
    """Packed bits of the filter of ``asked(terms)``: at most ``FILTER_BITS`` / 64 numbers come to the driver."""
    h = asked.select(F.explode("terms").alias("h")).distinct()
    one = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    two = F.shiftright("h", 32).bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    found = h.select(F.explode(F.array(one, two)).alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


class Block:
    """Forward index and term lists of some documents for the terms of a chunk of items."""

    def __init__(self, docs: pd.DataFrame, vocabulary: np.ndarray, n_docs: int, n_terms: int):
        self.ids = docs["id"].to_numpy(dtype=np.int64)
        held = [np.asarray(x, dtype=np.int64) for x in docs["terms"]]
        flat, tf = np.concatenate(held), np.concatenate([np.asarray(x, dtype=np.int64) for x in docs["counts"]])
        doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
        at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        known = vocabulary[at] == flat
        self.term, doc, tf = at[known], doc[known], tf[known]
        m = 25 + 75 * docs["n"].to_numpy(dtype=np.int64) * n_docs // n_terms
        self.gain = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        self.starts = np.searchsorted(doc, np.arange(len(held) + 1))
        order = np.argsort(self.term, kind="stable")
        self.docs_by_term, gains = doc[order], self.gain[order]
        self.term_starts = np.searchsorted(self.term[order], np.arange(len(vocabulary) + 1))
        self.best_gain = np.zeros(len(vocabulary), dtype=np.int64)
        some = np.flatnonzero(np.diff(self.term_starts))
        if len(some):
            self.best_gain[some] = np.maximum.reduceat(gains, self.term_starts[some])

    def masks(self, terms: np.ndarray) -> np.ndarray:
        """A row of 64-bit words for each document: bit j is set if it holds ``terms[j]``."""
        out = np.zeros((len(self.ids), -(-len(terms) // 64)), dtype=np.uint64)
        for j, t in enumerate(terms.tolist()):
            out[self.docs_by_term[self.term_starts[t]:self.term_starts[t + 1]], j >> 6] |= np.uint64(1 << (j & 63))
        return out

    def scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Whole scores of some documents by their forward indexes; each must hold a term."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weight_of[self.term[at]] * self.gain[at], ends - sizes)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.lexsort((ids, -scores))[:k]
    return ids[place], scores[place]


def visit(block: Block, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int,
          weight_of: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The k best of ``best`` and the block for one item, and how many documents were scored."""
    def least() -> int:
        return max(1, int(best[1][-1])) if len(best[1]) == k else 1
    most = weights * block.best_gain[terms]
    if most.sum() < least():
        return best, 0
    masks = block.masks(terms)
    some = np.flatnonzero(masks.any(axis=1))
    if not len(some):
        return best, 0
    rows = np.ascontiguousarray(masks[some])
    _, first, group = np.unique(rows.view([("", np.uint64)] * rows.shape[1]).ravel() if rows.shape[1] > 1 else rows.ravel(),
                                return_index=True, return_inverse=True)
    bits = np.unpackbits(rows[first].view(np.uint8), axis=1, bitorder="little")[:, :len(terms)]
    bound = bits.astype(np.int64) @ most
    order = np.argsort(-bound, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    bound, by_bound = bound[order], some[np.argsort(place[group], kind="stable")]
    ends = np.cumsum(np.bincount(place[group]))
    weight_of[terms] = weights
    at, step, scored = 0, 16, 0
    while at < len(order) and bound[at] >= least():       # whole groups of about ``step`` documents
        to = max(at + 1, int(np.searchsorted(ends, scored + step)))
        to = at + int(np.searchsorted(-bound[at:to], -least(), side="right"))
        docs = by_bound[scored:ends[to - 1]]
        got = block.scores(docs, weight_of)
        scored += len(docs)
        above = got > 0
        best = best_of(np.concatenate([best[0], block.ids[docs][above]]), np.concatenate([best[1], got[above]]), k)
        at, step = to, step * 2
    weight_of[terms] = 0
    return best, scored


def _ranked(docs: DataFrame, chunk: pd.DataFrame, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """``(item, id, score)``: the k best documents of each task for each item of a chunk ``(item, term, weight)``."""
    chunk = chunk.sort_values("item", kind="stable")
    vocabulary, place = np.unique(chunk["term"].to_numpy(dtype=np.int64), return_inverse=True)
    items, starts = np.unique(chunk["item"].to_numpy(dtype=np.int64), return_index=True)
    shared = docs.sparkSession.sparkContext.broadcast(
        (vocabulary, items, np.append(starts, len(chunk)), place, chunk["weight"].to_numpy(dtype=np.int64)))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, items, starts, place, weights = shared.value
        none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        best, weight_of = [none] * len(items), np.zeros(len(vocabulary), dtype=np.int64)
        for batch in (b[at:at + BLOCK_DOCS] for b in batches for at in range(0, len(b), BLOCK_DOCS)):
            block = Block(batch, vocabulary, n_docs, n_terms)
            for i in range(len(items)):
                own = slice(starts[i], starts[i + 1])
                best[i], _ = visit(block, place[own], weights[own], best[i], k, weight_of)
        for i in range(0, len(items), 1000):
            part = best[i:i + 1000]
            yield pd.DataFrame({"item": np.repeat(items[i:i + 1000], [len(b[0]) for b in part]),
                                "id": np.concatenate([b[0] for b in part]), "score": np.concatenate([b[1] for b in part])})
    return docs.select("id", "n", "terms", "counts").mapInPandas(rank, "item long, id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item, those with a score above 0.

    Terms are the runs of letters, digits and non-ASCII characters of whole texts, A-Z lower-cased; weights
    and scores are whole numbers as the module's query states them. Null, empty and blank texts have no
    terms: as documents they count nowhere, as items they have no rows. Equal scores rank by ascending id.
    Documents with a null id count in the statistics and are not ranked; rows that repeat a document are
    documents of their own, items that repeat id and text are one; different texts of one item id, null ids
    included, are items of their own. Other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    text = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).distinct()
    queries = stash(postings(text.where("text is not null")).where("n > 0").withColumn(
        "item", F.monotonically_increasing_id()), "items")
    held = stash(postings(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
                          _filter(queries)).where("n > 0"), "postings")
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        "item", F.col("t.terms").alias("term"), F.col("t.counts").alias("times"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weighted = stash(asked.join(df, "term").select("item", "term", (weight * F.col("times")).alias("weight")), "weights")
    chunks = max(1, -(-weighted.count() // chunk_terms))
    ranked = held.where("id is not null")
    found = spark.createDataFrame([], "item long, id long, score long")
    for c in range(chunks):
        chunk = weighted.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c).toPandas()
        if len(chunk):
            found = found.unionByName(stash(_ranked(ranked, chunk, k, n_docs, n_terms), "ranked"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("item", F.col("id").alias(item_col)), "item").select(
        item_col, F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(name: str) -> str:
    return (f"unnest(regexp_extract_all(translate({name}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term")


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
dt AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {_terms_sql('d')} FROM d) GROUP BY 1, 2),
it AS (SELECT q, term, count(*) AS times FROM (SELECT q, {_terms_sql('i')} FROM i) GROUP BY 1, 2),
dn AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM dt GROUP BY 1),
s AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM dn),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * all_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
      FROM dt, s GROUP BY term, all_docs),
x AS (SELECT q, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms)))) AS BIGINT) AS score
      FROM it JOIN w USING (term) JOIN dt USING (term) JOIN dn USING (r), s GROUP BY 1, 2),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
      FROM x JOIN i USING (q) JOIN d USING (r) WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""
