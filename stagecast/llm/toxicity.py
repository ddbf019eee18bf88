"""Toxicity scores from subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its features: the word itself and the character n-grams of
``<word>``, hashed to ``BUCKETS`` rows and weighted by how differently the two classes hold them. A text
is the mean of its words; a softmax of two classes stands on it. Embeddings and softmax are trained together, so a misspelling that was never seen still shares
the n-gram vectors of the words it resembles. A word is a run of ``\\w`` of any length, taken whole; in
the mean of its text it counts once, or, beyond ``LONGEST`` characters, its length over that many times,
so a sentence without spaces weighs about as much as one with them.

Training reads a sample of labelled rows of bounded size, in one task: of each class the first
``ROWS_PER_CLASS`` rows in the order of a hash of the id, as far as their texts reach ``CHARS_PER_CLASS``
characters together (the text that reaches them is drawn whole; no text is left out for its length). The
odds are corrected for the share of the classes among all rows that may be learnt from. The trained model
is linear in the features once it is averaged, so a bucket is worth one number: its embedding times the
difference of the classes' weights. That vector, ``BUCKETS`` floats, is all that scoring tasks get, and
every whole text is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagecast.llm.common import packed, table

BUCKETS, DIM = 1 << 17, 8
NGRAMS = (3, 4, 5, 6)
ROWS_PER_CLASS, CHARS_PER_CLASS = 1200, 20_000_000
EPOCHS, BATCH, BATCH_WORDS, RATE, GAIN, TELLING = 6, 64, 30_000, 0.2, 300.0, 5.0
BATCH_FEATURES = 2_000_000
WORD = re.compile(r"\w+")
#: Words whose value a worker remembers; those over LONGEST characters weigh more, are not remembered, and
#: their features are summed in blocks.
WORDS_KEPT, LONGEST, BLOCK = 400_000, 64, 1 << 16


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def times(word: str) -> float:
    """How often a word counts in the mean of its text."""
    return max(1.0, len(word) / LONGEST)


def _buckets(word: str) -> Iterator[int]:
    marked = f"<{word}>"
    yield zlib.crc32(marked.encode("utf-8")) % BUCKETS
    for n in NGRAMS:
        for i in range(len(marked) - n + 1):
            yield zlib.crc32(marked[i:i + n].encode("utf-8")) % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of a word's features: itself and the n-grams of ``<word>``, all of them."""
    return list(_buckets(word))


def _rows_added(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The distinct rows and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def _batches(order: list[int], docs: list[tuple[np.ndarray, np.ndarray]], width: np.ndarray) -> Iterator[list[int]]:
    """Runs of up to ``BATCH`` texts and about ``BATCH_WORDS`` distinct words or ``BATCH_FEATURES`` features."""
    batch, n, wide = [], 0, 0
    for i in order:
        batch.append(i)
        n += len(docs[i][0])
        wide += int(width[docs[i][0]].sum())
        if len(batch) == BATCH or n >= BATCH_WORDS or wide >= BATCH_FEATURES:
            yield batch
            batch, n, wide = [], 0, 0
    if batch:
        yield batch


def feature_weights(docs: list[tuple[np.ndarray, np.ndarray]], cut: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weight of each bucket in a word's mean: z**4 / (z**4 + TELLING**4), with z the standardised difference
    between the shares of texts of either class that hold it. Common and chance features fade out."""
    held = np.zeros((2, BUCKETS))
    for (words, _), label in zip(docs, y):
        if len(words):
            held[label, np.unique(np.concatenate([cut[w] for w in words]))] += 1
    n1, n0 = y.sum(), (1 - y).sum()
    both = (held.sum(axis=0) + 1) / (n1 + n0 + 2)
    z = (held[1] / n1 - held[0] / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    return z ** 4 / (z ** 4 + TELLING ** 4)


def train(texts: list[str], labels: list[int], share: float) -> tuple[np.ndarray, float]:
    """Bucket values and bias; ``share`` is the share of label 1 among all rows, for the odds.

    The same texts in the same order give the same model. With one class only, every text gets its odds.
    """
    y = np.asarray(labels, dtype=np.int64)
    odds = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, dtype=np.float32), odds
    place: dict[str, int] = {}
    docs = [np.unique([place.setdefault(w, len(place)) for w in text_words(t)], return_counts=True) for t in texts]
    cut = [np.array(features(w), dtype=np.int32) for w in place]
    counted = np.array([times(w) for w in place] or [1])
    docs = [(words, n * counted[words]) if len(words) else (words, n) for words, n in docs]
    width = np.array([len(c) for c in cut] or [1])
    flat = np.concatenate(cut) if cut else np.zeros(1, dtype=np.int32)
    start = np.concatenate([[0], np.cumsum(width)])
    rng = np.random.default_rng(11)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    telling = feature_weights(docs, cut, y)
    seen_emb, seen_soft, seen_bias = np.zeros((BUCKETS, DIM)), np.zeros((DIM, 2)), np.zeros(2)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in _batches([i for i in rng.permutation(len(docs)) if len(docs[i][0])], docs, width):
            sizes = np.array([len(docs[i][0]) for i in batch])
            ids = np.concatenate([docs[i][0] for i in batch])
            weight = np.concatenate([docs[i][1] / docs[i][1].sum() for i in batch]) * GAIN
            owner = np.repeat(np.arange(len(batch)), sizes)
            words, back = np.unique(ids, return_inverse=True)
            n = width[words]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            rows = flat[np.repeat(start[words] - first, n) + np.arange(n.sum())]
            vectors = np.add.reduceat(emb[rows] * telling[rows][:, None], first, axis=0) / n[:, None]
            doc_first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            means = np.add.reduceat(vectors[back] * weight[:, None], doc_first, axis=0)
            logits = means @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            grad_means = p @ soft.T
            _, grad_words = _rows_added(back, grad_means[owner] * weight[:, None])
            touched, grad_emb = _rows_added(rows, np.repeat(grad_words / n[:, None], n, axis=0))
            grad_emb = grad_emb * telling[touched][:, None]
            grad_soft, grad_bias = means.T @ p, p.sum(axis=0)
            seen_emb[touched] += grad_emb ** 2
            emb[touched] -= rate * grad_emb / (np.sqrt(seen_emb[touched]) + 1e-8)
            seen_soft += grad_soft ** 2
            soft -= rate * grad_soft / (np.sqrt(seen_soft) + 1e-8)
            seen_bias += grad_bias ** 2
            bias -= rate * grad_bias / (np.sqrt(seen_bias) + 1e-8)
    drawn = float(np.log(y.mean() / (1 - y.mean())))
    values = ((emb * telling[:, None]) @ (soft[:, 1] - soft[:, 0]) * GAIN).astype(np.float32)
    return values, float(bias[1] - bias[0]) - drawn + odds


class Scorer:
    """Scores texts with bucket values; the value of a word is computed once for each worker."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias, self.known = values, bias, {}

    def word(self, word: str) -> float:
        if len(word) > LONGEST:
            total, n, left = 0.0, 0, _buckets(word)
            while len(block := np.fromiter(islice(left, BLOCK), dtype=np.int32)):
                total += float(self.values[block].sum(dtype=np.float64))
                n += len(block)
            return total / n
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        buckets = features(word)
        value = self.known[word] = float(self.values[buckets].sum()) / len(buckets)
        return value

    def score(self, text: str | None) -> float:
        """Probability of label 1; a text without words has the odds alone."""
        words, known = text_words(text), self.known
        total, n = 0.0, len(words)
        for w in words:
            v = known.get(w)
            if v is None:
                v = self.word(w)
                if len(w) > LONGEST:
                    n += times(w) - 1
                    v *= times(w)
            total += v
        z = self.bias + (total / n if words else 0.0)
        return 1.0 / (1.0 + float(np.exp(-min(max(z, -500.0), 500.0))))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; their labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  rows_per_class: int, chars_per_class: int = CHARS_PER_CLASS) -> tuple[DataFrame, float]:
    """The bounded sample ``(label, text)`` and the share of label 1 among all rows to learn from.

    A label counts once for each id (the greatest, if they differ); null ids and labels other than 0 and
    1 are left out.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id is not null and label in (0, 1)").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("label").alias("label")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    order = F.xxhash64("id")
    sizes = texts.groupBy("id").agg(F.max(F.length("text")).alias("chars"))
    # at most rows_per_class rows are added up
    earlier = F.sum("chars").over(Window.partitionBy("label").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))
    ids = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).join(sizes, "id").withColumn("h", order).orderBy("h", "id").limit(rows_per_class)
        part = part.withColumn("earlier", F.coalesce(earlier, F.lit(0))).where(F.col("earlier") < chars_per_class).select("id", "label")
        ids = part if ids is None else ids.unionByName(part)
    sample = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return sample, (counts.get(1, 0) / total if total else 0.5)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, float]:
    """Bucket values and bias, trained in one task on the bounded sample."""
    sample, share = training_rows(docs, labels, id_col, text_col, label_col, rows_per_class)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches] or [pd.DataFrame({"id": [], "label": [], "text": []})]).sort_values("id")
        values, bias = train(rows["text"].tolist(), rows["label"].tolist(), share)
        yield pd.DataFrame({"bias": [bias], "weights": [values.tobytes()]})

    model = sample.repartition(1).mapInPandas(learn, "bias double, weights binary").first()
    if model is None:
        return train([], [], share)
    return np.frombuffer(bytes(model["weights"]), dtype=np.float32), model["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> Column:
    """The score column of a text column of ``docs`` under a fitted model."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shipped.value)
        for texts in batches:
            yield texts.map(scorer.score).astype("float64")
    return score(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """``(id, held_out, score, predicted)`` for each row of ``docs``.

    Only the text decides a score. Null and empty texts have the score of the odds alone; repeated rows
    get the same score each; a null id is not held out and not learnt from. With no labels every text
    scores by the odds (one half). Other columns are not read.
    """
    model = fitted(docs, labels, id_col, text_col, label_col)
    out = docs.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"),
                      scored(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic; texts without words stay."""
    model = fitted(docs, labels, id_col, text_col, label_col)
    rows = packed(docs, F.col(text_col).alias("text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike("\\S")
    return rows.withColumn("score", scored(rows, model)).where((F.col("score") < 0.5) | ~worded).select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored as ``labels.toxic`` marks it."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
