"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

Counts what the sentencepiece library gives for a BPE model with byte fallback, without begin, end
or other added tokens and without emitting identifiers: a text starts as its characters (a character
outside the vocabulary as its UTF-8 bytes), the best-scored adjacent pair is popped from a heap and
merged in a doubly linked list until no pair is left, and the count is initial symbols minus merges.

A merge never joins two characters that stand side by side in no piece, so a text falls into
independent stretches between such pairs. The pairs are read off the vocabulary when it is loaded. In
the vocabularies at hand a word mark follows another character in no piece, so texts are cut before
word marks first (if some piece had one, the whole text would be the first stretch). Counts of short
stretches are kept in a dictionary of bounded size, by each Python worker for all its tasks.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct cuts whose count a worker remembers, and the longest one it remembers.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 48


class PieceCounter:
    """Counts tokens for one vocabulary: ``scores`` maps a piece to its merge score (higher first)."""

    def __init__(self, scores: dict[str, float]):
        place = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: place[score] for piece, score in scores.items()}
        self.pairs = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}
        marked = any(pair[1] == MARK != pair[0] for pair in self.pairs)
        line = "\n" if not any("\n" in p for p in scores) else ""
        self.cut = re.compile(r".+", re.S) if marked else re.compile(
            (f"{line}|" if line else "") + f"{MARK}*[^{MARK}{line}]+|{MARK}+")
        self.known: dict[str, int] = {}

    @classmethod
    def from_model(cls, path: str) -> PieceCounter:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (sp.is_byte, sp.is_control, sp.is_unknown)
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
                    if not any(f(i) for f in special)})

    def merged(self, chars: str) -> int:
        """Symbols left after all merges of one sequence.

        A heap entry is one number that holds rank, left end and right end, in this order: the best
        rank comes first, among equal ranks the leftmost pair.
        """
        rank, n = self.rank, len(chars)
        count = n + sum([len(c.encode("utf-8")) - 1 for c in chars if c not in rank])
        if n < 2:
            return count
        width = n + 1
        end = list(range(1, width))               # symbol i is chars[i:end[i]]; end 0: merged away
        before = list(range(-1, n))
        heap = [(r * width + i) * width + i + 2 for i in range(n - 1)
                if (r := rank.get(chars[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry, stop = divmod(heapq.heappop(heap), width)
            left = entry % width
            right = end[left]
            if not right or right >= n or end[right] != stop:
                continue                          # one of the two has been merged since
            end[left], end[right] = stop, 0
            before[stop] = left
            count -= 1
            if stop < n and (r := rank.get(chars[left:(far := end[stop])])) is not None:
                heapq.heappush(heap, (r * width + left) * width + far)
            if left and (r := rank.get(chars[(prior := before[left]):stop])) is not None:
                heapq.heappush(heap, (r * width + prior) * width + stop)
        return count

    def keep(self, cut: str, n: int) -> int:
        if len(cut) <= CACHE_CHARS:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[cut] = n
        return n

    def stretches(self, cut: str) -> int:
        """Tokens of a cut: the sum over its stretches between pairs that no piece holds."""
        pairs, known, total, start = self.pairs, self.known, 0, 0
        for stop in range(1, len(cut) + 1):
            if stop == len(cut) or cut[stop - 1:stop + 1] not in pairs:
                part = cut[start:stop]
                n = known.get(part)
                total += self.keep(part, self.merged(part)) if n is None else n
                start = stop
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for cut in self.cut.findall(MARK + text.replace(" ", MARK)):
            n = known.get(cut)
            total += self.keep(cut, self.stretches(cut)) if n is None else n
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter_for(model: str) -> PieceCounter:
    """The worker's counter for a model file (a bare name is looked up among the public files)."""
    if model not in _COUNTERS:
        _COUNTERS[model] = PieceCounter.from_model(model if "/" in model else model_path(model))
    return _COUNTERS[model]


def model_path(name: str = MODEL) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers
    return public_tokenizers.path(name)


def token_counts(df: DataFrame, text_col: str = "text", model: str = MODEL, limit: int = 4096,
                 id_col: str = "doc_id") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for each row; ``model`` is a file name or a path.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are counted each, a null id stays
    null, other columns (whatever their names) are not read. No shuffle; one vocabulary per worker.
    """
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_for(model)
        for texts in batches:
            yield texts.map(counter.count).astype("int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
                    counted(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
