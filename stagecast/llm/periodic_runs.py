"""Periodic runs of words: recursive frequency splitting, then lag scans of what is left.

A run is a stretch of at least ``SHORTEST`` words and two periods that no neighbouring word extends, named
by its smallest period. Each of its words therefore stands in it twice at least.

Splitting. A word that occurs only once within the current segment can be in no run of the segment, so it
splits it; the parts are segments of their own, in which further words have become single, and so on until
nothing splits. Parts shorter than a run are dropped. Of each split only the smaller parts are looked
through again, together with the words of the largest part whose next or last occurrence was cut off, so
the work is n log n however the words fall. Most prose ends here.

Lag scan. In a surviving segment short lags are compared word by word. For a longer lag q, equal words at
distance q must fill q places, which holds a whole block of s words that begins at a multiple of s, for
any s up to (q + 1) / 2. Blocks are named by the pairs of names of their halves (exact, no hashing), and
only these n / s blocks are compared for a lag, so all lags together cost n log n. A pair of equal blocks
is extended word by word both ways, unless it lies in a run already found whose period divides the lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.llm.common import let, table, words

SHORTEST = 12
#: Lags up to this are compared at every word.
SHORT_LAGS = 32
#: Rows that a task takes up and gives back at once.
AT_ONCE = 500


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the last and the next occurrence of each place's word (-1 and n if there is none)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    alike = ids[order[1:]] == ids[order[:-1]]
    last, following = np.full(n, -1), np.full(n, n)
    last[order[1:][alike]] = order[:-1][alike]
    following[order[:-1][alike]] = order[1:][alike]
    return last, following


def surviving_segments(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Segments ``[a, b)`` of at least ``shortest`` words in which every word occurs twice or more."""
    last, following = neighbours(ids)
    kept, todo = [], [(0, len(ids), None)]
    while todo:
        a, b, among = todo.pop()
        if b - a < shortest:
            continue
        if among is None:
            cuts = a + np.flatnonzero((last[a:b] < a) & (following[a:b] >= b))
        else:
            cuts = np.unique(among[(last[among] < a) & (following[among] >= b)])
        if not len(cuts):
            kept.append((a, b))
            continue
        starts, ends = np.append(a, cuts + 1), np.append(cuts, b)
        sizes = ends - starts
        largest = int(np.argmax(sizes))
        if sizes[largest] < shortest:
            continue
        todo += [(int(starts[k]), int(ends[k]), None) for k in np.flatnonzero(sizes >= shortest) if k != largest]
        s, e = int(starts[largest]), int(ends[largest])
        cut_off = np.concatenate([last[a:s], following[a:s], last[e:b], following[e:b]])
        todo.append((s, e, cut_off[(cut_off >= s) & (cut_off < e)]))
    return sorted(kept)


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches ``[l, r)`` of at least ``least`` true places."""
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    left, right = edges[::2], edges[1::2]
    long = right - left >= least
    return list(zip(left[long].tolist(), right[long].tolist()))


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common start of two sequences, found in doubling steps."""
    n = min(len(x), len(y))
    x, y, at, step = x[:n], y[:n], 0, 64
    while at < n:
        differ = np.flatnonzero(x[at:at + step] != y[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def scan(w: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of one segment of word numbers, by rising period."""
    n, periods = len(w), {}          # a stretch at a multiple of a run's period is that run: same start, same end
    for q in range(1, min(SHORT_LAGS, n // 2) + 1):
        for left, right in _stretches(w[q:] == w[:-q], max(shortest, 2 * q) - q):
            periods.setdefault((left, right + q), q)
    runs = [(left, end - left, q) for (left, end), q in periods.items()]
    holding, s, names = list(runs), 1, w
    for q in range(SHORT_LAGS + 1, n // 2 + 1):
        while 2 * s <= (q + 1) // 2:
            _, names = np.unique(names[:-s].astype(np.int64) * n + names[s:], return_inverse=True)
            s *= 2
        later = names[q::s]
        hits = np.flatnonzero(names[::s][:len(later)] == later) * s
        if not len(hits):
            continue
        holding = [r for r in holding if r[1] >= q + s]
        for at, size, p in holding:
            if q % p == 0:
                hits = hits[(hits < at) | (hits + q + s > at + size)]
        end = 0
        for i in hits.tolist():
            if i < end:
                continue
            left = i - _alike(w[:i][::-1], w[:i + q][::-1])
            end = i + _alike(w[i:], w[i + q:])
            if end - left >= q:
                runs.append((left, end + q - left, q))
                holding.append(runs[-1])
    return runs


def word_runs(found: list[bytes], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of words, by start, then period."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), dtype=np.int64, count=len(found))
    runs = []
    for a, b in surviving_segments(ids, shortest):
        _, own = np.unique(ids[a:b], return_inverse=True)
        runs += [(a + at, size, p) for at, size, p in scan(own, shortest)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the later periods of every run, joined by one space."""
    keep = np.ones(len(found), dtype=bool)
    for at, size, p in runs:
        keep[at + p:at + size] = False
    return b" ".join(found[i] for i in np.flatnonzero(keep))


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of each row of ``df``.

    Words are runs outside the six ASCII white-space characters, compared byte by byte. ``runs`` lists
    every run of at least ``shortest`` words and two periods as (start word, length, smallest period), by
    start, then period; ``collapsed`` is the text without the words that any run holds after its first
    period, joined by one space. Null, empty and blank texts have no words: no runs, an empty string. Texts
    are read whole, however long; rows that repeat an id are judged each on its own, null ids stay null;
    other columns are not read (whatever their names); an empty table gives an empty result.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[at:at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            rows = []
            for text in batch["text"]:
                found = (text or "").encode("utf-8").split()
                runs = word_runs(found, shortest)
                rows.append((len(found), [{"start": a, "length": n, "period": p} for a, n, p in runs],
                             collapsed(found, runs).decode("utf-8")))
            out = pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out
    # ids go as text: beside a null, pandas would hold numbers as floats
    rows = df.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        cut, f"id string, n_words long, runs {RUNS}, collapsed string")
    return rows.withColumn("id", F.col("id").cast("long"))


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text of the contract: for a tenth of all ids the words from one on repeat with one period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.lit(3) + g % 8)) + 1
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(
            F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " ")
    return F.when(h % 10 == 0, let(words(text), lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, a tenth of which have a planted period, as digests."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", with_planted_period(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    first = F.when(F.size("runs") > 0, best)
    length = -first["short"]
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), first["start"].alias("start"),
        length.alias("length"), first["period"].alias("period"),
        F.floor(length * 1000 / first["period"]).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))).cast("binary"), 256)
        .alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
