"""License notices in texts: MinHash bands over overlapping windows, then exact shingle containment.

Templates and texts are cut into words (runs of a-z and 0-9, with inner dots and hyphens, A-Z
lower-cased) and runs of ``WIDTH`` words. Notices are short, so a shingle here is two words; a template
of one word is that word. Templates are sorted into size classes, the powers of two s (4 at least) that
their shingle counts reach up to. For a class a text is cut into blocks of s shingles, and each two
neighbouring blocks are a window, so that any s shingles in a row lie in one window.

A window that holds 80 % of a template of its class has Jaccard similarity 0.19 with it at least: the
template has more than s / 2 shingles (in the least class fewer, see ``least_similarity``) and the
window 2 s. Bands of one row retrieve it unless all differ; ``bands_for`` sets their number so that this
has probability below ``MISS``. Each band is one hash function: window minima come from block minima.

A retrieved template matches where some s shingles in a row hold 80 % of its distinct shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.llm.common import table
from stagecast.llm.shingle_sets import MULTIPLIER, mixed, word_hashes

#: Fixed values of the query: license and notice.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)
WIDTH, PERCENT, MISS = 2, 80, 1e-6
LEAST_CLASS = 4
#: Shingles that are hashed at once.
AT_ONCE = 1 << 19
WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's word runs in order (of all its words, if they are fewer)."""
    h = word_hashes(WORD.findall((text or "").encode("utf-8").lower()))
    return runs_of(h, width)


def runs_of(h: np.ndarray, width: int) -> np.ndarray:
    n = min(width, len(h))
    total = np.full(max(0, len(h) - n + 1) if n else 0, np.uint64(n))
    with np.errstate(over="ignore"):
        for j in range(n):
            total = mixed(total * MULTIPLIER + h[j:j + len(total)])
    return total


def size_class(n: int) -> int:
    s = LEAST_CLASS
    while s < n:
        s *= 2
    return s


def least_similarity(n: int, percent: int = PERCENT) -> float:
    """Jaccard similarity of a template of n shingles and a window that holds ``percent`` of them, at least."""
    held = ceil(n * percent / 100)
    return held / (2 * size_class(n) + n - held)


def bands_for(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    return ceil(log(miss) / log(1 - least_similarity(n, percent)))


class Templates:
    """Templates by size class, with the band values of each."""

    def __init__(self, templates, percent: int = PERCENT, width: int = WIDTH):
        self.percent, self.width = percent, width
        self.names, self.sets, self.classes = [], [], {}
        for name, text in templates:
            s = np.unique(shingles(text, width))
            if len(s):
                self.classes.setdefault(size_class(len(s)), []).append(len(self.names))
                self.names.append(name)
                self.sets.append(s)
        self.bands = {c: max(bands_for(len(self.sets[t]), percent) for t in ts) for c, ts in self.classes.items()}
        self.salts = mixed(np.arange(1, max(self.bands.values(), default=0) + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            self.least = [(s[None, :] * self.salts[:, None]).min(axis=1) for s in self.sets]

    def retrieved(self, runs: list[np.ndarray]) -> set[tuple[int, int, int]]:
        """``(text, template, window)`` whose band values agree in some band."""
        sizes = np.array([len(r) for r in runs])
        flat = np.concatenate(runs) if len(runs) else np.empty(0, dtype=np.uint64)
        found: set[tuple[int, int, int]] = set()
        if not len(flat):
            return found
        ends = np.cumsum(sizes)
        cuts = {}
        for c in self.classes:
            blocks = -(-sizes // c)
            owner = np.repeat(np.arange(len(runs)), blocks)
            within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            cuts[c] = (owner, within, (ends - sizes)[owner] + within * c, np.append(owner[1:] == owner[:-1], False))
        for band, salt in enumerate(self.salts):
            with np.errstate(over="ignore"):
                h = flat * salt
            for c, members in self.classes.items():
                if band >= self.bands[c]:
                    continue
                owner, within, starts, paired = cuts[c]
                low = np.minimum.reduceat(h, starts)
                both = np.where(paired, np.minimum(low, np.append(low[1:], low[-1:])), low)
                for t in members:
                    for w in np.flatnonzero(both == self.least[t][band]):
                        found.add((int(owner[w]), t, int(within[w])))
        return found

    def places(self, run: np.ndarray, t: int, windows: list[int]) -> list[tuple[int, int]]:
        """Shingle ranges of the matches of a template in the given windows, merged where they overlap."""
        wanted, c = self.sets[t], size_class(len(self.sets[t]))
        out: list[tuple[int, int]] = []
        for w in sorted(windows):
            part = run[w * c:(w + 2) * c]
            hits = np.flatnonzero(np.isin(part, wanted)) + w * c
            for k, at in enumerate(hits):
                near = hits[k:][hits[k:] < at + c]
                if 100 * len(np.unique(run[near])) >= self.percent * len(wanted):
                    if out and at < out[-1][1]:
                        out[-1] = (out[-1][0], max(out[-1][1], int(near[-1]) + 1))
                    else:
                        out.append((int(at), int(near[-1]) + 1))
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """``(license, start, end)`` in code points for each text, by start and license."""
        out, i = [[] for _ in texts], 0
        while i < len(texts):
            runs, first, total = [], i, 0
            while i < len(texts) and (not runs or total < AT_ONCE):
                runs.append(shingles(texts[i], self.width))
                total += len(runs[-1])
                i += 1
            windows: dict[tuple[int, int], list[int]] = {}
            for text, t, w in self.retrieved(runs):
                windows.setdefault((text, t), []).append(w)
            for (text, t), ws in windows.items():
                places = self.places(runs[text], t, ws)
                if places:
                    data = texts[first + text].encode("utf-8")
                    words = [m.span() for m in WORD.finditer(data.lower())]
                    for a, b in places:
                        start, stop = words[a][0], words[min(b + self.width - 2, len(words) - 1)][1]
                        at = len(data[:start].decode("utf-8"))
                        out[first + text].append((self.names[t], at, at + len(data[start:stop].decode("utf-8"))))
        return [sorted(s, key=lambda x: (x[1], x[0])) for s in out]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
                  percent: int = PERCENT) -> DataFrame:
    """``(id, spans)`` for each row: an array of ``struct(license, start, stop)`` in code points.

    ``templates`` are pairs of a license and a notice; a license may have several. Null, empty and
    wordless texts have no spans, templates without words match nothing; repeated rows get the same spans
    each, a null id stays null; other columns are not read. Whole texts are scanned, in one task each.
    """
    kind = "array<struct<license:string,start:int,stop:int>>"
    given = [(str(n), t) for n, t in templates]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(given, percent)
        for batch in batches:
            spans = known.scan([None if t is None else str(t) for t in batch["text"]])
            yield pd.DataFrame({"id": batch["id"], "spans": [
                [{"license": a, "start": b, "stop": c} for a, b, c in s] for s in spans]})
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(scan, f"id string, spans {kind}")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "spans")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every whole text names."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"])))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


OP2_SQL = f"""
WITH t(license, text) AS (VALUES {", ".join(f"('{n}', '{x}')" for n, x in TEMPLATES)}),
tw AS (SELECT license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z0-9]+(?:[.-][a-z0-9]+)*') AS w FROM t),
ts AS (SELECT DISTINCT license, w[i] || ' ' || w[i + 1] AS s FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM tw)),
tn AS (SELECT license, count(*) AS n, greatest({LEAST_CLASS}, 1 << CAST(ceil(log2(count(*))) AS INTEGER)) AS c FROM ts GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z0-9]+(?:[.-][a-z0-9]+)*') AS w FROM documents),
ds AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM dw)),
h AS (SELECT doc_id, license, i, s FROM ds JOIN ts USING (s)),
m AS (SELECT a.doc_id, a.license, a.i, count(DISTINCT b.s) AS k, any_value(n) AS n FROM h a JOIN tn USING (license)
      JOIN h b ON a.doc_id = b.doc_id AND a.license = b.license AND b.i >= a.i AND b.i < a.i + c GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT doc_id, license FROM m WHERE 100 * k >= {PERCENT} * n)
SELECT d.doc_id, count(license) AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""
