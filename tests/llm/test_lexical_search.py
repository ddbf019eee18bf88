import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from stagecast.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if t in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, n int"),
            spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int"))


def sample(seed, n_docs, n_items):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[i % 40][1]) for i in range(60)]                     # ties
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 30, 150])))) for i in range(n_items)]
    rng.shuffle(docs)
    return docs, items


EDGES = [(9001, None), (9002, ""), (9003, " .,;!\n"), (9004, "ÉCOLE école x_y-Z9 naïve"), (9005, "É É É"), (None, "w1 w2 w3 w4"),
         (9007, "same words here"), (9007, "same words here"), (9008, "same WORDS here")]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_DOCS", 64)
    docs, items = sample(1, 700, 25)
    docs += EDGES
    items += [(100, None), (101, ""), (102, "ÉCOLE x y z9"), (103, "same same words"), (103, "same same words"), (None, "w1 w2"),
              (104, "nowhere"), (103, "other text w3")]
    got = ls.ranked_search(*tables(spark, docs, items), chunk_terms=300)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_oracle_matches_brute_force():
    docs, items = sample(2, 300, 12)
    docs += EDGES
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert sorted(con.sql(ls.OP11_SQL).fetchall(), key=str) == brute(docs, items)


def test_low_masks_are_not_scored():
    """Of documents with one common word, few are scored once k others match the whole item."""
    rng = random.Random(3)
    docs = [(i, ["common"] + [f"x{rng.randrange(9999)}" for _ in range(30)]) for i in range(3000)]
    docs += [(5000 + i, ["common", "rare", "words", f"y{i}"]) for i in range(12)]
    names = {t: j for j, t in enumerate(sorted({t for _, w in docs for t in w}))}
    rows = [(i, len(w), *np.unique([names[t] for t in w], return_counts=True)) for i, w in docs]
    asked = np.array([names[t] for t in ("common", "rare", "words")])
    vocabulary = np.sort(asked)
    block = ls.Block(pd.DataFrame(rows, columns=["id", "n", "terms", "counts"]), vocabulary, len(docs), sum(len(w) for _, w in docs))
    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    best, scored = ls.visit(block, np.searchsorted(vocabulary, asked), np.array([1, 5000, 5000]), none, 10, np.zeros(3, dtype=np.int64))
    assert best[0].tolist() == list(range(5000, 5010)) and scored < 50
    again, more = ls.visit(block, np.array([0]), np.array([1]), best, 10, np.zeros(3, dtype=np.int64))
    assert again == best and more == 0


def test_empty_tables_and_long_text(spark):
    docs, items = tables(spark, [], [(1, "a b")])
    assert ls.ranked_search(docs, items).count() == 0
    docs, items = tables(spark, [(1, "a b")], [])
    assert ls.ranked_search(docs, items).count() == 0
    rows = [(1, "a " * 200_000 + "end"), (2, "a end"), (3, "b " * 9)]
    docs, items = tables(spark, rows, [(1, "END a")])
    assert sorted(map(tuple, ls.ranked_search(docs, items).collect()), key=str) == brute(rows, [(1, "END a")])


def test_large_ids_beside_null_ids(spark):
    big = (1 << 62) + 1
    docs, items = tables(spark, [(big, "a b"), (None, "a"), (big + 2, "a c")], [(big, "a"), (None, "c")])
    got = ls.ranked_search(docs.coalesce(1), items.coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == brute([(big, "a b"), (None, "a"), (big + 2, "a c")], [(big, "a"), (None, "c")])
