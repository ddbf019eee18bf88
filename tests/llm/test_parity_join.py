import random

import numpy as np
import pytest

from stagecast.llm import parity_join as pj
from stagecast.llm.shingle_sets import shingle_set

VOCAB = [f"w{i}" for i in range(3000)]


def brute(docs, width=3, percent=90):
    """Size and component of each id over all pairs."""
    sets = {}
    for i, t in docs.items():
        w = tuple((t or "").encode().lower().split())
        sets[i] = {w[k:k + width] for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(i for i in docs if sets[i])
    for p, a in enumerate(ids):
        for b in ids[p + 1:]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in docs}


def run(spark, docs, **more):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = pj.jaccard_join(df, **more).collect()
    assert len(got) == len(docs)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def variants(rng, base, n, most):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        yield w


@pytest.mark.parametrize("percent", [90, 70])
def test_components_match_brute_force(spark, percent):
    rng, docs = random.Random(percent), {}
    for size in (1, 2, 3, 5, 11, 12, 14, 20, 40, 90, 150, 400, 900):
        for _ in range(5):
            base = rng.choices(VOCAB, k=size)
            for w in variants(rng, base, rng.randint(1, 5), max(1, size // 30)):
                cut = rng.randrange(max(1, len(w) // 9)) if rng.random() < 0.4 else 0
                docs[len(docs)] = " ".join(w[cut:]) if rng.random() < 0.8 else "\t".join(w[cut:]).upper()
    docs |= {5000: None, 5001: "", 5002: " \n\t"}
    order = list(docs.items())
    rng.shuffle(order)
    assert run(spark, dict(order), percent=percent) == brute(docs, percent=percent)


def test_large_group_with_many_unlinked_members(spark):
    rng = random.Random(9)
    base = rng.choices(VOCAB, k=80)
    docs = {i: " ".join(w) for i, w in enumerate(variants(rng, base, 500, 4))}
    docs |= {1000 + i: " ".join(rng.choices(VOCAB, k=120)) for i in range(40)}
    docs |= {2000 + i: " ".join(base) for i in range(200)}
    docs |= {2500 + i: " ".join(base[:40 + i // 2]) for i in range(100)}
    got, want = run(spark, docs), brute(docs)
    assert got == want
    assert 50 < len({c for _, c in want.values()}) < len(docs) - 300


def test_linked_sets_share_a_word_of_a_common_sketch():
    """The pigeonhole bound, for every size: no partner at the threshold is without a common key."""
    rng = np.random.default_rng(1)
    for percent in (90, 60):
        starts = pj.band_starts(percent)
        for n in [*range(1, 260), 1000, 4001]:
            for m in sorted({n, n + 1, n * 100 // percent}):
                common = -(-percent * (n + m) // (100 + percent))
                if common > n:
                    continue
                pool = rng.integers(0, 1 << 63, n + m - common).astype(np.uint64)
                a, b = pool[:n], np.concatenate([pool[:common], pool[n:]])
                assert 100 * common >= percent * (n + m - common)
                if common == n == m:
                    continue
                bands = set(pj.bands_of(n, starts, percent)) & set(pj.bands_of(m, starts, percent))
                assert bands
                for band in bands:
                    size = pj.most_apart(2 * (starts[band + 1] - 1), percent) + 1
                    x, y = pj.parity_words(a, size), pj.parity_words(b, size)
                    assert np.bitwise_count(x ^ y).sum() <= n + m - 2 * common and (x == y).any()


def test_bands_are_at_most_two():
    for percent in (50, 80, 90, 95):
        starts = pj.band_starts(percent)
        for n in range(1, 5000):
            bands = pj.bands_of(n, starts, percent)
            assert len(bands) <= 2 and all(b in pj.bands_of(m, starts, percent) for m in (n * 100 // percent,) if m >= starts[0] for b in bands[-1:])


def test_repeated_rows_nulls_and_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(3, text, 1, "k"), (1, text + " b", 1, "k"), (2, text.upper(), 1, "k"), (2, text.upper(), 1, "k"), (7, "x y", 1, "k"),
            (9, "X\tY", 1, "k"), (8, None, 1, "k"), (6, "", 1, "k"), (None, text, 1, "k"), (None, None, 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, key string")
    got = sorted((tuple(r) for r in pj.jaccard_join(df).collect()), key=str)
    assert got == sorted([(3, 58, 1), (1, 59, 1), (2, 58, 1), (2, 58, 1), (7, 1, 7), (9, 1, 7), (8, 0, 8), (6, 0, 6),
                          (None, 58, None), (None, 0, None)], key=str)


def test_empty_table_and_long_text(spark):
    assert pj.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = [f"v{i}" for i in range(60_000)]
    docs = {1: " ".join(long), 2: " ".join(long[2000:]), 3: " ".join(long[9000:]), 4: " ".join(long[::-1])}
    assert run(spark, docs) == {1: (59998, 1), 2: (57998, 1), 3: (50998, 3), 4: (59998, 4)}
    assert len(shingle_set(docs[1], 3)) == 59998


def test_large_ids_beside_null_ids(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "a b c d"), (None, "a b c d"), (big + 2, "a b c d"), (big + 4, "x")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in pj.jaccard_join(df).collect()} == {big: big, None: None, big + 2: big, big + 4: big + 4}


def test_chains_of_buckets_are_not_compared_as_one_group(spark, monkeypatch):
    """Each text shares words of its sketch with the next few only: what is compared grows with their number."""
    from pyspark.sql import functions as F
    largest = []
    dealt = pj._dealt

    def seen(members, payload):
        largest.append(members.groupBy("g").count().agg(F.max("count")).first()[0])
        return dealt(members, payload)
    monkeypatch.setattr(pj, "_dealt", seen)
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 9)}" for _ in range(4300)]
    texts = [" ".join(words[i * 25: i * 25 + 200]) for i in range(160)]
    texts += [t + " more" for t in texts[::10]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in pj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i - 160) * 10 if i >= 160 else i for i in range(len(rows))}
    assert largest and largest[0] < 60


def test_equal_words_of_unlike_shingles_are_not_one_key():
    """Words of unrelated sets are often equal in a large table; their tags tell them apart, but never like ones."""
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 3).astype(np.uint64)]) for _ in range(2))
    x, y = (np.frombuffer(pj.word_tags(s, 20), dtype="<u2") for s in (a, b))
    touched = {int(p) // 64 for p in np.concatenate([a[40:], b[40:]]) % np.uint64(64 * 20)}
    assert all((x[w] == y[w]) == (w not in touched) for w in range(20))
    # two shingles on one bit leave the word as it is without them
    twice = np.array([5, 5 + 64 * 20], dtype=np.uint64)
    assert (pj.parity_words(twice, 20) == 0).all() and pj.word_tags(twice, 20) != pj.word_tags(twice[:0], 20)
