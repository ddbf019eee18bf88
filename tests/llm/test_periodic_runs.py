import hashlib
import random
import time
import zlib

import numpy as np

from stagecast.llm import periodic_runs as pr


def brute(w, shortest=12):
    """Every maximal repetition by comparing all places at all lags; the smallest period names it."""
    n, spans = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                spans.setdefault((i, j + q - i), q)
            i = j + 1 if j == i else j
    return sorted(((a, size, p) for (a, size), p in spans.items()
                   if not any(b <= a and a + size <= b + m and r < p and p % r == 0 for (b, m), r in spans.items())),
                  key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rng = random.Random(5)
    for turn in range(400):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 8, 60])) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words) + 1), rng.randint(1, 60)
            base = [b"%d" % rng.randrange(40) for _ in range(p)]
            words[at:at] = (base * 5)[:rng.randint(p, 4 * p)]
        assert pr.word_runs(words) == brute(words), words


def test_fibonacci_words_and_nested_periods():
    a, b = [b"x"], [b"x", b"y"]
    while len(b) < 700:
        a, b = b, b + a
    assert pr.word_runs(b) == brute(b)
    inner = ([b"a", b"b"] * 10 + [b"c"] + [b"k%d" % i for i in range(45)]) * 4
    assert pr.word_runs(inner) == brute(inner) and any(p == 66 for _, _, p in pr.word_runs(inner))


def test_segments_hold_words_twice():
    rng = random.Random(2)
    for _ in range(100):
        ids = np.array([rng.randrange(30) for _ in range(rng.randrange(1, 120))])
        for a, b in pr.surviving_segments(ids):
            assert b - a >= 12 and np.unique(ids[a:b], return_counts=True)[1].min() >= 2


def test_long_texts_take_no_square():
    rng = random.Random(3)
    vocabulary = [b"w%d" % i for i in range(300)]
    text = [rng.choice(vocabulary) for _ in range(200_000)]
    text[50_000:110_000] = text[50_000:70_000] * 3
    peel = [b"p%d" % (i // 2) for i in range(40_001)]     # words that become single one after the other
    began = time.time()
    found = pr.word_runs(text)
    assert any(p == 20_000 and n >= 60_000 for _, n, p in found)
    assert pr.word_runs([b"same"] * 100_000) == [(0, 100_000, 1)]
    assert pr.word_runs(peel) == []
    assert time.time() - began < 120


def test_collapsed_text():
    w = [b"a"] * 12 + [b"b"]
    assert pr.collapsed(w, pr.word_runs(w)) == b"a b"
    w = [b"x"] + [b"p", b"q", b"r"] * 4 + [b"z"]
    assert pr.collapsed(w, pr.word_runs(w)) == b"x p q r z"


def planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    keep = [x for i, x in enumerate(w) if not any(a + p <= i < a + m for a, m, p in runs)]
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, "a " * 20, "x"), (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "é é " * 15, "x"), (4, "A a " * 15, "x"),
            (5, "one two three", "x"), (6, "A b\x0bA\tb " * 6, "x")]
    rows += [(i, " ".join(str(rng.randrange(rng.choice([3, 500]))) for _ in range(rng.randrange(0, 140))), "x") for i in range(10, 160)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pr.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(i, t) for i, t, _ in rows), key=str)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, id int, runs int, collapsed string")
    assert pr.periodic_runs(df).count() == 0
    df = spark.createDataFrame([(7, "a " * 14, 3, 4, "x")], df.schema)
    assert pr.periodic_runs(df).collect()[0].asDict(True) == {
        "id": 7, "n_words": 14, "runs": [{"start": 0, "length": 14, "period": 1}], "collapsed": "a"}


def test_large_ids_beside_null_ids(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "a " * 12), (None, "b"), (-big, None)], "doc_id long, text string").coalesce(1)
    assert {r["id"]: r["n_words"] for r in pr.periodic_runs(df).collect()} == {big: 12, None: 1, -big: 0}
