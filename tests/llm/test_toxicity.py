import random
import zlib

import numpy as np

from stagecast.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def corpus(n, seed=0):
    """Texts of random words; label 1 has a few words of a small list, misspelt outside the first half."""
    rng = random.Random(seed)
    parts = ["ka", "lo", "mi", "ter", "san", "vu", "rel", "po", "ni", "das"]
    bad, misspelt = ["grumblor", "snarfik"], ["grumbblor", "snarrfik"]
    out = []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        label = int(rng.random() < 0.3)
        for _ in range(label * max(2, len(words) // 25)):
            words[rng.randrange(len(words))] = rng.choice(bad if i < n // 2 else misspelt)
        out.append((i, " ".join(words), label))
    return out


def test_unseen_misspellings_are_found():
    rows = corpus(500)
    values, bias = tx.train([t for _, t, _ in rows[:250]], [y for *_, y in rows[:250]], 0.3)
    scorer = tx.Scorer(values, bias)
    right = [(scorer.score(t) >= 0.5) == bool(y) for _, t, y in rows[250:]]
    assert np.mean(right) > 0.9


def test_training_is_repeatable_and_needs_two_classes():
    rows = corpus(80)
    a, b = (tx.train([t for _, t, _ in rows], [y for *_, y in rows], 0.3) for _ in range(2))
    assert (a[0] == b[0]).all() and a[1] == b[1]
    values, bias = tx.train(["x", "y"], [1, 1], 0.9)
    assert not values.any() and tx.Scorer(values, bias).score("x") > 0.8


def test_held_out_rows_are_scored_well_and_never_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.op3_toxicity(spark, SF).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(right) > 0.93
    sample, share = tx.training_rows(docs, labels, "doc_id", "text", "toxic", 10_000)
    learnt = {r["id"] for r in sample.select("id").collect()}
    assert learnt and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in learnt)
    kept = {i: y for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5}
    assert abs(share - np.mean(list(kept.values()))) < 1e-9


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(i, t, "x", 0.5) for i, t, _ in corpus(60)]
    more = [(None, "ka lo", "x", 0.5), (100, None, "x", 0.5), (101, "", "x", 0.5), (102, "ka " * 200_000, "x", 0.5), rows[3]]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(60)] + [(None, 1), (5, None), (7, 3)], "doc_id long, toxic int")
    got = tx.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert got.count() == len(rows) + 5 and scores[100] == scores[101]
    kept = tx.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {100, 101} <= {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert tx.toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in tx.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_text_behind_character_64_of_an_unbroken_run_counts():
    head, rng = "\u4e2d" * 64, random.Random(4)
    tail = lambda bad: "".join(rng.choices("kalomitersanvu", k=80)) + ("grumblor" * 4 if bad else "")
    rows = [(head + tail(i % 2), i % 2) for i in range(200)]
    values, bias = tx.train([t for t, _ in rows[:150]], [y for _, y in rows[:150]], 0.5)
    scorer = tx.Scorer(values, bias)
    assert all((scorer.score(t) >= 0.5) == bool(y) for t, y in rows[150:])
    assert scorer.score(head + "lomi") != scorer.score(head + "grumblor")
    assert np.isclose(scorer.word(head + "grumblor"), values[tx.features(head + "grumblor")].astype(float).mean())
    long = "x" * 200_000
    assert np.isclose(scorer.word(long + "grumblor"), values[tx.features(long + "grumblor")].astype(float).mean())


def test_scores_equal_a_plain_scorer():
    """The mean over words of the mean over features, word by word, for short, long and repeated words."""
    rng = np.random.default_rng(4)
    values = rng.normal(size=tx.BUCKETS).astype(np.float32)
    scorer = tx.Scorer(values, 0.3)
    for text in ["", "one", "one two two", "a_b ÉCOLE x" * 3, "w" * 63, "w" * 64, "w" * 65, "abc" * 60 + " one", "漢字" * 500 + " z"]:
        total = weight = 0.0
        for w in tx.WORD.findall(text.lower()):
            marked = f"<{w}>"
            grams = [marked] + [marked[i:i + n] for n in tx.NGRAMS for i in range(len(marked) - n + 1)]
            share = max(1.0, len(w) / 64)
            total += share * np.mean([float(values[zlib.crc32(g.encode()) % tx.BUCKETS]) for g in grams])
            weight += share
        want = 1 / (1 + np.exp(-(0.3 + (total / weight if weight else 0.0))))
        assert abs(scorer.score(text) - want) < 1e-5, text[:20]


def test_long_words_gain_weight_without_a_step():
    weights = [tx.times("w" * n) for n in range(1, 300)]
    assert weights[:64] == [1.0] * 64 and max(np.diff(weights)) <= 1 / 64 + 1e-12


def test_no_text_is_left_out_for_its_length(spark):
    docs = spark.createDataFrame([(i, "word " * (20_000 if i == 7 else 5)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    whole, _ = tx.training_rows(docs, labels, "doc_id", "text", "toxic", 1000)
    held = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r["id"] for r in whole.collect()} == set(range(40)) - held
    few, _ = tx.training_rows(docs, labels, "doc_id", "text", "toxic", 1000, chars_per_class=100)
    chars = {y: [len(r["text"]) for r in few.where(f"label = {y}").collect()] for y in (0, 1)}
    assert all(c and (sum(c) - max(c) < 100 or sum(c) <= 125) for c in chars.values())
