import math
from collections import defaultdict

import pytest

from stagecast.llm.mixing import mix, op6_mixing, source_targets


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by repeated resharing."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_w = sum(w[s] for s in sizes if s not in full)
        got = {s: most * sizes[s] if s in full else rest * w[s] / open_w for s in sizes}
        above = {s for s in got if got[s] > most * sizes[s] + 1e-9}
        if not above:
            return got
        full |= above


def check(rows):
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
    for s, t in water(dict(sizes)).items():
        assert math.isclose(target[s], t, rel_tol=1e-9, abs_tol=1e-6)
        assert abs(taken[s] - t) <= largest[s] + 1e-5 * t + 1


def test_documents_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows)
    again = {r["doc_id"]: r["taken"] for r in mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_hot_source_copies_nulls_and_blanks(spark):
    rows = [(i, "w " * (1 + i % 7), "hot", 1) for i in range(3000)]
    rows += [(4000 + i, "same text here", "hot", 1) for i in range(3000)]
    rows += [(9000, None, None, 1), (9001, "a b c", None, 1), (9002, " \t", "empty", 1), (None, "x y", "z", 1),
             (None, "x y", "z", 1), (9003, "q " * 5000, "é", 1), (9004, "one", "é", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = mix(df).collect()
    assert len(got) == len(rows)
    check(got)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix(df).collect()] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, "d": 0}, {"a": 7},
                                   {"a": 1, "b": 2, "c": 3, "d": 400, "e": 5, "f": 600, "g": 7}])
def test_targets_match_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([("a" + s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
    got = {r["source"][1:]: r["target"] for r in source_targets(df).collect()}
    want = water(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_query_columns(spark):
    got = dict(op6_mixing(spark, "/root/testdata/sf0.001").dtypes)
    assert {k: got[k] for k in ("doc_id", "size", "source_size", "target", "taken")} == {
        "doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}


def test_unmet_targets_raise(spark, monkeypatch):
    from stagecast.llm import mixing
    monkeypatch.setattr(mixing, "ENOUGH", -1.0)
    monkeypatch.setattr(mixing, "MAX_STEPS", mixing.STEPS)
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="targets not met"):
        mixing.mix(df).count()
