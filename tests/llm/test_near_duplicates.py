import random

import numpy as np
import pytest

from stagecast.llm import near_duplicates as nd
from stagecast.llm.shingle_sets import shingle_set

VOCAB = [f"w{i}" for i in range(2000)]


def brute(docs, width, percent=80):
    """Components over all pairs; ``docs`` maps an id to its text."""
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
    return {i: (len(sets[i]), root(i), root(i) == i) for i in docs}


def run(spark, docs, width):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df, width=width).collect()}


def variants(rng, base, n, most):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        yield w


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, width):
    rng, docs = random.Random(width), {}
    for size in (1, 2, 3, 6, 12, 40, 90, 150, 350, 900):
        for _ in range(5):
            base = rng.choices(VOCAB, k=size)
            for w in variants(rng, base, rng.randint(1, 5), max(1, size // 12)):
                docs[len(docs)] = " ".join(w) if rng.random() < 0.8 else "\t".join(w).upper()
    docs |= {5000: None, 5001: "", 5002: " \n\t"}
    order = list(docs.items())
    rng.shuffle(order)
    assert run(spark, dict(order), width) == brute(docs, width)


def test_large_group_of_chained_copies(spark):
    """Many copies of one text, some so changed that only a few others link to them."""
    rng = random.Random(9)
    base = rng.choices(VOCAB, k=150)
    docs = {i: " ".join(w) for i, w in enumerate(variants(rng, base, 400, 22))}
    docs |= {1000 + i: " ".join(rng.choices(VOCAB, k=120)) for i in range(50)}
    docs |= {2000 + i: " ".join(base) for i in range(0, 300)}
    docs |= {2500 + i: " ".join(base[:50 + i // 2]) for i in range(200)}
    got, want = run(spark, docs, 2), brute(docs, 2)
    assert got == want
    assert len({c for _, c, _ in want.values()}) < len(docs) - 400


def test_estimates_are_corrected_and_centred():
    rng = np.random.default_rng(0)
    for n, j in ((20, 0.8), (300, 0.5), (5000, 0.8), (3000, 0.0)):
        common, errors = int(round(2 * n * j / (1 + j))), []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - common:])
            seeds = nd.seeds_for(n)
            x, y = nd.registers(a, seeds)[None], nd.registers(b, seeds)[None]
            errors.append(nd.estimated(x, y, np.array([n * seeds]), np.array([n * seeds]))[0] - j)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < nd.MARGIN


def test_partners_share_a_number_of_seeds():
    for n in range(1, 700):
        for m in range(-(-n * 80 // 100), n + 1):
            mine = {nd.seeds_for(n), nd.seeds_for(-(-n * 80 // 100))}
            theirs = {nd.seeds_for(m), nd.seeds_for(-(-m * 80 // 100))}
            assert mine & theirs


def test_sets_follow_the_word_rule():
    assert len(shingle_set("A b  c\x0bD", 2)) == 2        # a no-break space is no separator
    assert shingle_set("One two", 5).tolist() == shingle_set("one\ntwo", 5).tolist()
    assert len(shingle_set(None, 2)) == len(shingle_set(" ", 2)) == 0
    assert len(shingle_set("x " * 50000, 2)) == 1


def test_filter_keeps_one_row_of_each_group(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(3, text, "x", 1), (1, text + " b", "x", 1), (2, text.upper(), "x", 1), (7, "other words here", "x", 1),
            (7, "other words here", "x", 1), (8, None, "x", 1), (9, "", "x", 1), (None, text, "x", 1), (None, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, id int")
    got = nd.deduplicated(df)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 7, 8, 9] and ids.count(None) == 2


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(empty).count() == 0 and nd.deduplicated(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c")], "doc_id long, text string")
    got = sorted((tuple(r) for r in nd.near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, False)], key=str)


def test_only_the_linked_text_of_a_repeated_id_goes(spark):
    def words(w):
        return " ".join(f"{w}{i}" for i in range(60))
    rows, want = [], []
    for i in range(0, 40, 10):
        a, b, c, d = (words(f"{x}{i}w") for x in "abcd")
        rows += [(i + 1, a), (i + 5, a + " b"), (i + 5, b), (i + 5, c), (i + 5, c), (i + 7, d), (i + 7, d + " z"), (i + 8, d)]
        want += [(i + 1, a), (i + 5, b), (i + 5, c), (i + 7, d)]
    df = spark.createDataFrame(rows + [(90, None), (90, ""), (None, words("a0w"))], "doc_id long, text string")
    got = sorted(map(tuple, nd.deduplicated(df).collect()), key=str)
    assert got == sorted(want + [(90, None), (90, ""), (None, words("a0w"))], key=str)


def shingled(spark, rows):
    """``_shingles`` of ``rows``: (id, component, numbers of the shingles)."""
    sets = [(i, len(set(s)), c, np.unique(nd.mixed(np.array(sorted(set(s)), dtype=np.uint64))).tobytes()) for i, c, s in rows]
    return nd._shingles(spark.createDataFrame(sets, "id long, n long, component long, set binary"))


def test_documents_with_a_common_shingle_alone_do_not_meet(spark):
    """Chained groups compared each of these documents with all the others."""
    rows = [(i, i, [0, 1, 2] + [1000 + 20 * i + k for k in range(17)]) for i in range(300)]
    rows += [(1000 + i, 1000 + i, [0, 1, 2] + [90_000 + 100 * (i // 2) + k for k in range(17)]) for i in range(20)]
    kept = nd.prefixes(shingled(spark, rows), 80)
    pairs = nd.prefix_pairs(kept, 80).select("a", "b").collect()
    assert sorted(map(tuple, pairs)) == [(1000 + i, 1001 + i) for i in range(0, 20, 2)]
    assert {r["id"] for r in kept.collect()} == set(range(1000, 1020))      # the others need no row at all


@pytest.mark.parametrize("percent", [70, 80, 93])
def test_prefix_pairs_hold_every_link(spark, percent):
    rng, rows = random.Random(percent), []
    for f in range(12):
        base = rng.sample(range(1000), rng.choice((1, 4, 5, 9, 20, 45, 120)))
        for _ in range(12):
            s = set(base)
            for x in rng.sample(base, rng.randint(0, len(base) // 5)):
                s.discard(x)
            s |= set(rng.choices(range(1000), k=rng.randint(0, max(1, len(base) // 8))))
            rows.append((len(rows), rng.choice((len(rows), 3 * f)), sorted(s or {0})))
    want = {(i, j) for i, c, s in rows for j, e, t in rows if i < j and c != e
            and 100 * len(set(s) & set(t)) >= percent * len(set(s) | set(t))}
    got = {tuple(r) for r in nd.prefix_pairs(nd.prefixes(shingled(spark, rows), percent), percent).select("a", "b").collect()}
    assert want and want <= got
    inside = {i: c for i, c, _ in rows}
    assert all(inside[i] != inside[j] for i, j in got)


def test_a_family_meets_once_not_for_each_common_shingle(spark, monkeypatch):
    """Each pair came once for each rare shingle that it shares: here some 20 times."""
    rng, rows = random.Random(4), []
    base = list(range(100))
    for i in range(60):
        kept = sorted(rng.sample(base, 100 - rng.choice((4, 8, 12))))
        rows.append((i, i // 2, kept + [1000 + 100 * i + k for k in range(100 - len(kept))]))
    docs = shingled(spark, rows)
    want = {(i, j) for i, c, s in rows for j, e, t in rows if i < j and c != e and 100 * len(set(s) & set(t)) >= 80 * len(set(s) | set(t))}
    for limit in (1000, 7):                                    # in one block, and in many
        monkeypatch.setattr(nd, "BLOCK_DOCS", limit)
        kept = nd.prefixes(docs, 80).cache()
        dealt, mains = nd._dealt(kept).toArrow().to_pandas(), kept.select("main").distinct().count()
        places = sum(kept.select("keys").toPandas()["keys"].map(len))
        assert kept.count() < places / 2
        blocks = dealt.groupby(["shard", "row", "col"])
        assert limit == 1000 or len(blocks) > 3 * mains
        met = [nd.block_pairs(b, 80) for _, b in blocks]
        got = {tuple(r) for r in nd.prefix_pairs(kept, 80).select("a", "b").collect()}
        assert want and want <= got
        assert sum(map(len, met)) <= mains * len(got)


def test_links_are_confirmed_without_sending_sets_to_python(spark):
    """Pairs of sets filled the workers' memory, 10,000 pairs at once whatever the length of the texts."""
    rows = [(list(range(10)), list(range(1, 10)), True), (list(range(9)), list(range(2, 11)), False), ([1], [1], True),
            (list(range(4)), list(range(5)), True), ([-1, 5], [5], False), (list(range(8)), list(range(1, 10)), False)]
    some = spark.createDataFrame(rows, "sa array<long>, sb array<long>, want boolean")
    judged = some.withColumn("got", nd._linked(80))
    assert all(r["got"] == r["want"] for r in judged.collect())
    assert "Python" not in judged._jdf.queryExecution().toString()
