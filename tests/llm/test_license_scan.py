import random
import re

from stagecast.llm import license_scan as ls

LONG = ("long", " ".join(f"clause{i} grants right{i % 17} to party{i % 5}" for i in range(40)))
TEMPLATES = (*ls.TEMPLATES, LONG, ("one", "Unlicense"))


def words(text):
    return re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", "".join(c.lower() if c.isascii() else c for c in text or ""))


def runs(text):
    w = words(text)
    return [tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))] if w else []


def brute(text):
    out, r = set(), runs(text)
    for name, t in TEMPLATES:
        want = set(runs(t))
        c = ls.size_class(len(want))
        if any(100 * len(want & set(r[i:i + c])) >= 80 * len(want) for i in range(len(r))):
            out.add(name)
    return out


def texts(n=250, seed=4):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rng.choice(["the", "license", "under", "work", "is", "mit", "word", "été", "rights", "x%%%"]) for _ in range(rng.choice([0, 3, 60, 700]))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(TEMPLATES)[1].split()
            if rng.random() < 0.4:
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.1 else x for x in t]
        out.append(rng.choice([" ", "\n", " - "]).join(w))
    return out


def test_finds_what_a_plain_search_finds():
    known, all_texts = ls.Templates(TEMPLATES), texts()
    got = known.scan(all_texts)
    for text, spans in zip(all_texts, got):
        assert {s[0] for s in spans} == brute(text)
    assert sum(map(len, got)) > 150


def test_spans_are_the_notices():
    known = ls.Templates(ls.TEMPLATES)
    text = "été. Released under the MIT License.\nfoo foo foo foo foo foo foo ALL RIGHTS RESERVED. x"
    assert [(n, text[a:b]) for n, a, b in known.scan([text])[0]] == [
        ("mit", "Released under the MIT License"), ("all-rights-reserved", "ALL RIGHTS RESERVED")]


def test_band_settings():
    for n in range(1, 400):
        assert (1 - ls.least_similarity(n)) ** ls.bands_for(n) <= ls.MISS


def test_rows_and_edges(spark):
    notice = ls.TEMPLATES[1][1]
    rows = [(1, notice, "x"), (1, notice, "x"), (None, notice, "x"), (2, None, "x"), (3, "", "x"), (4, "%%%", "x"),
            (5, "word " * 300_000 + notice, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"], [s["license"] for s in r["spans"]]) for r in ls.scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, ["mit"]), (1, ["mit"]), (None, ["mit"]), (2, []), (3, []), (4, []), (5, ["mit"])], key=str)
    assert ls.scan_licenses(df.limit(0)).count() == 0
    assert ls.scan_licenses(df, templates=[("none", " ")]).where("size(spans) > 0").count() == 0
