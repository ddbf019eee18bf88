"""The pipeline against plain Python on small tables, stage by stage and as a whole."""
import re
from collections import defaultdict

import corpus_pipeline as cp
from pyspark.sql import functions as F
from stagecast.llm.secret_scan import MASK, redacted
from stagecast.llm.mixing import mixed_documents
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import water
from tests.llm.test_near_duplicates import brute as groups

SF = "/root/testdata/sf0.01"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def masked_text(text, live):
    assign = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    spots = [m.span(1) for m in assign.finditer(text) if len(m[1]) >= 6 and m[1] in live]
    spots += [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", text) if m[0] in live]
    out, at = "", 0
    for a, b in sorted(spots):
        if a >= at:
            out += text[at:a] + MASK
        at = max(at, b)
    return out + text[at:]


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_run_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = cp.stash(cp.toxicity(spark, docs, SF), "test")
    kept = texts(clean)
    assert 0.8 * len(source) < len(kept) < len(source)
    kept = {i: kept[i] for i, (_, _, first) in groups(kept, 5).items() if first}
    assert texts(cp.near_dedup(spark, clean, SF)) == kept
    bad = {d for d, *_ in leaks(list(kept.items()), bench)}
    kept = {i: t for i, t in kept.items() if i not in bad}
    assert bad
    rows = cp.run(spark, SF).collect()
    owners = defaultdict(set)
    for i, t in kept.items():
        for m in re.finditer(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
            owners[m[1]].add(source[i])
        for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t):
            owners[m[0]].add(source[i])
    live = {v for v, s in owners.items() if len(s) <= 2}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t in kept.items():
        n = len(masked_text(t, live).encode().split())
        sizes[source[i]] += n
        largest[source[i]] = max(largest[source[i]], n)
    for r in rows:
        assert r["text"] == masked_text(kept[r["doc_id"]], live)
        assert 1 <= r["mix_copies"] <= 2 and r["n_chars"] == len(r["text"])
        taken[r["source"]] += r["mix_taken"]
    for s, t in water(dict(sizes)).items():
        assert abs(taken[s] - t) <= largest[s] + 1e-5 * t + 1


def test_redaction_keeps_rows_columns_and_copied_values(spark):
    live, copied = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "Ex4mpleEx4mpleEx4mple"
    rows = [(1, f"é token = \"{live}\" x {live}", "s1", "en", 1, "k"), (1, f"é token = \"{live}\" x {live}", "s1", "en", 1, "k"),
            (2, f"token={copied}", "s1", "en", 2, "k"), (3, f"token={copied}", "s2", "en", 3, "k"), (4, f"token={copied}", "s3", "en", 4, "k"),
            (5, None, None, None, None, "k"), (None, "", "s", "en", 0, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int, key string")
    got = redacted(df)
    assert got.columns == df.columns and dict(got.dtypes) == dict(df.dtypes)
    new = f"é token = \"{MASK}\" x {MASK}"
    want = [(1, new, "s1", "en", len(new), "k")] * 2 + rows[2:]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert redacted(df.limit(0)).count() == 0


def test_mix_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c", "s", 5, "x")] * 6 + [(2, "d e", None, 5, "x"), (None, None, "s", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies int, key string")
    got = mixed_documents(df)
    assert got.columns == ["doc_id", "text", "source", "key", "mix_target", "mix_copies", "mix_taken"]
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert 6 <= by_id[1]["mix_copies"] <= 12 and by_id[1]["mix_taken"] == 3 * by_id[1]["mix_copies"]
    assert mixed_documents(df.limit(0)).count() == 0


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
