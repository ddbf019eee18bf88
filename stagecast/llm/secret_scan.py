"""Secret scan: spans of credential-like strings, told apart by who else has them in the corpus.

Three base kinds are found by pattern in every whole text: assignments, access keys and long
hexadecimal runs. The method adds a fourth, ``owned``: a mixed-case string with digits that overlaps no
base span and that at most ``max_owners`` owners and ``max_repos`` repositories have in the whole corpus.
Strings with more owners, or in more repositories of their owners, are widely copied examples. For that the hash of every candidate value is aggregated over the corpus to its
distinct owners and repositories, which are made distinct before they are counted, so that a value in a
third of all documents costs one row for each of its owners and task. The same counts mark base spans
as owner-specific (live-looking) or widely copied; base spans always stay.

Positions are code points, ends exclusive. They come from lengths: the pieces between the matches of a
pattern and the matches themselves alternate, so a match starts where the lengths before it end.
All of it is DataFrame code; patterns are explicit about case, so that only ASCII letters fold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.llm.common import let, maybe_in, packed, row_key, stash, table

#: The kinds in their order of listing.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = ("(password|passwd|secret|token|api_?key)", "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS = 6, 20
OWNED = "[A-Za-z0-9+/_-]{16,}"
MAX_OWNERS, MAX_REPOS = 2, 3
MASK = "[secret]"


def _any_case(pattern: str) -> str:
    """Each letter of a pattern as a class of its two cases (ASCII only)."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


ASSIGN_PATTERN = _any_case(ASSIGN[0]) + ASSIGN[1]


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each one, by blocks of 64 so that long arrays stay cheap."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def with_blocks(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(n) - 1).bitwiseAND(-64), F.lit(64)),
                             lambda b: total(F.slice(n, b + 1, 64)))
        return let(blocks, lambda sums: F.transform(n, lambda _, i: total(
            F.slice(sums, 1, F.shiftright(i, 6))) + total(F.slice(n, i.bitwiseAND(-64) + 1, i.bitwiseAND(63)))))
    return let(lengths, with_blocks)


def spans(text: Column, pattern: str, kind: int, value, keep) -> Column:
    """Array of ``struct(start, kind, stop, value)`` of the pattern's leftmost non-overlapping matches.

    ``value`` maps a match to what it is known by, ``keep`` says which matches count.
    """
    none = F.lit(None).cast("array<struct<start:int,kind:int,stop:int,value:string>>")

    def located(found: Column) -> Column:
        before = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        steps = F.zip_with(before, found, lambda b, m: F.length(b) + F.length(m))
        stops = F.zip_with(_starts(steps), steps, lambda s, n: s + n)
        return F.zip_with(stops, found, lambda stop, m: F.struct(
            (stop - F.length(m)).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), value(m).alias("value")))

    all_found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = let(all_found, lambda found: F.when(F.size(found) > 0, located(found)).otherwise(none))
    return F.coalesce(F.filter(placed, lambda s: keep(s["value"], s["stop"] - s["start"])), F.array().cast(
        "array<struct<start:int,kind:int,stop:int,value:string>>"))


def base_spans(text: Column) -> Column:
    """All spans of the three base kinds, by start and then kind."""
    return F.array_sort(F.concat(
        spans(text, ASSIGN_PATTERN, 0, lambda m: F.regexp_extract(m, ASSIGN_PATTERN, 2),
              lambda v, n: F.length(v) >= MIN_ASSIGN),
        spans(text, ACCESS, 1, lambda m: m, lambda v, n: n >= MIN_ACCESS),
        spans(text, HEX, 2, lambda m: m, lambda v, n: F.lit(True))))


def mixed_spans(text: Column, base: Column) -> Column:
    """Candidate strings of the added kind: lower and upper case and a digit, clear of base spans."""
    found = spans(text, OWNED, 3, lambda m: m,
                  lambda v, n: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"))
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, owners, repos)`` of ``candidates(hash, owner, repo)``: distinct owners and repositories.

    Null owners or repositories count as one. Pairs are made distinct first, with partial aggregation.
    """
    pairs = candidates.select("hash", F.coalesce("owner", F.lit("")).alias("owner"),
                              F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``(id, spans, n_live, n_copied)`` for each row: an array of ``struct(start, kind, stop, value, owners,
    repos, live)`` by start and kind, and how many of them are owner-specific and widely copied.

    ``live`` is true for values with at most ``max_owners`` owners and ``max_repos`` repositories. Null and empty texts have no spans;
    repeated rows get the same spans each, a null id stays null; a null owner is an owner of its own;
    columns that are not named are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.concat_ws("/", *[F.col(c).cast("string") for c in repo_cols])
    found = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), repo.alias("repo"),
                        text.alias("text")).withColumn("base", base_spans(F.col("text")))
    found = found.select("id", "owner", "repo", F.concat("base", mixed_spans(F.col("text"), F.col("base"))).alias("found"))
    found = stash(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = found.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s")).withColumn(
        "hash", F.sha2(F.col("s.value"), 256))
    known = ownership(some)
    marked = some.join(known, "hash").withColumn(
        "live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    kept = F.filter("all", lambda s: (s["kind"] < 3) | s["live"])
    by_row = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "s.start", "s.kind", "s.stop", "s.value", "owners", "repos", "live"))).alias("all")).select("row", kept.alias("spans"))
    with_spans = found.where(F.size("found") > 0).select("id", "row").join(by_row, "row").select("id", "spans")
    without = found.where(F.size("found") == 0).select("id", F.array().cast(with_spans.schema["spans"].dataType).alias("spans"))
    return with_spans.unionByName(without).select(
        F.col("id").alias(id_col), "spans", F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"))


def masked(text: Column, spans_col: Column, mask: str = MASK) -> Column:
    """``text`` with the value of each live span replaced; values that overlap get one mask."""
    values = F.array_sort(F.transform(F.filter(spans_col, lambda s: s["live"]), lambda s: F.struct(
        (s["stop"] - F.length(s["value"])).alias("start"), s["stop"].alias("stop"))))

    def step(done: Column, s: Column) -> Column:
        clear = s["start"] >= done["at"]
        before = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(F.when(clear, F.concat(done["out"], before, F.lit(mask))).otherwise(done["out"]).alias("out"),
                        F.greatest(done["at"], s["stop"]).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(values, start, step, lambda done: F.concat(
        done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **more) -> DataFrame:
    """``docs``, all rows and columns, with live values masked in the text and ``chars_col`` (if any) brought
    up to date. Widely copied values stay, null and empty texts too. Only rows with live values are shuffled, to be joined with them.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("key"), *[F.col(f"`{c}`") for c in docs.columns if c != "key"])
    found = scan(keyed, id_col="key", text_col=text_col, **more).where("n_live > 0").select("key", "spans")
    found = stash(found.dropDuplicates(["key"]), "live")
    probed = maybe_in(packed(docs, row_key(id_col, text_col).alias("key")), F.col("key"), found.select("key"))
    hit = probed.where("maybe").join(found, "key", "left")
    text = F.col(f"row.`{text_col}`")
    new = F.when(F.col("spans").isNotNull(), masked(text, F.col("spans"))).otherwise(text)
    hit = hit.select("row", new.alias("masked"))
    changed = {text_col: F.col("masked")}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        changed[chars_col] = F.when(F.col("masked").eqNullSafe(text), F.col(f"row.`{chars_col}`")).otherwise(
            F.length("masked").cast(kind))
    hit = hit.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return probed.where("not maybe").select("row.*").unionByName(hit)


def joined(spans_col: Column) -> Column:
    """``kind:start:stop`` of each span, joined by commas in their order."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def n_of(spans_col: Column, kind: int) -> Column:
    return F.size(F.filter(spans_col, lambda s: s["kind"] == kind)).cast("long")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text, a digest of the base ones, and counts by kind."""
    out = scan(table(spark, sf_dir, "documents"))
    n = [n_of(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *n, F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"), "n_live", "n_copied")


def _found_sql(kind: int, pattern: str, value: str, keep: str) -> str:
    """DuckDB: one row a match of ``t`` with its place, from the pieces between the matches."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT * FROM (
    SELECT doc_id, {kind} AS kind, m, {value.format(p=quoted)} AS value,
           list_sum([length(x) for x in found[:i - 1]]) AS a, list_sum([length(x) for x in pieces[:i]]) AS b
    FROM (SELECT doc_id, found, pieces, unnest(found) AS m, generate_subscripts(found, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS found,
                       string_split_regex(t, '{quoted}') AS pieces FROM d) WHERE len(found) > 0))
  WHERE {keep}"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join([
    _found_sql(0, ASSIGN_PATTERN, "regexp_extract(m, '{p}', 2)", f"length(value) >= {MIN_ASSIGN}"),
    _found_sql(1, ACCESS, "m", f"length(m) >= {MIN_ACCESS}"),
    _found_sql(2, HEX, "m", "true"),
    _found_sql(3, OWNED, "m", "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')")])}),
placed AS (SELECT doc_id, kind, value, coalesce(a, 0) + coalesce(b, 0) AS start,
                  coalesce(a, 0) + coalesce(b, 0) + length(m) AS stop FROM raw),
clear AS (SELECT * FROM placed p WHERE kind < 3 OR NOT EXISTS (
    SELECT 1 FROM placed q WHERE q.doc_id = p.doc_id AND q.kind < 3 AND q.start < p.stop AND p.start < q.stop)),
owned AS (SELECT value, count(DISTINCT coalesce(source, '')) <= {MAX_OWNERS}
                        AND count(DISTINCT (coalesce(source, ''), concat_ws('/', source, lang))) <= {MAX_REPOS} AS live
          FROM clear JOIN d USING (doc_id) GROUP BY value),
s AS (SELECT doc_id, kind, start, stop, live,
             ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said
      FROM clear JOIN owned USING (value) WHERE kind < 3 OR live)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
       count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_owned,
       sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
