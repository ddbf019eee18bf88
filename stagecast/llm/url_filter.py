"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list is turned into a blocked Bloom filter: each URL hashes to one block of 256 bits and sets
eight bits in it (two in each of four words). The filter is a table ``(block, w0..w3)`` of at most
``n_blocks`` rows whatever the length of the list, so it is the one thing that is broadcast. URLs
whose bits are all set are possible hits; only they go on to an exact join with the list, which
removes the false positives. A longer list raises the share of possible hits (about 0.1 % false
positives at 16 listed URLs a block), never the error of the result. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.llm.common import N_BLOCKS, lower_ascii, maybe_in, table

#: Fixed values of the query: (verdict, host, path); a rule holds for its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path with query parameters other than tracking ones; null without ``://``.

    Dropped: scheme, fragment, ``www.`` and ``m.`` in front of the host, ports 80 and 443, a final
    ``.html`` or slash of the path, and parameters named ``utm_*`` or ``ref``; what is left is sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)$", ""), "^(www|m)\\.", "")
    path = F.regexp_replace(path_of(url), "(\\.html|/+)$", "")
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    return F.when(_rest(url).isNotNull(), F.concat(
        host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits (host and path together), else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def listed_hits(urls: DataFrame, listed: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """``urls`` (with a column ``canonical``) plus ``listed`` boolean: is it in ``listed(url)``?

    Null URLs are not listed. Rows stay as often as they are; ``listed`` may hold nulls and repeats.
    """
    names = listed.where("url is not null").select("url").distinct()
    probed = maybe_in(urls, F.col("canonical"), names.select(F.col("url").alias("key")), n_blocks)
    possible = probed.where("maybe").drop("maybe")
    exact = possible.join(names.withColumn("listed", F.lit(True)), possible["canonical"] == names["url"], "left").select(
        *urls.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    return exact.unionByName(probed.where("not maybe").drop("maybe").withColumn("listed", F.lit(False)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id",
               url_col: str = "url", n_blocks: int = N_BLOCKS) -> DataFrame:
    """``(id, host, path, rule, verdict, canonical, listed)`` for each row of ``pages``.

    A fitting rule decides; else a listed canonical URL is blocked and any other allowed. Null URLs
    and URLs without ``://`` have empty host and path, no rule and are allowed. Empty tables, empty
    lists, repeated rows and null ids pass through; URLs are judged whole, however long; other columns are not read.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                          canonical(url).alias("canonical"))
    judged = judged.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    return listed_hits(judged, listed, n_blocks).select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical", "listed")


def repeated_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``(url)``: canonical URLs that two or more pages have."""
    return (pages.select(canonical(F.col(url_col)).alias("url")).where("url is not null")
            .groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the fixed rules, then against the list of URLs crawled repeatedly."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, repeated_urls(pages))


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
OP9_SQL = f"""
WITH a AS (SELECT page_id, {_REST} AS rest FROM pages),
b AS (SELECT page_id, rest,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '') AS query FROM a),
c AS (SELECT page_id, rest, host, path,
        list_sort(list_filter(string_split(query, '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS kept FROM b),
d AS (SELECT page_id, host, path, CASE WHEN rest IS NOT NULL THEN
        regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\\.', '')
        || regexp_replace(path, '(\\.html|/+)$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM c),
listed AS (SELECT canonical AS url FROM d WHERE canonical IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
e AS (SELECT d.*, (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
                   ORDER BY length(h) + length(p) DESC LIMIT 1) AS rule FROM d)
SELECT page_id, host, path, e.rule,
       coalesce(r.verdict, CASE WHEN listed.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       canonical, listed.url IS NOT NULL AS listed
FROM e LEFT JOIN r ON e.rule = r.h || r.p LEFT JOIN listed ON e.canonical = listed.url
"""
