"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from stagecast.llm import decontaminate, lexical_search, license_scan, mixing, near_duplicates, parity_join, periodic_runs, secret_scan, token_counts, topk_search, toxicity, url_filter, warc_archive
from stagecast.llm.common import table


def op4_token_counts(spark, sf_dir):
    """Tokens of every whole text of ``documents`` for the sentencepiece vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_duplicates": near_duplicates.op1_near_duplicates,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_mixing": mixing.op6_mixing,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_warc_archive": warc_archive.op10_warc_archive,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_jaccard_join": parity_join.op13_jaccard_join,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_license_scan": license_scan.OP2_SQL,
    "op5_topk_search": topk_search.OP5_SQL,
    "op7_secret_scan": secret_scan.OP7_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op10_warc_archive": warc_archive.OP10_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
}
