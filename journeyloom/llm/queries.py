"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from journeyloom.llm import conversation_repair, decontaminate, hmm_lm, jaccard_join, line_dedup, near_vectors, packing, pair_index_bpe, periodic_runs, token_counts, toxicity, url_filters, warc_bundles

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": warc_bundles.op1_warc_bundles,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filters": url_filters.op5_url_filters,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_near_vectors": near_vectors.op10_near_vectors,
    "op6_hmm_language_model": hmm_lm.op6_hmm_language_model,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_bpe_encoding": pair_index_bpe.op12_bpe_encoding,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
LLM_ORACLES: dict[str, str] = {
    "op1_warc_bundles": warc_bundles.oracle_sql(),
    "op5_url_filters": url_filters.oracle_sql(),
}
