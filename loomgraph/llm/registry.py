"""Queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontamination, exact_topk, licenses, minhash_dedup, orchard, ranked_search, substring_dedup, token_counts, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_query,
        "op2_benchmark_decontamination": decontamination.op2_query,
        "op3_exact_topk": exact_topk.op3_query,
        "op4_bpe_encode_decode": bpe.op4_query,
        "op10_license_scan": licenses.op10_query,
        "op5_chat_format": chat_format.op5_query,
        "op7_warc_revisits": warc.op7_query,
        "op8_token_counts": token_counts.op8_query,
        "op9_minhash_near_dedup": minhash_dedup.op9_query,
        "op6_substring_dedup": substring_dedup.op6_query,
        "op11_url_filter": url_filter.op11_query,
        "op12_ranked_search": ranked_search.op12_query,
        "op13_orchard_clusters": orchard.op13_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": exact_topk.OP3_SQL, "op7_warc_revisits": warc.OP7_SQL, "op11_url_filter": url_filter.OP11_SQL, "op12_ranked_search": ranked_search.OP12_SQL, "op13_orchard_clusters": orchard.OP13_SQL}
