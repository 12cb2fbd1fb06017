"""The queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quarry.llm import exact_dedup, licenses, line_dedup, mixing, near_dedup, packing, quality_crf, quality_rules, quantiles, ranked_search, secrets, token_counts, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_quality_crf": quality_crf.op3_quality_crf,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_token_files": token_files.op6_token_files,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_source_mix": mixing.op8_source_mix,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_quantile_summaries": quantiles.op11_quantile_summaries,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op13_license_scan": licenses.op13_license_scan,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op4_quality_rules": quality_rules.OP4_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op12_ranked_search": ranked_search.OP12_SQL,
    }
