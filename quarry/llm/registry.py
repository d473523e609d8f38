"""What this subpackage registers with the driver."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from quarry.llm import common, decontamination, language_model, line_dedup, mixing, near_dedup, pii, token_count, toxicity, url_filter, vector_search

_QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_pii": pii.op6_pii,
    "op7_vector_search": vector_search.op7_vector_search,
    "op8_mixing": mixing.op8_mixing,
    "op9_lm_score": language_model.op9_lm_score,
    "op10_token_count": token_count.op10_token_count,
    "pipeline": corpus_pipeline.run,
}
_SQL = {"op3_decontamination": decontamination.OP3_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op5_url_filter": url_filter.OP5_SQL}


def _shipped(query: Callable) -> Callable:
    def run(spark, sf_dir):
        common.ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
