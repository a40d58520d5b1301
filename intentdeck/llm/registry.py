"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from intentdeck.llm import decontamination, jaccard_join, near_vectors, packing, quality, secrets, suffix_dedup, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_near_vectors": near_vectors.op4_near_vectors,
        "op5_warc": warc.op5_warc,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_quality_resampling": quality.op10_quality_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_vectors": near_vectors.OP4_SQL, "op5_warc": warc.OP5_SQL, "op7_url_filter": url_filter.OP7_SQL}
