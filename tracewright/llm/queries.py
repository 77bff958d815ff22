"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprint, langid, neardup, packing, ppm, quality, secrets, sharding, toxicity


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_packing": packing.op2_packing,
        "op3_neardup": neardup.op3_neardup,
        "op4_sharding": sharding.op4_sharding,
        "op5_language_id": langid.op5_language_id,
        "op6_fingerprint": fingerprint.op6_fingerprint,
        "op7_secrets": secrets.op7_secrets,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_lm_score": ppm.op10_lm_score,
    }


def oracle_sql() -> dict:
    return {"op3_neardup": neardup.op3_sql(), "op7_secrets": secrets.op7_sql()}
