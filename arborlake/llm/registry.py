"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from arborlake.llm import chat, decontam, imatch, langid, lm, mixing, neardup, quality, secrets, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_mix_sources": mixing.op1,
        "op2_chat_format": chat.op2,
        "op3_quality": quality.op3,
        "op4_near_duplicates": neardup.op4,
        "op5_fingerprints": imatch.op5,
        "op6_language": langid.op6,
        "op7_warc_derivatives": warc.op7,
        "op8_secrets": secrets.op8,
        "op9_decontaminate": decontam.op9,
        "op10_lm_scores": lm.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.ORACLE_OP1,
        "op2_chat_format": chat.ORACLE_OP2,
    }
