"""The queries of the operators for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitekst.llm import (
    conversations,
    covertree,
    credentials,
    decontam,
    langid,
    lines,
    mixing,
    packing,
    pii,
    resampling,
    simhash,
    spans,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_spans": spans.op1,
    "op2_template_windows": decontam.op2,
    "op3_pii_trees": pii.op3,
    "op4_deficit_packing": packing.op4,
    "op5_simhash": simhash.op5,
    "op6_site_lines": lines.op6,
    "op7_guess_cost": credentials.op7,
    "op8_warc_segments": warc.op8,
    "op9_cover_trees": covertree.op9,
    "op10_viterbi_language": langid.op10,
    "op11_cube_mixing": mixing.op11,
    "op12_audit_repair": conversations.op12,
    "op13_importance_resampling": resampling.op13,
}
