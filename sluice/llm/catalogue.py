"""Queries of the training-data operators and the SQL that some can be held against."""

from __future__ import annotations

from sluice.llm import ctw, decontam, langid, linededup, mixing, pii, quality, secrets, simhash, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_simhash": simhash.op2_simhash,
    "op3_secrets": secrets.op3_secrets,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_lm_score": ctw.op6_lm_score,
    "op7_pii": pii.op7_pii,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_langid": langid.op9_langid,
    "op10_decontam": decontam.op10_decontam,
}

ORACLE = {
    "op1_warc": warc.OP1_SQL,
}
