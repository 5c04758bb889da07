"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from canopy.llm import bpe, langid, licenses, lines, lm, media, mixing, near, pipeline, topk, urls


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_lines": lines.op2_lines,
        "op3_lm": lm.op3_lm,
        "op4_media": media.op4_media,
        "op5_mixing": mixing.op5_mixing,
        "op6_urls": urls.op6_urls,
        "op7_bpe": bpe.op7_bpe,
        "op8_language": langid.op8_language,
        "op9_topk": topk.op9_topk,
        "op10_near": near.op10_near,
        "pipeline": pipeline.run,
        "pages_language": langid.pages_language,
    }


def oracle_sql() -> dict:
    return {"op1_licenses": licenses.OP1_SQL, "op2_lines": lines.OP2_SQL, "op6_urls": urls.OP6_SQL, "op9_topk": topk.OP9_SQL}
