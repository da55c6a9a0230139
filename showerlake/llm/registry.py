"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import op01_simhash, op02_html, op03_quality, op04_bpe, op05_tokens, op06_embeddings, op07_mixing, op08_urls, op09_language, op10_exact


def queries() -> dict:
    return {
        "op1_simhash": op01_simhash.op1_simhash,
        "op2_html": op02_html.op2_html,
        "op3_quality": op03_quality.op3_quality,
        "op4_bpe": op04_bpe.op4_bpe,
        "op5_tokens": op05_tokens.op5_tokens,
        "op6_embeddings": op06_embeddings.op6_embeddings,
        "op7_mixing": op07_mixing.op7_mixing,
        "op8_urls": op08_urls.op8_urls,
        "op9_language": op09_language.op9_language,
        "op10_exact": op10_exact.op10_exact,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact": op10_exact.SQL}
