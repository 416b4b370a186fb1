"""Queries of the subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from docketry.llm import ann, bpe, centroids, exact_dedup, html_text, mixing, ngram_join, pii, quality, token_files, toxicity, vector_codes, warc


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_html_text": html_text.op2_html_text,
        "op3_ann": ann.op3_ann,
        "op4_pii": pii.op4_pii,
        "op5_token_files": token_files.op5_token_files,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_warc": warc.op7_warc,
        "op8_bpe": bpe.op8_bpe,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_mixing": mixing.op10_mixing,
        "op11_centroids": centroids.op11_centroids,
        "op12_quality": quality.op12_quality,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.OP6_SQL, "op10_mixing": mixing.OP10_SQL, "op11_centroids": centroids.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
