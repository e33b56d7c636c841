"""Registered queries of this subpackage, with their SQL where SQL can say them."""

from __future__ import annotations

from . import decontamination, html_text, language_id, line_dedup, mixing, near_dedup, quality_model, quality_rules, token_output, toxicity
from .common import table


#: Tokenizer file of op9; a caller's own path goes to token_output directly.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def queries() -> dict:
    return {
        "op1_quality_rules": lambda spark, d: quality_rules.op1_quality_rules(table(spark, d, "documents")),
        "op10_line_dedup": lambda spark, d: line_dedup.op10_line_dedup(spark, table(spark, d, "documents")),
        "op2_language_id": lambda spark, d: language_id.op2_language_id(spark, table(spark, d, "documents")),
        "op3_toxicity": lambda spark, d: toxicity.op3_toxicity(spark, table(spark, d, "documents"), table(spark, d, "labels")),
        "op4_html_text": lambda spark, d: html_text.op4_html_text(table(spark, d, "pages")),
        "op5_near_dedup": lambda spark, d: near_dedup.op5_near_dedup(spark, table(spark, d, "documents")),
        "op6_quality_model": lambda spark, d: quality_model.op6_quality_model(spark, table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_decontamination": lambda spark, d: decontamination.op7_decontamination(spark, table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op8_mixing": lambda spark, d: mixing.op8_mixing(table(spark, d, "documents")),
        "op9_token_output": lambda spark, d: token_output.op9_token_output(spark, table(spark, d, "documents"), tokenizer_path()),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL, "op7_decontamination": decontamination.SQL, "op8_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL}
