"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import bpe, chunks, languages, lm, maxscore, packing, quality, repair, secrets, simhash, sql, suffixes, toxicity, variants

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """The query of each corpus operator by its name."""
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_substring_dedup": chunks.op5_substring_dedup,
        "op6_class_lm": lm.op6_class_lm,
        "op7_suffix_array": suffixes.op7_suffix_array,
        "op8_maxscore": maxscore.op8_maxscore,
        "op9_simhash": simhash.op9_simhash,
        "op10_packing": packing.op10_packing,
        "op11_spelling_variants": variants.op11_spelling_variants,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_language_id": languages.op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express."""
    return {
        "op1_quality_rules": sql.QUALITY,
        "op3_secret_scan": sql.SECRETS,
        "op8_maxscore": sql.MAXSCORE,
        "op11_spelling_variants": sql.VARIANTS,
        "op12_conversation_repair": sql.REPAIR,
    }
