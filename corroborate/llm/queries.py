"""The queries of this subpackage, by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corroborate.llm import bpe, exact_dedup, html_text, license_scan, quality_classifier, quality_rules, secret_scan, simhash, source_mix, spelling, token_alignment, top_k, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_source_mix": source_mix.op2_source_mix,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_html_text": html_text.op6_html_text,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": bpe.op9_bpe,
    "op10_secrets": secret_scan.op10_secrets,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_top_k": top_k.op12_top_k,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op7_exact_dedup": exact_dedup.OP7_SQL, "op12_top_k": top_k.OP12_SQL}
