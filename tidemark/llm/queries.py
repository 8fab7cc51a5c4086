"""The operators' queries, one for each, over their whole tables, and the SQL each is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.align import op12_token_alignment
from tidemark.llm.ann import op9_nearest_neighbours
from tidemark.llm.audit import OP13_SQL, op13_filter_audit
from tidemark.llm.classifier import op11_quality_classifier
from tidemark.llm.html_text import op8_html_extraction
from tidemark.llm.lm import op1_lm_scoring
from tidemark.llm.near import op6_near_dedup
from tidemark.llm.packing import op2_best_fit_packing
from tidemark.llm.passages import op10_substring_dedup
from tidemark.llm.pieces import op7_sentencepiece
from tidemark.llm.quality import op4_quality_rules
from tidemark.llm.secrets import op5_secret_scans
from tidemark.llm.urls import OP3_SQL, op3_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scans": op5_secret_scans,
    "op6_near_dedup": op6_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html_extraction": op8_html_extraction,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_token_alignment": op12_token_alignment,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE: dict[str, str] = {"op3_url_filters": OP3_SQL, "op13_filter_audit": OP13_SQL}
