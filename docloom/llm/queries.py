"""The thin opN queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format,
    cross_polytope,
    hard_negatives,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    quality_rules,
    secret_scan,
    sentence_pieces,
    url_filters,
    whitening,
)
from .common import table


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": _documents(secret_scan.op1_secrets),
    "op2_quality": quality_rules.op2_quality,
    "op3_language": _documents(language_id.op3_language),
    "op4_nearest": cross_polytope.op4_nearest,
    "op5_chat": chat_format.op5_chat,
    "op6_url_filter": url_filters.op6_url_filter,
    "op7_licenses": _documents(license_scan.op7_licenses),
    "op8_mixing": _documents(mixing.op8_mixing),
    "op9_sentence_pieces": _documents(sentence_pieces.op9_sentence_pieces),
    "op10_jaccard_join": _documents(jaccard_join.op10_jaccard_join),
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_whitening": whitening.op12_whitening,
    "op13_line_dedup": _documents(line_dedup.op13_line_dedup),
}

ORACLE_SQL: dict[str, str] = {
    "op1_secrets": secret_scan.oracle_sql(),
    "op8_mixing": mixing.OP8_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
