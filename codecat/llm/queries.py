"""The registered queries of this subpackage, and their DuckDB equivalents where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination, divergence, fill_in_middle, hidden_markov, html_extract, language_id, mixing, ngram_join, pii, quality_rules, substring_dedup,
    suffix_dedup, url_filter,
)
from .stages import on_executors


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_executors(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    return run


QUERIES = {f.__name__: _query(f) for f in (
    url_filter.op1_url_filter,
    language_id.op2_language_id,
    html_extract.op3_html_extract,
    mixing.op4_mixing,
    decontamination.op5_decontamination,
    quality_rules.op6_quality_rules,
    pii.op7_pii,
    ngram_join.op8_ngram_join,
    substring_dedup.op9_substring_dedup,
    suffix_dedup.op10_suffix_dedup,
    hidden_markov.op11_hidden_markov,
    fill_in_middle.op12_fill_in_middle,
    divergence.op13_source_divergence,
)}

ORACLE = {
    "op1_url_filter": url_filter.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
