"""The queries of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, chat, decontaminate, licenses, ngram_join, packing, pitman_yor, quality, runs, separator_scan, token_files, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.query,
    "op2_packing": packing.query,
    "op3_separator_scan": separator_scan.query,
    "op4_chat_formatting": chat.query,
    "op5_ngram_join": ngram_join.query,
    "op6_decontaminate": decontaminate.query,
    "op7_pitman_yor": pitman_yor.query,
    "op8_warc": warc.query,
    "op9_license_scan": licenses.query,
    "op10_quality_rules": quality.query,
    "op11_whitening": whitening.query,
    "op12_bpe": bpe.query,
    "op13_periodic_runs": runs.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_formatting": chat.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
}
