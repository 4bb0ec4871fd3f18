"""Queries over the driver's tables, one for each operator or family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.plans import cohort_queries, interval_queries, privacy_queries, repair_queries, report_queries, retime_queries, source_queries, stream_queries, text_queries, token_queries, word_queries

_PARTS = (text_queries, word_queries, interval_queries, stream_queries, privacy_queries, retime_queries, repair_queries, report_queries, cohort_queries, source_queries, token_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def _counts_as_long(sql: str) -> str:
    """count_if() gives a huge integer there; a long here."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 0, k + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out, at = out + sql[at:k] + f"CAST({sql[k:end]} AS BIGINT)", end
    return out + sql[at:]


def oracle_sql() -> dict[str, str]:
    return {name: _counts_as_long(sql) for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
