"""name -> query and name -> SQL of the operators outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import checks, curation, encoding, files, requests, scoring

_MODULES = (curation, encoding, scoring, requests, checks, files)
#: columns that DuckDB sums to a wider integer than Spark
_SUMS = {
    "pack_report": ("items",),
    "token_stats": ("supervised", "tokens"),
    "lexical_summary": ("tokens",),
    "score_overall": ("tp", "fp", "fn", "support"),
    "score_slices": ("tp", "fp", "fn", "support"),
    "weighted_loss": ("tokens",),
    "parameter_table": ("parameters", "adapter"),
    "consumption": ("total",),
    "train_time": ("tokens",),
    "stream_sessions": ("events",),
}


def _long(sql: str, columns: tuple[str, ...]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({sql})" if columns else sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: _long(sql, _SUMS.get(name, ())) for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
