"""All registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracles."""

from __future__ import annotations

import importlib

# plan modules, each exposing QUERIES and ORACLE
_MODULES = (
    "search_q",
    "sql_q",
    "docquery_q",
    "tableops_q",
    "sinks_q",
    "catalog_q",
    "snapshot_q",
    "stream_q",
    "jobs_q",
    "ordered_q",
)


def _load():
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"{__package__}.{m}")
        dup = set(queries) & set(mod.QUERIES)
        if dup:
            raise ValueError(f"duplicate query names {sorted(dup)} in {m}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
