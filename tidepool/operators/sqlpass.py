"""Q01: run a SQL string on a named database (default: the session's current).

Spark SQL is the dialect; nothing is translated. Differences from PostgreSQL
a user meets: NULLs sort first ascending in Spark (write NULLS FIRST/LAST);
integer ``/`` gives a fraction (use ``div``); ``DISTINCT ON`` and
``generate_series`` are written as ``row_number() = 1`` and
``explode(sequence(..))``; ``\\l`` / ``\\dt`` are client commands, see the
catalog operators.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import TABLES, register_views


def run_sql(spark: SparkSession, query: str | Sequence[str], db: str | None = None,
            sf_dir: str | None = None) -> DataFrame:
    """Run a statement (or a list of statements in order); return the last result.

    With ``sf_dir`` the given tables are visible as temp views first. An empty
    query is an error, as in the reference's ``sql`` command.
    """
    stmts = [query] if isinstance(query, str) else list(query)
    stmts = [s for s in stmts if s and s.strip()]
    if not stmts:
        raise ValueError("empty query")
    if sf_dir:
        # only the given tables the statements name (a word match: a stray
        # match registers a view nobody reads, which costs nothing)
        text = "\n".join(stmts)
        named = [t for t in TABLES if re.search(rf"\b{t}\b", text, re.IGNORECASE)]
        register_views(spark, sf_dir, named)
    before = spark.catalog.currentDatabase()
    if db:
        spark.catalog.setCurrentDatabase(db)
    try:
        result = None
        for s in stmts:
            result = spark.sql(s)  # names are resolved here, so the database
        return result              # can be switched back right after
    finally:
        if db:
            spark.catalog.setCurrentDatabase(before)
