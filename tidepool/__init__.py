"""tidepool: a small data platform's everyday data work as Spark operators.

Subpackages: ``sources`` (tables, JSON, files, JDBC, topics, logs),
``operators`` (search, document queries, dataflows, catalog, snapshots,
SQL pass-through, federation, jobs), ``functions`` (tokeniser),
``streaming`` (Structured Streaming ingest and follow), ``plans`` (the
registered queries and their DuckDB oracles). ``python -m tidepool`` is the
command line.
"""

__version__ = "0.1.0"
