"""JSON collections: import (S01), export (S02), document insert (S10) and
index append of JSON text (S09).

Scale notes. Files that hold one JSON array are cut into objects in parallel
(``jsonarray``) and then read like JSON Lines; the export writes one array per part
file (``array=True``) or JSON Lines (default). Every read passes a schema when the caller
has one, which saves the inference pass over the data.

``timestamp_ntz`` columns: the JSON writer keeps milliseconds by default, so
both sides use a microsecond pattern.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import work_path
from . import _framing, jsonarray

# Executors import nothing of this package: the mapInPandas function is
# shipped by value with the task.
cloudpickle.register_pickle_by_value(_framing)

# Timestamp patterns for JSON text and the export name format.
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
EXPORT_NAME_FMT = "%Y%m%d-%H%M%S"

_JSON_OPTS = {"timestampNTZFormat": TS_NTZ_FORMAT, "timestampFormat": TS_FORMAT}


def default_export_name(coll: str, now: _dt.datetime | None = None) -> str:
    """``<coll>-<yyyymmdd-HHMMSS>.json`` (UTC)."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return f"{coll}-{now.strftime(EXPORT_NAME_FMT)}.json"


def export_json(df: DataFrame, path: str, array: bool = False, mode: str = "error",
                compression: str | None = None) -> str:
    """Write ``df`` below ``path``; one file per partition, written in parallel.

    ``array=False``: JSON Lines. ``array=True``: every part file holds one
    JSON array of objects (the import format). No row passes the driver.
    """
    if not array:
        w = df.write.mode(mode).options(**_JSON_OPTS)
        if compression:
            w = w.option("compression", compression)
        w.json(path)
        return path
    lines = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), _JSON_OPTS)
                      .alias("value"))
    framed = lines.mapInPandas(_framing.array_frames, "value string")
    w = framed.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.text(path)
    return path


def read_json(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
              array: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Read JSON Lines or, with ``array``, files that each hold one array.

    A malformed or mistyped document fails the read unless ``mode`` says
    otherwise. With ``array`` the files are read in byte ranges, whatever their
    sizes, and a file that is not one array of objects is an error.
    """
    r = spark.read.options(**_JSON_OPTS).option("mode", mode)
    if array:
        lines = work_path(spark, "json_lines")
        jsonarray.objects(spark, path).write.text(lines)
        path = lines
    if schema is not None:
        r = r.schema(schema)
    return r.json(path if isinstance(path, str) else list(path))


def import_json(spark: SparkSession, path: str, table: str, schema=None,
                array: bool = False, mode: str = "append") -> DataFrame:
    """``import <file.json> <db> <coll>``: append the file(s) to ``db.coll``.

    Returns the target table. The collection is created on first write, as
    a document store creates it; no upsert, as in the reference command.
    """
    docs = read_json(spark, path, schema=schema, array=array)
    docs.write.mode(mode).format("parquet").saveAsTable(table)
    return spark.table(table)


# --- S10: insert documents with a changing shape -------------------------------

def insert_docs(docs: DataFrame, path: str) -> None:
    """``insertMany``: append documents to a collection folder.

    New fields are allowed: each append writes its own schema, and
    ``read_docs`` merges the schemas of all parts.
    """
    docs.write.mode("append").parquet(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def insert_mixed(docs: DataFrame, json_col: str, path: str) -> None:
    """``insertMany`` of documents whose fields change their type: the documents are kept as
    ``VARIANT``, so a field may be a number here and a text or an object there. Text that is no JSON is an error."""
    docs.select(F.parse_json(json_col).alias("doc")).write.mode("append").parquet(path)


def mixed_field(path: str, kind: str) -> Column:
    """A field of ``doc`` where it is of this type (``bigint``, ``double``, ``string``, ...), null
    elsewhere: a text is not read as a number, nor a number as a text."""
    found = F.schema_of_variant(F.try_variant_get("doc", path, "variant"))
    own = {"string": found == "STRING", "boolean": found == "BOOLEAN", "bigint": found == "BIGINT",
           "double": found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")}[kind]
    return F.when(own, F.try_variant_get("doc", path, kind))


def mixed_schema(docs: DataFrame) -> DataFrame:
    """One row: the type of all documents together (a field of two types is a variant)."""
    return docs.agg(F.schema_of_variant_agg("doc").alias("type"))


# --- S09: index documents given as JSON text ------------------------------------

def index_docs(docs: DataFrame, json_col: str, path: str, id_col: str | None = None) -> None:
    """Append JSON documents to an index folder as ``(_id, doc variant, raw)``.

    ``_id`` is the given id column or, when none, the 64-bit hash of the JSON
    text (the same document gets the same id). Fields of any shape stay in
    the ``VARIANT`` column; typed views come from ``variant_get``. Text that
    is not JSON goes to ``<path>/_rejects``, which reads of the index skip.
    """
    raw = F.col(json_col)
    _id = F.col(id_col).cast("string") if id_col else F.xxhash64(raw).cast("string")
    parsed = docs.select(_id.alias("_id"), F.try_parse_json(raw).alias("doc"), raw.alias("raw"))
    bad = F.col("doc").isNull() & F.col("raw").isNotNull()
    parsed.filter(~bad).write.mode("append").parquet(path)
    parsed.filter(bad).select("_id", "raw").write.mode("append").parquet(f"{path}/_rejects")


# The document indexed when none is given.
DEFAULT_DOC_MESSAGE = "test document"
DEFAULT_DOC_VALUE = 123


def default_doc(spark: SparkSession) -> DataFrame:
    """One JSON document ``{message, timestamp (ISO-8601 UTC), value}``."""
    return spark.range(1).select(F.to_json(F.struct(
        F.lit(DEFAULT_DOC_MESSAGE).alias("message"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(DEFAULT_DOC_VALUE).alias("value"))).alias("json"))


def doc_field(doc: Column | str, path: str, type_: str) -> Column:
    """Typed value at ``path`` of a variant document, NULL if absent or of another type."""
    c = F.col(doc) if isinstance(doc, str) else doc
    return F.try_variant_get(c, path, type_)
