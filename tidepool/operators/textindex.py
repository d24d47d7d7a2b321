"""Segmented inverted index: append, search, delete, compact, list, drop.

Layout below an index's folder::

    manifest/               rows of all versions; the highest version is the index
    segments/<name>/docs    (_id, raw, words, lengths): the documents, per field their
                            words in one string and how many
    segments/<name>/postings (field, term, ids, tfs, dls): the documents of a term in blocks,
                            one for each run of documents, by field and term in a run
    tombstones/<name>       (segment, _id, lengths) of documents that are no more

Every append writes a segment with its own postings and statistics and leaves
the others alone; a delete writes tombstones only. A segment is written where its
documents lie: words are found once, kept with the documents, and counted document by
document in the tasks that read them again, so neither texts nor postings are shuffled or
sorted and a task holds the postings of one run, however large its input. A search reads the postings
of its terms from all live segments (in small row groups: the term filter skips the rest),
takes out the tombstones, and ranks by BM25 over the remaining documents: the number
of documents and the lengths are those of the segments less those of the
tombstones, which carry them, so no document is read for statistics. Compaction
writes one segment of the live documents; the ranking is the same before and after.

A version becomes visible when its manifest file is committed, so readers and a
writer that failed on the way never see half an append; what a failed writer left is
not referred to. One writer at a time. A document is known by its ``_id``: an
append of a known id replaces the document, and of equal ids in one append the
greatest text is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, word_count, words
from . import _postings
from .search import _idf, _term_score, top_k

# Executors import nothing of this package: what they run is shipped by value.
cloudpickle.register_pickle_by_value(_postings)

POSTINGS = "field string, term string, ids array<string>, tfs array<int>, dls array<int>"
# So many tombstones are broadcast (some 100 bytes each), more are shuffled.
FEW_DEAD = 200_000
# Row groups of the postings are small, so that a search skips those without its terms.
BLOCK_BYTES = 2 << 20

MANIFEST = ("version long, kind string, name string, field string, docs long, with_words long, words long, bytes long")


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _state(spark: SparkSession, path: str) -> list:
    """The rows of the newest version: one per live segment, field of one, and tombstone folder."""
    rows = _manifest(spark, path)
    newest = rows.agg(F.max("version")).first()[0] if rows is not None else None
    if newest is None:
        raise ValueError(f"no index at {path}")
    return rows.filter(F.col("version") == newest).collect()


def _commit(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    """A version's rows (kind, name, field, docs, with_words, words, bytes), in one file."""
    spark.createDataFrame([(version, *r) for r in rows], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _kept(state: list, *kinds: str) -> list[tuple]:
    return [tuple(r)[1:] for r in state if r["kind"] in kinds]


def create(spark: SparkSession, path: str) -> None:
    """An index without documents; an error if there is one."""
    if exists(spark, path):
        raise ValueError(f"there is an index at {path}")
    _commit(spark, path, 0, [("index", None, None, None, None, None, None)])


def exists(spark: SparkSession, path: str) -> bool:
    rows = _manifest(spark, path)
    return rows is not None and rows.limit(1).count() > 0


def json_documents(docs: DataFrame, json_col: str, id_col: str | None = None) -> DataFrame:
    """JSON text as documents for ``append``: every top-level field is one; the id is the
    given column, else a hash of the text. Text that is no JSON object is an error."""
    raw = F.col(json_col)
    fields = F.from_json(raw, "map<string,string>", {"mode": "FAILFAST"})
    _id = F.col(id_col).cast("string") if id_col else F.xxhash64(raw).cast("string")
    return docs.select(_id.alias("_id"), raw.alias("raw"), fields.alias("fields"))


def column_documents(docs: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Columns as documents for ``append``; the stored text is the row as JSON."""
    return docs.select(F.col(id_col).cast("string").alias("_id"), F.to_json(F.struct(id_col, *fields)).alias("raw"),
                       F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields])).alias("fields"))


def _write_segment(docs: DataFrame, path: str, checked: bool = False) -> tuple[str, list[tuple]]:
    """Write documents (_id, raw, words) as a segment: its name and manifest rows. Unless
    ``checked``, ids may come more than once, and the greatest text of an id is kept."""
    spark, name = docs.sparkSession, uuid.uuid4().hex[:12]
    to = f"{path}/segments/{name}"
    docs.select("_id", "raw", "words", F.transform_values("words", lambda _, w: word_count(w)).alias("lengths")).write.parquet(f"{to}/docs")
    written = spark.read.parquet(f"{to}/docs")
    if not checked and written.groupBy("_id").count().filter("count > 1").limit(1).count():
        one = written.groupBy("_id").agg(F.max_by(F.struct("raw", "words"), F.coalesce("raw", F.lit(""))).alias("d"))
        return _write_segment(one.select("_id", "d.raw", "d.words"), path, checked=True)
    texts = written.select("_id", F.explode("words").alias("field", "words")).filter("words <> ''")
    texts.mapInArrow(_postings.blocks, POSTINGS).write.option("parquet.block.size", BLOCK_BYTES).parquet(f"{to}/postings")
    size = sum(spark.read.parquet(f"{to}/{part}").select("_metadata.file_path", "_metadata.file_size").distinct()
               .agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0] for part in ("docs", "postings"))
    per_field = written.select(F.explode("lengths").alias("field", "dl")).groupBy("field") \
        .agg(F.count_if(F.col("dl") > 0).alias("n"), F.sum("dl").alias("words")).collect()  # a row a field
    return name, [("segment", name, None, written.count(), None, None, size)] + \
        [("field", name, r["field"], None, r["n"], r["words"], None) for r in per_field]


def append(docs: DataFrame, path: str) -> None:
    """Add documents (_id, raw, fields) as a segment; known ids are replaced."""
    spark = docs.sparkSession
    state = _state(spark, path)
    found = F.transform_values("fields", lambda _, text: F.coalesce(words(text), F.lit("")))
    name, segment = _write_segment(docs.filter(F.col("_id").isNotNull()).select("_id", "raw", found.alias("words")), path)
    replaced = _tombstones(spark, path, state, spark.read.parquet(f"{path}/segments/{name}/docs").select("_id"))
    _commit(spark, path, state[0]["version"] + 1, _kept(state, "index", "segment", "field", "tombstones") + segment + replaced)


def _docs(spark: SparkSession, path: str, state: list) -> DataFrame | None:
    """The live documents (segment, _id, raw, words, lengths); null for an index without any."""
    names = [r["name"] for r in state if r["kind"] == "segment"]
    if not names:
        return None
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/segments/{n}/docs").withColumn("segment", F.lit(n)) for n in names])
    return _alive(rows, _dead(spark, path, state), state)


def _alive(rows: DataFrame, dead: DataFrame | None, state: list) -> DataFrame:
    """The rows (segment, _id, ...) of documents that are not deleted."""
    if dead is None:
        return rows
    few = sum(r["docs"] for r in state if r["kind"] == "tombstones") <= FEW_DEAD
    return rows.join(dead.select("segment", "_id").hint("broadcast" if few else "shuffle_hash"), ["_id", "segment"], "left_anti")


def _dead(spark: SparkSession, path: str, state: list) -> DataFrame | None:
    names = [r["name"] for r in state if r["kind"] == "tombstones"]
    return spark.read.parquet(*[f"{path}/tombstones/{n}" for n in names]) if names else None


def _tombstones(spark: SparkSession, path: str, state: list, ids: DataFrame) -> list[tuple]:
    """Write tombstones for the live documents with these ids; the manifest rows."""
    live, name = _docs(spark, path, state), uuid.uuid4().hex[:12]
    if live is None:
        return []
    ids = ids.select(F.col("_id").cast("string").alias("_id")).distinct()
    live.join(ids, "_id", "left_semi").select("segment", "_id", "lengths").write.parquet(f"{path}/tombstones/{name}")
    n = spark.read.parquet(f"{path}/tombstones/{name}").count()
    return [("tombstones", name, None, n, None, None, None)] if n else []


def delete(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Delete the documents whose ``_id`` is among ``ids``; how many there were."""
    state = _state(spark, path)
    dead = _tombstones(spark, path, state, ids)
    if dead:
        _commit(spark, path, state[0]["version"] + 1, _kept(state, "index", "segment", "field", "tombstones") + dead)
    return sum(r[3] for r in dead)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(_id, raw) of the live documents."""
    live = _docs(spark, path, _state(spark, path))
    return live.select("_id", "raw") if live is not None else spark.createDataFrame([], "_id string, raw string")


def search(spark: SparkSession, path: str, query: str, field: str = "text", k: int = 10, offset: int = 0) -> DataFrame:
    """(_id, score): a page of the BM25 ranking over the live documents; '*' ranks all alike, by id."""
    state = _state(spark, path)
    terms, names = query_terms(query), [r["name"] for r in state if r["kind"] == "segment"]
    if query.strip() == "*":
        return documents(spark, path).select("_id", F.lit(1.0).alias("score")).orderBy("_id").limit(offset + k).offset(offset)
    if not terms or not names:
        return spark.createDataFrame([], "_id string, score double")
    n = sum(r["docs"] for r in state if r["kind"] == "segment")
    fields = [r for r in state if r["kind"] == "field" and r["field"] == field]
    with_words, words = sum(r["with_words"] for r in fields), sum(r["words"] for r in fields)
    found = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/segments/{s}/postings").filter(
        (F.col("field") == field) & F.col("term").isin(terms)).select(F.lit(s).alias("segment"), "term", F.inline(F.arrays_zip(F.col("ids").alias("_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))) for s in names])
    dead = _dead(spark, path, state)
    if dead is not None:
        dl = F.coalesce(F.col("lengths")[field], F.lit(0))
        gone = dead.agg(F.count("*"), F.count_if(dl > 0), F.coalesce(F.sum(dl), F.lit(0))).first()  # three numbers
        n, with_words, words = n - gone[0], with_words - gone[1], words - gone[2]
        found = _alive(found, dead, state)
    avgdl = F.lit(words / with_words if with_words else 1.0)
    df = found.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    # one row per query term: a broadcast of a size that the query bounds
    scored = found.join(F.broadcast(df), "term").select(
        "_id", _term_score(F.col("tf"), _idf(F.lit(float(n)), F.col("df")), F.col("dl").cast("double"), avgdl).alias("s")) \
        .groupBy("_id").agg(F.sum("s").alias("score"))
    return top_k(scored, k, offset=offset, id_col="_id")


def compact(spark: SparkSession, path: str) -> None:
    """Write all live documents as one segment without tombstones."""
    state = _state(spark, path)
    names = [r["name"] for r in state if r["kind"] == "segment"]
    if len(names) < 2 and not _kept(state, "tombstones"):
        return
    _, segment = _write_segment(_docs(spark, path, state), path, checked=True)
    _commit(spark, path, state[0]["version"] + 1, _kept(state, "index") + segment)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """index, docs, segments, bytes of every index below ``root``, from the manifests alone."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/*/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "index string, docs long, segments long, bytes long")
    rows = rows.withColumn("index", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/manifest/[^/]+$", 1))
    newest = F.max("version").over(Window.partitionBy("index"))
    sign = F.when(F.col("kind") == "segment", F.col("docs")).when(F.col("kind") == "tombstones", -F.col("docs")).otherwise(0)
    return rows.withColumn("newest", newest).filter("version = newest").groupBy("index").agg(
        F.sum(sign).cast("long").alias("docs"), F.count_if(F.col("kind") == "segment").alias("segments"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def drop(spark: SparkSession, path: str) -> None:
    """Remove the index: its manifest first, so that a drop that stops half-way leaves no index."""
    _state(spark, path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in ("manifest", "segments", "tombstones", ""):
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path), True)
