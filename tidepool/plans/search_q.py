"""Registered search queries (Q02, Q08, Q09) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, textindex
from ..session import work_path
from ..sources.tables import load

# The query strings the registered searches run.
INDEX_QUERY = "the osbo ea nen"
BM25_QUERY = "The schst osbo eaure"
PAGED_QUERY = "the osbo en src3"


def match_bm25(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return search.match(docs, BM25_QUERY, field="text", k=10,
                        stage_path=work_path(spark, "bm25_counts"))


def match_paged(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return search.match_paged(docs, PAGED_QUERY, fields=["text", "lang", "source"],
                              start=0, size=20, stage_path=work_path(spark, "bm25_counts"))


def match_page2(spark, sf_dir):
    """Q09 from the second page of twenty."""
    docs = load(spark, sf_dir, "documents")
    return search.match_paged(docs, PAGED_QUERY, fields=["text", "lang", "source"],
                              start=20, size=20, stage_path=work_path(spark, "bm25_counts"))


def match_index(spark, sf_dir):
    """Q08 through a postings index written once; must equal ``match_bm25``."""
    path = work_path(spark, "postings")
    search.build_index(load(spark, sf_dir, "documents"), path, buckets=16)
    return search.match_index(spark, path, BM25_QUERY, k=10)


def match_all(spark, sf_dir):
    return search.match_all(load(spark, sf_dir, "documents"), size=10)


def _three_appends(spark, sf_dir):
    """An index of the documents in three segments, the German ones deleted again, some
    French ones written twice."""
    path = work_path(spark, "text_index")
    docs = load(spark, sf_dir, "documents")
    textindex.create(spark, path)
    for part in range(3):
        mine = docs.filter(F.pmod("doc_id", F.lit(3)) == part)
        if part == 2:  # replaced: the same ids once more
            mine = mine.unionByName(docs.filter((F.col("lang") == "fr") & (F.pmod("doc_id", F.lit(3)) == 0)))
        textindex.append(textindex.column_documents(mine, "doc_id", ["text", "lang"]), path)
    textindex.delete(spark, path, docs.filter("lang = 'de'").select(F.col("doc_id").alias("_id")))
    return path


def _by_doc(ranked):
    return ranked.select(F.col("_id").cast("bigint").alias("doc_id"), "score")


def index_search(spark, sf_dir):
    """S09 + Q08: index, replace, delete, then search over the live segments."""
    return _by_doc(textindex.search(spark, _three_appends(spark, sf_dir), INDEX_QUERY, k=25))


def index_delete(spark, sf_dir):
    """The same after compaction, less what is deleted from the one segment that is left."""
    path = _three_appends(spark, sf_dir)
    textindex.compact(spark, path)
    short = load(spark, sf_dir, "documents").filter("n_chars < 500").select(F.col("doc_id").alias("_id"))
    textindex.delete(spark, path, short)
    return _by_doc(textindex.search(spark, path, INDEX_QUERY, k=25))


def index_list(spark, sf_dir):
    """The indexes with their documents and segments."""
    root = work_path(spark, "indexes")
    docs = load(spark, sf_dir, "documents")
    for lang in ("en", "fr"):
        textindex.create(spark, f"{root}/docs_{lang}")
        for part in (docs.filter("n_chars < 1000"), docs.filter("n_chars >= 1000")):
            textindex.append(textindex.column_documents(part.filter(F.col("lang") == lang), "doc_id", ["text"]), f"{root}/docs_{lang}")
    textindex.compact(spark, f"{root}/docs_fr")
    return textindex.listing(spark, root).select("index", "docs", "segments", (F.col("bytes") > 0).alias("has_bytes"))


def _bm25_sql(text_expr: str, terms: list[str], k: int, offset: int = 0, where: str = "true", order: str = "doc_id") -> str:
    tfs = ",\n       ".join(
        f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"CAST(count(*) FILTER (WHERE tf{i} > 0) AS DOUBLE) AS df{i}"
                    for i in range(len(terms)))
    parts = " + ".join(
        f"(CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i}"
        f" / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END)"
        for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""
WITH tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower({text_expr}), '[^\\p{{L}}\\p{{N}}]+'),
                             lambda x: x <> '') AS t
  FROM documents WHERE {where}
), d AS (
  SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl,
       {tfs}
  FROM tok
), s AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) FILTER (WHERE dl > 0) AS avgdl, {dfs} FROM d
), scored AS (
  SELECT doc_id, {parts} AS score FROM d, s WHERE {hit}
)
SELECT doc_id, round(score, 6) AS score FROM scored
ORDER BY score DESC, {order} LIMIT {k} OFFSET {offset}
"""


QUERIES = {
    "match_bm25": match_bm25,
    "match_paged": match_paged,
    "match_page2": match_page2,
    "match_index": match_index,
    "match_all": match_all,
    "index_search": index_search,
    "index_delete": index_delete,
    "index_list": index_list,
}

ORACLE = {
    "match_bm25": _bm25_sql("text", ["the", "schst", "osbo", "eaure"], 10),
    "match_paged": _bm25_sql("concat_ws(' ', text, lang, source)",
                             ["the", "osbo", "en", "src3"], 20),
    "match_page2": _bm25_sql("concat_ws(' ', text, lang, source)",
                             ["the", "osbo", "en", "src3"], 20, 20),
    "match_index": _bm25_sql("text", ["the", "schst", "osbo", "eaure"], 10),
    "index_search": _bm25_sql("text", ["the", "osbo", "ea", "nen"], 25, where="lang <> 'de'", order="CAST(doc_id AS VARCHAR)"),
    "index_delete": _bm25_sql("text", ["the", "osbo", "ea", "nen"], 25, where="lang <> 'de' AND n_chars >= 500",
                              order="CAST(doc_id AS VARCHAR)"),
    "index_list": "SELECT 'docs_' || lang AS index, count(*) AS docs, CASE lang WHEN 'en' THEN 2 ELSE 1 END::BIGINT AS segments, "
                  "true AS has_bytes FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang",
    "match_all": "SELECT doc_id, 1.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 10",
}
