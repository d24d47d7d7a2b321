"""Clashing names, hot rows and wide values: faults found in review stay mended."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from tidepool.llm import bitslice, decontaminate, jaccard, kdshards, licences, pseudonyms, quality, toxicity, urlrules
from tidepool.sources.tables import load

INNER = ("_key", "_row", "_host", "_path", "_n", "_w", "_o", "_first", "_rest", "_run", "key", "rest", "toxicity", "n_words", "items", "n_replaced", "at")


def clashing(df):
    for i, c in enumerate(n for n in INNER if n not in df.columns):
        df = df.withColumn(c, F.lit(0.5 + i))
    return df


def test_columns_with_inner_names_are_kept(spark):
    docs = clashing(load(spark, SF_SMALL, "documents").limit(40).select("doc_id", "text"))
    pages = clashing(load(spark, SF_SMALL, "pages").limit(40).select("page_id", "url"))
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    done = [licences.scan(docs, licences.known_table(spark)), decontaminate.decontaminate(docs, load(spark, SF_SMALL, "benchmark")).drop("items", "n_words"),
            kdshards.shard(docs, 3, F.lit(1), {"d": F.length("text")}, [F.col("doc_id")]), jaccard.keep_first(docs, 5, 80, 100), urlrules.judge(pages, rules)]
    for out in done:
        for c in (n for n in INNER if n in out.columns):
            i = [n for n in INNER].index(c)
            assert {r[0] for r in out.select(c).distinct().collect()} == {0.5 + i}, c


def test_pipeline_stages_keep_the_callers_columns(spark):
    docs = clashing(load(spark, SF_SMALL, "documents").limit(60))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        assert {r[0] for r in out.select("n_words").distinct().collect()} == {0.5 + INNER.index("n_words")}
        assert stage(spark, docs.limit(0), SF_SMALL).collect() == []


def test_many_equal_rows_are_divided(spark):
    rows = spark.range(4800, numPartitions=6).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    out = kdshards.shard(rows, 24, kdshards.size_of(F.col("text")), {"size": kdshards.size_of(F.col("text"))}, [F.col("doc_id")])
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) <= 1.05 * 200 and min(sizes) >= 0.95 * 200
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots)


def test_the_labelled_sample_has_one_text_of_an_id(spark):
    docs = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert quality.labelled_sample(docs, labels, "quality", 100) == (["t0"], [1])


def test_long_words_teach_whole():
    s = toxicity.Settings()
    word = "a" * 30 + "splendidinsult" + "b" * 9
    forms = toxicity.forms_of([word], s)
    assert all(len(f) <= s.longest for f in forms) and any("splendid" in f for f in forms) and set("".join(forms)) == set(word)


def test_long_local_parts_are_replaced_whole():
    local = "q" * 90
    seen = pseudonyms.Pseudonyms(b"key").spans(f"x {local}@example.com y") if hasattr(pseudonyms, "Pseudonyms") else None
    if seen is None:
        cls = next(c for c in vars(pseudonyms).values() if isinstance(c, type) and hasattr(c, "spans"))
        seen = cls(b"key").spans(f"x {local}@example.com y")
    assert seen == [(2, 2 + 90 + len("@example.com"), "email")]


def test_wide_components_are_scored_exactly():
    rng = np.random.default_rng(1)
    x = rng.integers(-1 << 30, 1 << 30, (60, 4))
    rows = pd.DataFrame({"rb": 0, "d": 4, "row": range(60), "vec_id": range(60), "v": x.tolist()})
    got = bitslice.search_block(rows.iloc[:5], bitslice.index_block(rows), 3)
    for q in range(5):
        want = sorted(((-sum(int(a) * int(b) for a, b in zip(x[q], x[i])), i) for i in range(60) if i != q))[:3]
        assert [(-s, i) for s, i in zip(got[got.query_id == q].score, got[got.query_id == q].vec_id)] == want


def test_slices_are_bounded_and_whole():
    lists = [[1] * n for n in (5, 700_000, 0, 300_000, 300_000, 2)] + [[]] * 5000
    b = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int64()))], names=["set_id", "cells"])
    parts = list(jaccard._slices(b.slice(1), 1))
    assert sum(p.num_rows for p in parts) == len(lists) - 1 and [p.column(0)[0].as_py() for p in parts] == sorted(p.column(0)[0].as_py() for p in parts)
    assert all(p.num_rows <= jaccard.SLICE_ROWS + 1 for p in parts)
    # a slice holds what fits, and at most one list that is longer
    assert all(len(p.column(1).flatten()) <= jaccard.SLICE + 700_000 for p in parts) and len(parts) > 3
