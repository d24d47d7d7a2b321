"""Index, readers, streams and skew-proof operators: brute force, restarts, and what is read."""

import json
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidepool.functions.text import tokens, word_count, words
from tidepool.operators import _postings
from tidepool.operators import catalog as C
from tidepool.operators import chains, keyindex, ordered, quantiles, rangejoin, search, textindex
from tidepool.operators import snapshot as B
from tidepool.session import work_path
from tidepool.sources import jsonarray, jsonio
from tidepool.sources.tables import load
from tidepool.streaming import appended
from tidepool.streaming import ingest as S


# --- segmented index -----------------------------------------------------------

def ranked(df):
    return [(r[0], round(r[1], 6)) for r in df.collect()]


def test_index_ranks_like_a_search_over_what_is_left(spark):
    rng, live, path = random.Random(4), {}, work_path(spark, "t_index")
    textindex.create(spark, path)
    with pytest.raises(ValueError):
        textindex.create(spark, path)
    assert textindex.search(spark, path, "a").collect() == [] and textindex.documents(spark, path).count() == 0
    for turn in range(4):
        rows = [(f"d{rng.randrange(40)}", rng.choice([None, "", " ".join(rng.choices("abcdefg", k=rng.randrange(1, 9)))])) for _ in range(15)]
        rows = list({i: (i, t) for i, t in rows}.values())
        textindex.append(textindex.column_documents(spark.createDataFrame(rows, "id string, text string"), "id", ["text"]), path)
        live.update(rows)
        gone = [f"d{rng.randrange(40)}" for _ in range(4)] + ["none"]
        assert textindex.delete(spark, path, spark.createDataFrame([(g,) for g in gone], "_id string")) == len({*gone} & {*live})
        for g in gone:
            live.pop(g, None)
        docs = spark.createDataFrame(list(live.items()), "doc_id string, text string").fillna("")
        want = ranked(search.match(docs, "A b zz", k=50))
        assert ranked(textindex.search(spark, path, "A b zz", k=50)) == want
        assert ranked(textindex.search(spark, path, "A b zz", k=3, offset=2)) == want[2:5]
        if turn % 2:
            textindex.compact(spark, path)
            assert ranked(textindex.search(spark, path, "A b zz", k=50)) == want
    assert {r[0] for r in textindex.documents(spark, path).collect()} == set(live)
    root = path.rsplit("/", 1)[0]
    assert textindex.listing(spark, root).filter(F.col("index") == path.rsplit("/", 1)[1]).first()["docs"] == len(live)
    textindex.drop(spark, path)
    assert not textindex.exists(spark, path)


def test_a_segment_has_a_block_for_a_term_and_run_of_documents(spark, tmp_path, monkeypatch):
    """Findings F1 to F4: postings are counted where the documents lie, not as rows that are shuffled and sorted."""
    rows = [("a", "The the  cat"), ("a", "a dog"), (None, "the"), ("b", None), ("c", "\u0130stanbul ?! na\u00efve-\u4e2d 42"), ("d", " the"), ("e", "..")]
    rows += [(f"n{i}", "the " * (i % 3 + 1) + f"w{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string")
    path, docs = work_path(spark, "t_blocks"), textindex.column_documents(df.withColumn("lang", F.lit("en")), "id", ["text", "lang"])
    textindex.create(spark, path)
    textindex.append(docs.coalesce(1), path)
    [name] = {r["name"] for r in textindex._state(spark, path) if r["kind"] == "segment"}
    blocks = spark.read.parquet(f"{path}/segments/{name}/postings").collect()
    assert [len(r["ids"]) for r in blocks if r["term"] == "the"] == [61]  # "a dog" is the greater text of a
    kept = df.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    want = Counter((r[0], w) for r in kept.select("id", tokens("text")).collect() for w in r[1])
    assert {(i, r["term"]): tf for r in blocks if r["field"] == "text" for i, tf in zip(r["ids"], r["tfs"])} == want
    lengths = Counter(i for i, _ in want.elements())
    assert all(lengths[i] == dl for r in blocks if r["field"] == "text" for i, dl in zip(r["ids"], r["dls"]))
    assert [(r["field"], r["term"]) for r in blocks] == sorted((r["field"], r["term"]) for r in blocks)
    assert textindex.documents(spark, path).count() == 65

    monkeypatch.setattr(_postings, "RUN", 40)
    batch = pa.RecordBatch.from_pylist([{"_id": i, "field": "text", "words": t} for i, t in (("x", "a b a"), ("y", "b " * 50 + "c"), ("z", "c"))])
    out = [r for b in _postings.blocks([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert len({tuple(r["ids"]) for r in out}) == 3 and {(i, r["term"], tf, dl) for r in out for i, tf, dl in zip(r["ids"], r["tfs"], r["dls"])} == {
        ("x", "a", 2, 3), ("x", "b", 1, 3), ("y", "b", 50, 51), ("y", "c", 1, 51), ("z", "c", 1, 1)}


def test_words_are_the_tokens_with_one_space(spark):
    rows = [("",), (None,), (" a  b\t",), ("\u0130\u00c4 x1-\u00df \u4e2d\u6587",), ("..",), ("\U0001d400 \u00a0q\u0301r",)]
    for r in spark.createDataFrame(rows, "t string").select(tokens("t"), words("t").alias("w"), word_count(words("t"))).collect():
        assert (r[0], r[2]) == ((r["w"].split(" ") if r["w"] else []), len(r[0])) if r["w"] is not None else r[0] is None


# --- key index -----------------------------------------------------------------

def test_a_lookup_opens_few_files(spark):
    path, index = work_path(spark, "t_keys"), work_path(spark, "t_key_index")
    df = spark.range(20_000).select((F.col("id") * 7).alias("k"), "id").unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k long, id long"))
    df.repartition(20, "k").write.parquet(path)
    keyindex.build(spark, path, index, "k")
    found = keyindex.lookup(spark, path, index, "k", [70, 7 * 19_999, 3, None])
    assert sorted(r["id"] for r in found.collect()) == [10, 19_999]
    assert len(found.inputFiles()) <= 4 < len(spark.read.parquet(path).inputFiles())
    assert keyindex.lookup(spark, path, index, "k", [-5]).collect() == []
    # files added after the build are opened, too
    spark.createDataFrame([(70, -1)], "k long, id long").write.mode("append").parquet(path)
    assert sorted(r["id"] for r in keyindex.lookup(spark, path, index, "k", [70]).collect()) == [-1, 10]


# --- one large JSON array --------------------------------------------------------

AWKWARD = ["plain", "}", "{[", '"', "\\", '\\"}', "},{", "]", "line\nbreak", "é😀", "\\\\", '"}"', ""]


def test_a_json_array_is_read_in_ranges(spark, tmp_path):
    rng = random.Random(2)
    docs = [{"i": i, "s": "".join(rng.choices(AWKWARD, k=3)), "n": {"a": [{"x": rng.choice(AWKWARD)}, [1, {}]], "}": {}}} for i in range(400)]
    (tmp_path / "one.json").write_text(json.dumps(docs[:390], indent=1, ensure_ascii=False))
    (tmp_path / "two.json").write_text(" \n" + json.dumps(docs[390:]) + "\n")
    (tmp_path / "none.json").write_text("[ ]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = jsonarray.objects(spark, str(tmp_path))
        got = sorted((json.loads(r["value"]) for r in read.collect()), key=lambda d: d["i"])
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == docs and tasks > 10


@pytest.mark.parametrize("text", ['{"a": 1}\n{"a": 2}', '[{"a": 1}, {"a": 2}', '[1, 2]', '[{"a": 1}, 5]', '[{"a": 1}] x'])
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="not an array of objects"):
        jsonarray.objects(spark, str(tmp_path)).collect()


# --- streams -----------------------------------------------------------------------

def test_an_ingest_that_stops_between_its_writes_repeats_nothing(spark, monkeypatch):
    folder, sink, ckpt = (work_path(spark, x) for x in ("t_lines", "t_sink", "t_ckpt"))
    spark.createDataFrame([('{"a": 1}',), ("{cut",), ('{"a": "x"}',), ('{"a": null}',)], "value string").coalesce(1).write.text(folder)
    whole, writes = S.split_values, []

    def failing(batch, schema):
        rows, rejects = whole(batch, schema)
        writes.append(1)
        return rows, (rejects.select(F.raise_error(F.lit("stopped")).alias("value")) if len(writes) == 1 else rejects)

    monkeypatch.setattr(S, "split_values", failing)
    with pytest.raises(Exception):
        S.ingest_with_rejects(S.follow_text(spark, folder), "a long", sink, ckpt)
    for _ in range(2):
        S.ingest_with_rejects(S.follow_text(spark, folder), "a long", sink, ckpt)
    rows, rejects = S.ingested(spark, sink, "a long")
    assert sorted((r["a"] for r in rows.collect()), key=str) == [1, None]
    assert sorted(r["value"] for r in rejects.collect()) == ['{"a": "x"}', "{cut"] and len(writes) >= 2


def test_appended_lines_are_followed_across_restarts(spark, tmp_path):
    folder, sink, ckpt = tmp_path / "logs", work_path(spark, "t_app"), work_path(spark, "t_app_ckpt")
    folder.mkdir()

    def run(range_bytes=7):
        S.ingest(appended.follow(spark, str(folder), range_bytes), sink, ckpt)
        return sorted((r["file"], r["at"], r["value"]) for r in spark.read.parquet(sink).collect())

    (folder / "a").write_text("one\ntwo two two two\nhal")
    (folder / "b").write_text("")
    want = [("a", 0, "one"), ("a", 4, "two two two two")]
    assert run() == want and run() == want
    with open(folder / "a", "a") as f:
        f.write("f é\n\nlast\n")
    (folder / "b").write_text("x\n" * 9)
    want += [("a", 20, "half é"), ("a", 28, ""), ("a", 29, "last")] + [("b", 2 * i, "x") for i in range(9)]
    assert run() == sorted(want) and run(1000) == sorted(want)


# --- hot keys ------------------------------------------------------------------------

def test_windows_over_a_hot_key_spread(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None, "z"]), rng.randrange(300), rng.randrange(-5, 9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, part long").withColumn("rank", F.lit("clash"))
    out = ordered.running(df, ["k"], ["o"], {"total": F.col("part")}, partitions=12)
    got = Counter((r["k"], r["o"], r["part"], r["rank"], r["dense_rank"], r["total"]) for r in out.collect())
    want = Counter()
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        distinct = sorted({r[1] for r in mine})
        for _, o, p in mine:
            want[k, o, p, 1 + sum(r[1] < o for r in mine), 1 + distinct.index(o), sum(r[2] for r in mine if r[1] <= o)] += 1
    assert got == want
    numbers = {}
    for r in out.collect():
        numbers.setdefault(r["k"], []).append(r["row_number"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in numbers.values())
    assert ordered.running(df.limit(0), ["k"], ["o"]).collect() == []


@pytest.mark.parametrize("ranked_most", [3, 10_000])
def test_percentiles_by_selection(spark, ranked_most):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.5, rng.gauss(0, 1e9), rng.random(), 1e300, -1e300])) for _ in range(700)]
    rows += [("one", 5.0), ("nan", float("nan")), ("null", None)] + [("same", 3.0)] * 50
    shares = [0, 0.1, 0.5, 0.99, 1]
    got = {(r["g"], r["p"]): r["value"] for r in quantiles.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, ranked_most).collect()}
    for g in ("a", "b", None, "one", "same"):
        v = sorted(x for k, x in rows if k == g)
        for p in shares:
            at = p * (len(v) - 1)
            a, b = v[math.floor(at)], v[math.ceil(at)]
            assert got.pop((g, p)) == pytest.approx(a + (b - a) * (at - math.floor(at)))
    assert not got


def test_a_long_chain_takes_few_rounds(spark):
    links = [(i, i + 1 if i < 4999 else None) for i in range(5000)] + [(10_000, None), (10_001, 10_002), (10_002, None)]
    out, rounds = chains.ends(spark.createDataFrame(links, "node long, next long"))
    got = {r["node"]: (r["end"], r["steps"]) for r in out.collect()}
    assert rounds <= 14 and got == {i: (4999, 4999 - i) for i in range(5000)} | {10_000: (10_000, 0), 10_001: (10_002, 1), 10_002: (10_002, 0)}
    with pytest.raises(ValueError):
        chains.ends(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "node long, next long"))


def test_range_join_of_long_intervals_and_crowded_points(spark):
    rng = random.Random(9)
    points = [(i, rng.choice([7, 7, 7, rng.randrange(-5000, 5000), None])) for i in range(300)]
    spans = [(j, *sorted((rng.randrange(-5000, 5000), rng.randrange(-5000, 5000)))) for j in range(40)] + [
        (90, -10**17, 10**17), (91, 7, 7), (92, 9, 8), (93, None, 5), (94, -1, 256), (95, 16, 31), (96, 0, 15)]
    out = rangejoin.range_join(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "s int, low long, high long"), "at", "low", "high")
    want = sorted((p, s) for p, at in points for s, low, high in spans if at is not None and low is not None and low <= at <= high)
    assert sorted((r["p"], r["s"]) for r in out.collect()) == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_a_crowded_cell_is_dealt_over_tasks(spark, monkeypatch):
    """Finding F5: a task sorts no more points the more there are, also where they share a cell or are alike."""
    monkeypatch.setattr(rangejoin, "SLICE", 50)
    monkeypatch.setattr(rangejoin, "TASK", 200)
    points = spark.range(3000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 300).otherwise(7).alias("at"), F.lit("x").alias("v")) \
        .unionByName(spark.createDataFrame([(None, "x")], "at long, v string"))
    spans = spark.createDataFrame([(1, 0, 299), (2, 7, 7), (2, 7, 7), (3, 0, 15), (4, 8, 3), (5, -10**12, 10**12)], "s int, low long, high long")
    joined = rangejoin.range_join(points, spans, "at", "low", "high")
    places = [r["at"] for r in points.collect() if r["at"] is not None]
    want = Counter({s: n for s, low, high in {tuple(r) for r in spans.collect()} if (n := sum(low <= p <= high for p in places))})
    want[2] *= 2
    assert Counter({r["s"]: r["count"] for r in joined.groupBy("s").count().collect()}) == want
    spread = [r["count"] for r in joined.filter("s = 2").groupBy(F.spark_partition_id()).count().collect()]
    assert len(spread) > 8 and max(spread) < want[2] / 3, spread


# --- snapshots, documents, catalog -----------------------------------------------------

def test_equal_folders_are_not_read(spark):
    a = spark.range(5000).select("id", (F.col("id") % 7).alias("v")).unionByName(spark.createDataFrame([(1, 1)] * 300, "id long, v long"))
    b = a.filter("id != 77").unionByName(spark.createDataFrame([(1, 1)], "id long, v long"))
    paths = [work_path(spark, "t_tree") for _ in "ab"]
    for df, path in zip((a, b), paths):
        B.write_tree(df, path)
    assert sorted(tuple(r) for r in B.diff_tree(spark, *paths).collect()) == [(1, 1, "right_only"), (77, 0, "left_only")]
    assert B.unequal(spark, *paths).count() == 2
    plan = B.diff_tree(spark, *paths)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert B.diff_tree(spark, paths[0], paths[0]).collect() == []


def test_an_expiry_that_stopped_is_finished(spark, monkeypatch):
    root = work_path(spark, "t_expire")
    for sid, at in (("old", "2024-01-01"), ("older", "2023-01-01"), ("new", "2024-02-01")):
        B.backup(spark, {"n": spark.range(3)}, root, "db", snapshot_id=sid, created=F.lit(at))
    now = F.lit("2024-02-02").cast("timestamp")
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda sid: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{sid}"))
    # only marked: no reader sees them, their folders are still there
    B.expired(B.manifest(spark, root), now).select("snapshot_id", F.lit("marked").alias("state"), F.current_timestamp().alias("at")) \
        .write.mode("append").parquet(f"{root}/_retired")
    assert there("old") and [r["snapshot_id"] for r in B.manifest(spark, root).collect()] == ["new"]
    with pytest.raises(ValueError):
        B.restore(spark, root, "old", "nowhere")
    for _ in range(2):
        assert [r["snapshot_id"] for r in B.expire(spark, root, now).collect()] == ["new"]
        assert there("new") and not there("old") and not there("older")


def test_mixed_fields_lose_nothing(spark):
    path = work_path(spark, "t_mixed")
    texts = ['{"f": 1}', '{"f": "1"}', '{"f": {"x": 2}}', '{"f": 1.5}', '{"f": true}', '{"f": null}', "{}"]
    jsonio.insert_mixed(spark.createDataFrame([(t,) for t in texts], "j string"), "j", path)
    docs = spark.read.parquet(path)
    got = docs.select(F.to_json("doc").alias("j"), *[jsonio.mixed_field("$.f", k).alias(k) for k in ("bigint", "string", "double", "boolean")]).collect()
    assert sorted(json.dumps(json.loads(r["j"])) for r in got) == sorted(json.dumps(json.loads(t)) for t in texts)
    by = {r["j"]: tuple(r)[1:] for r in got}
    assert by['{"f":1}'] == (1, None, 1.0, None) and by['{"f":"1"}'] == (None, "1", None, None) and by['{"f":1.5}'] == (None, None, 1.5, None)
    assert by['{"f":true}'] == (None, None, None, True) and by['{"f":{"x":2}}'] == (None,) * 4
    assert "VARIANT" in jsonio.mixed_schema(docs).first()["type"]


def test_databases_outlive_a_session(spark):
    root = work_path(spark, "t_dbs")
    C.create_db(spark, "t_outlive", owner="ana", location=f"{root}/t_outlive")
    C.describe_db(spark, "t_outlive", "ana", f"{root}/t_outlive")
    load(spark, SF_SMALL, "nation").write.saveAsTable("t_outlive.nation")
    path = spark.table("t_outlive.nation").inputFiles()
    # another session's catalog knows neither; the files are there
    spark.sql("ALTER TABLE t_outlive.nation SET TBLPROPERTIES ('EXTERNAL' = 'TRUE')") if not path else None
    copy = f"{root}2/t_again"
    spark.table("t_outlive.nation").write.parquet(f"{copy}/nation")
    C.describe_db(spark, "t_again", "ana", copy)
    assert C.attach(spark, f"{root}2") == ["t_again"] and spark.table("t_again.nation").count() == 25
    assert "ana" in str(C.db_properties(spark, "t_again").collect()) and C.attach(spark, f"{root}2") == ["t_again"]
    assert np.array(path).size == 1
