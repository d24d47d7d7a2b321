"""Edge cases per operator: empty input, NULLs, ties, unicode, duplicates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.functions.text import tokens
from tidepool.operators import catalog as C
from tidepool.operators import docquery as Q
from tidepool.operators import search
from tidepool.operators import snapshot as B
from tidepool.operators import tableops as T
from tidepool.session import work_path
from tidepool.sources import jsonio, logs
from tidepool.streaming import ingest as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# --- document queries -----------------------------------------------------------

def test_find_gte_gt_and_missing_or_non_numeric(spark):
    df = spark.createDataFrame(
        [("alice", "30"), ("bob", "25"), ("carol", None), ("dan", "n/a")], "name string, age string")
    assert rows(Q.find_gte(df, "age", 25), "name") == [("alice",), ("bob",)]
    assert rows(Q.find_gt(df, "age", 25), "name") == [("alice",)]


def test_find_one_first_or_none(spark):
    df = spark.createDataFrame([(3, "a@x"), (1, "a@x"), (2, "b@x")], "id int, email string")
    assert rows(Q.find_one(df, "email", "a@x", "id")) == [(1, "a@x")]
    assert Q.find_one(df, "email", "zz", "id").count() == 0


def test_count_docs_empty_and_all(spark):
    df = spark.createDataFrame([], "id int")
    assert Q.count_docs(df).first()["n"] == 0
    df = spark.range(5)
    r = Q.count_docs(df, named={"all": None, "big": F.col("id") > 2}).first()
    assert (r["all"], r["big"]) == (5, 2)


def test_top_k_sorts_before_limit_nulls_lowest(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9), (4, 9)], "id int, ts int")
    assert [r["id"] for r in Q.top_k(df, "ts", 3, "id").collect()] == [3, 4, 1]


def test_slow_ops_threshold_is_strict(spark):
    ops = spark.createDataFrame([(1, 100.0, 1), (2, 100.5, 2), (3, 250.0, 2)],
                                "op_id int, millis double, ts int")
    assert [r["op_id"] for r in Q.slow_ops(ops).collect()] == [3, 2]


# --- search -------------------------------------------------------------------

def test_tokens_unicode_and_punctuation(spark):
    df = spark.createDataFrame([("Ça-va? Ünïcode_test 42",)], "t string")
    assert df.select(tokens("t").alias("x")).first()["x"] == \
        ["ça", "va", "ünïcode", "test", "42"]


def test_bm25_ties_and_duplicate_terms(spark):
    docs = spark.createDataFrame([(2, "apple pie"), (1, "apple pie"), (3, "banana")],
                                 "doc_id long, text string")
    out = search.match(docs, "apple APPLE", k=10).collect()
    assert [r["doc_id"] for r in out] == [1, 2]
    assert out[0]["score"] == out[1]["score"] > 0


def test_bm25_empty_query_is_an_error(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        search.match(docs, " ?! ")


def test_star_is_match_all_but_not_special_when_paged(spark):
    docs = spark.createDataFrame([(2, "a"), (1, "b")], "doc_id long, text string")
    assert [tuple(r) for r in search.match(docs, "*").collect()] == [(1, 1.0), (2, 1.0)]
    assert search.match_paged(docs, "*", fields=["text"]).count() == 0


# --- dataflows ------------------------------------------------------------------

def test_count_by_desc_ties_by_key(spark):
    df = spark.createDataFrame([("b x",), ("a y",), ("b z",), ("  a",), ("",)], "line string")
    out = T.count_by_desc(df, T.first_field("line")).collect()
    assert [(r["key"], r["n"]) for r in out] == [("a", 2), ("b", 2), ("", 1)]


def test_latest_row_tie_on_ts_takes_larger_id(spark):
    df = spark.createDataFrame([("g", 5, 1, "x"), ("g", 5, 2, "y"), ("h", 1, 3, "z")],
                               "g string, ts int, id int, name string")
    out = rows(T.latest_row(df, "ts", "id", ["name"], by=["g"]), "g", "name")
    assert out == [("g", "y"), ("h", "z")]


def test_label_selector_all_pairs_and_missing_key(spark):
    df = spark.createDataFrame([({"app": "a", "c": "w"},), ({"app": "a"},), (None,)],
                               "labels map<string,string>")
    assert T.label_select(df, "labels", "app=a, c=w").count() == 1
    assert T.label_select(df, "labels", "app=a").count() == 2
    with pytest.raises(ValueError):
        T.parse_selector("app")


def test_phase_filter_null_handling(spark):
    df = spark.createDataFrame([("Failed",), ("Running",), (None,)], "phase string")
    assert T.phase_filter(df, "phase", ["Failed", "Unknown"]).count() == 1
    assert T.phase_filter(df, "phase", ["Failed", "Unknown"], keep_null=True).count() == 2


def test_array_find_empty_and_no_match(spark):
    df = spark.createDataFrame([([],), ([("http", 80), ("x", 30080)],), ([("http", 1)],)],
                               "ports array<struct<name:string,nodePort:int>>")
    out = [r["p"] for r in df.select(T.array_find("ports", "name", "x", "nodePort").alias("p"))
           .collect()]
    assert sorted(out, key=lambda v: (v is None, v)) == [30080, None, None]


def test_list_validate_unknown_and_reverse(spark):
    df = spark.createDataFrame([("ingest, store ,query,, bogus",), ("",)], "s string")
    out = T.list_validate(df, "s", ["ingest", "store", "query"]).collect()
    got = {tuple(r["items"]): (r["unknown"], r["reversed"]) for r in out}
    assert got[("ingest", "store", "query", "bogus")] == \
        (["bogus"], ["bogus", "query", "store", "ingest"])
    assert got[()] == ([], [])


def test_text_replace_literal_vs_regex(spark):
    df = spark.createDataFrame([("a.b.c 12",)], "t string")
    r = df.select(T.text_replace("t", ".", "/").alias("a"),
                  T.text_replace("t", "[0-9]", "#", regex=True).alias("b")).first()
    assert (r["a"], r["b"]) == ("a/b/c 12", "a.b.c ##")


def test_unit_div_truncates(spark):
    df = spark.createDataFrame([(5,), (-5,), (3 * 1024 ** 3 - 1,)], "x long")
    assert [r[0] for r in df.select(T.unit_div("x", 2)).collect()][:2] == [2, -2]
    assert df.select(T.unit_div(T.unit_div(T.unit_div("x", 1024), 1024), 1024)).collect()[2][0] == 2


def test_server_log_instants(spark):
    stamps = {"UTC": "2024-07-01 10:00:00", "CET": "2024-01-01 11:00:00", "CEST": "2024-07-01 12:00:00", "+03": "2024-07-01 13:00:00",
              "-05:30": "2024-07-01 04:30:00", "PDT": "2024-07-01 03:00:00", "QQQ": "2024-07-01 10:00:00"}
    tail = "[7]: [1-1] user=u,db=,app=a b,client=10.0.0.1 LOG:  x, y=1"
    rows = [(f"{t} {z} {tail}",) for z, t in stamps.items()] + [(f"{stamps['UTC']} UTC {tail}".replace("user=u", "user=u\nv"),), (None,)]
    lines = spark.createDataFrame(rows, "value string")
    parsed, rejects = T.parse_server_log(lines)
    got = {r["zone"]: r for r in parsed.selectExpr("*", "cast(instant as string) AS at").collect()}
    assert {z: r["at"] for z, r in got.items()} == {z: None if z == "QQQ" else "2024-01-01 10:00:00" if z == "CET" else "2024-07-01 10:00:00" for z in stamps}
    assert all((r["user"], r["db"], r["app"], r["client"], r["message"]) == ("u", None, "a b", "10.0.0.1", "LOG:  x, y=1") for r in got.values())
    assert sorted(map(str, (r["value"] for r in rejects.collect()))) == sorted(map(str, (v for v, in rows[-2:])))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan


def test_server_log_parse_edge_cases(spark):
    lines = spark.createDataFrame([
        ("2024-01-02 03:04:05 UTC [42]: [7-1] user=,db=app,app=,client=10.0.0.1 "
         "LOG:  statement: UPDATE t SET a=1, b=2",),
        ("2024-01-02 03:04:06 UTC [43]: [8-1] user=bob,db=shop,app=psql,client=::1 ERROR: x",),
        ("\tcontinuation",), (None,)], "value string")
    parsed, rejects = T.parse_server_log(lines)
    p = sorted(parsed.collect(), key=lambda r: r["line"])
    assert p[0]["user"] is None and p[0]["app"] is None and p[0]["pid"] == 42
    assert p[0]["message"] == "LOG:  statement: UPDATE t SET a=1, b=2"
    assert p[1]["ts"] == dt.datetime(2024, 1, 2, 3, 4, 6) and p[1]["client"] == "::1"
    assert rejects.count() == 2


# --- snapshots ------------------------------------------------------------------

def test_checksum_is_order_insensitive_and_null_aware(spark):
    a = spark.createDataFrame([(1, None), (None, 1), (2, 2)], "x int, y int")
    b = spark.createDataFrame([(2, 2), (None, 1), (1, None)], "x int, y int")
    c = spark.createDataFrame([(1, None), (1, None), (2, 2)], "x int, y int")
    assert B.same_checksum(a, b).first()["equal"]
    assert not B.same_checksum(a, c).first()["equal"]


def test_diff_is_multiset(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert rows(B.diff(a, b)) == [(1, "left_only"), (3, "right_only")]


def test_diff_repeats_nulls_and_clashing_names(spark):
    a = spark.createDataFrame([(None, 1)] * 3 + [(5, None)], "n int, runs int")
    b = spark.createDataFrame([(None, 1), (7, 7), (7, 7)], "n int, runs int")
    got = B.diff(a, b)
    assert got.columns == ["n", "runs", "side"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (None, 1, "left_only"), (None, 1, "left_only"), (5, None, "left_only"),
        (7, 7, "right_only"), (7, 7, "right_only")]))


def test_diff_row_repeated_past_one_run(spark):
    a = spark.range(B._RUN + 3).select(F.lit("x").alias("v"))
    b = spark.createDataFrame([("x",)], "v string")
    assert B.diff(a, b).count() == B._RUN + 2
    assert B.diff(a, a).count() == 0


def test_lookup_layout_splits_a_hot_key(spark):
    path = work_path(spark, "hot")
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    C.write_lookup_layout(df, path, "k", then=["id"], files=8)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).count()
    assert per_file.agg(F.max("count")).first()[0] < 6_000
    assert C.lookup(spark.read.parquet(path), "k", [7]).count() == df.filter("k = 7").count()


def test_server_log_keeps_the_zone(spark):
    rest = " [42]: [1-1] user=u,db=d,app=a,client=h LOG:  x"
    lines = spark.createDataFrame([(f"2024-01-02 03:04:05 {z}{rest}",) for z in ("UTC", "+03", "-05:30", "+3", "?")], "value string")
    parsed, rejects = T.parse_server_log(lines)
    assert sorted(r["zone"] for r in parsed.collect()) == ["+03", "-05:30", "UTC"]
    assert rejects.count() == 2


def test_retention_whole_days(spark):
    now = dt.datetime(2024, 1, 10, 0, 0, 0)
    days = [7.99, 8.0, 8.01]
    df = spark.createDataFrame([(i, now - dt.timedelta(days=d)) for i, d in enumerate(days)],
                               "id int, created timestamp_ntz")
    out = B.expired(df, now=F.lit(now).cast("timestamp_ntz"))
    assert rows(out, "id") == [(1,), (2,)]


def test_backup_restore_other_db(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    root = work_path(spark, "t_snap")
    sid = B.backup(spark, {"t": df}, root, db="src")
    C.create_db(spark, "t_restore_target", location=work_path(spark, "t_db"), if_not_exists=True)
    out = B.restore(spark, root, sid, "t_restore_target")["t"]
    assert rows(out) == [(1, "a"), (2, None)]
    with pytest.raises(Exception):
        B.restore(spark, root, sid, "t_restore_target")  # exists: refused


# --- sources --------------------------------------------------------------------

def test_json_array_roundtrip_keeps_micros(spark):
    ts = dt.datetime(2024, 1, 1, 0, 0, 7, 179575)
    df = spark.createDataFrame([(1, ts, "é"), (2, None, None)], "id long, ts timestamp_ntz, s string")
    path = work_path(spark, "t_json")
    jsonio.export_json(df.repartition(2), path, array=True)
    back = jsonio.read_json(spark, path, schema=df.schema, array=True)
    assert rows(back) == rows(df)


def test_insert_docs_schema_merge(spark):
    path = work_path(spark, "t_docs")
    jsonio.insert_docs(spark.createDataFrame([("a", 30)], "name string, age long"), path)
    jsonio.insert_docs(spark.createDataFrame([("b", "b@x")], "name string, email string"), path)
    out = jsonio.read_docs(spark, path)
    assert rows(out, "name", "age", "email") == [("a", 30, None), ("b", None, "b@x")]


def test_tail_fewer_than_n(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "ts int, seq int")
    assert [(r["ts"], r["seq"]) for r in logs.tail(df, "ts", "seq", n=50).collect()] == \
        [(1, 1), (2, 1), (3, 0)]
    assert [(r["ts"]) for r in logs.tail(df, "ts", "seq", n=2).collect()] == [2, 3]


def test_stream_restart_adds_nothing(spark):
    src = work_path(spark, "t_stream_src")
    sink, ckpt = work_path(spark, "t_sink"), work_path(spark, "t_ckpt")
    spark.range(100).selectExpr("cast(id as string) as value").write.text(src)
    for _ in range(2):
        S.ingest(S.follow_text(spark, src), sink, ckpt)
    assert spark.read.parquet(sink).count() == 100


def test_lookup_layout_equals_plain_table(spark):
    df = spark.range(0, 2000, numPartitions=4).selectExpr("id % 97 AS k", "id AS v")
    path = work_path(spark, "t_layout")
    C.write_lookup_layout(df, path, "k", files=5)
    laid = spark.read.parquet(path)
    assert rows(C.lookup(laid, "k", [3, 96, 500])) == rows(C.lookup(df, "k", [3, 96, 500]))
    keys = spark.createDataFrame([(3,), (3,), (50,)], "k long")
    assert rows(C.lookup_join(laid, keys, "k")) == rows(df.filter("k IN (3, 50)"))


def test_json_array_export_empty_partitions(spark):
    df = spark.range(0, 3, numPartitions=6).selectExpr("id", "cast(id as string) AS s")
    path = work_path(spark, "t_json_sparse")
    jsonio.export_json(df, path, array=True)
    back = jsonio.read_json(spark, path, schema=df.schema, array=True)
    assert rows(back) == rows(df)
    empty = work_path(spark, "t_json_empty")
    jsonio.export_json(df.limit(0), empty, array=True)
    assert jsonio.read_json(spark, empty, schema=df.schema, array=True).count() == 0


def test_restore_refuses_tampered_snapshot(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    root = work_path(spark, "t_snap_bad")
    sid = B.backup(spark, {"t": df}, root, db="src")
    spark.createDataFrame([(3, "c")], "id int, v string").write.mode("append") \
        .parquet(f"{root}/{sid}/t")
    C.create_db(spark, "t_restore_bad", location=work_path(spark, "t_db_bad"), if_not_exists=True)
    with pytest.raises(ValueError):
        B.restore(spark, root, sid, "t_restore_bad")


def test_import_json_infers_mixed_shapes(spark, tmp_path):
    src = tmp_path / "users.json"
    src.write_text('[{"name": "Customer#1", "segment": "BUILDING", "size": 7},\n'
                   ' {"name": "Customer#2", "phone": "11-719"}]')
    C.create_db(spark, "t_imp", location=work_path(spark, "t_imp_db"), if_not_exists=True)
    out = jsonio.import_json(spark, str(src), "t_imp.users", array=True)
    assert dict(out.dtypes)["size"] == "bigint"
    assert rows(Q.find_gte(out, "size", 5), "name") == [("Customer#1",)]


def test_csv_roundtrip_and_pushdown(spark):
    from tidepool.sources import files
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    path = work_path(spark, "t_csv")
    files.write(df, path, fmt="csv")
    back = files.scan(spark, path, fmt="csv", schema=df.schema, where=F.col("id") >= 2)
    assert rows(back) == [(2, "b"), (3, None)]


def test_bucketed_tables_join_without_shuffle(spark):
    C.create_db(spark, "t_bk", location=work_path(spark, "t_bk_db"), if_not_exists=True)
    a = spark.range(0, 1000).selectExpr("id AS k", "id * 2 AS x")
    b = spark.range(0, 1000).selectExpr("id AS k", "id * 3 AS y")
    C.write_bucketed(a, "t_bk.a", "k", 4)
    C.write_bucketed(b, "t_bk.b", "k", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("t_bk.a").join(spark.table("t_bk.b"), "k")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert j.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_load_sees_files_added_later(spark, tmp_path):
    from tidepool.sources.tables import load
    spark.range(10).write.parquet(f"{tmp_path}/t.parquet")
    assert load(spark, str(tmp_path), "t").count() == 10
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert load(spark, str(tmp_path), "t").count() == 15


def test_export_and_import_agree_by_default(spark, tmp_path):
    from tidepool.sources import jsonio
    df = spark.range(0, 150, numPartitions=4).selectExpr("id", "concat('n', id) AS name")
    jsonio.export_json(df, f"{tmp_path}/lines")
    jsonio.export_json(df, f"{tmp_path}/arrays", array=True)
    schema = "id long, name string"
    assert rows(jsonio.read_json(spark, f"{tmp_path}/lines", schema)) == rows(df)
    assert rows(jsonio.read_json(spark, f"{tmp_path}/arrays", schema, array=True)) == rows(df)
    with pytest.raises(ValueError):
        jsonio.read_json(spark, f"{tmp_path}/lines", schema, array=True)


def test_import_fails_on_malformed_or_mistyped_documents(spark, tmp_path):
    from tidepool.sources import jsonio
    for i, bad in enumerate(['{"id": 1', '{"id": "x"}']):
        (tmp_path / f"{i}.json").write_text('{"id": 1}\n' + bad + "\n")
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            jsonio.read_json(spark, f"{tmp_path}/{i}.json", "id long").collect()


def test_a_bad_document_is_rejected_not_the_batch(spark, tmp_path):
    from tidepool.sources import jsonio
    docs = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("[2]",)], "j string")
    jsonio.index_docs(docs, "j", f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i").count() == 2
    assert [r["raw"] for r in spark.read.parquet(f"{tmp_path}/i/_rejects").collect()] == ['{"a": ']


def test_run_sql_empty_query_and_named_db(spark):
    from tidepool.operators.sqlpass import run_sql
    with pytest.raises(ValueError):
        run_sql(spark, "   ")
    C.create_db(spark, "t_sqldb", location=work_path(spark, "t_sqldb_loc"), if_not_exists=True)
    spark.createDataFrame([(1,), (2,)], "x int").write.mode("overwrite").saveAsTable("t_sqldb.nums")
    out = run_sql(spark, "SELECT sum(x) AS s FROM nums", db="t_sqldb")
    assert spark.catalog.currentDatabase() == "default"
    assert out.first()["s"] == 3


def test_continuous_follow_picks_up_new_files(spark):
    src = work_path(spark, "t_follow_src")
    sink, ckpt = work_path(spark, "t_follow_sink"), work_path(spark, "t_follow_ckpt")
    spark.range(3).selectExpr("cast(id as string) AS value").write.text(src)
    q = S.write_stream(S.follow_text(spark, src), sink, ckpt, available_now=False,
                       interval="1 second")
    try:
        q.processAllAvailable()
        spark.range(3, 8).selectExpr("cast(id as string) AS value").write.mode("append").text(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(int(r["value"]) for r in spark.read.parquet(sink).collect()) == list(range(8))


def test_list_validate_known_set_as_table(spark):
    df = spark.createDataFrame([(1, "b, zz ,a, yy"), (2, "a"), (3, "")], "id int, s string")
    known = spark.createDataFrame([("a",), ("b",), ("a",)], "name string")
    out = {r["id"]: (r["items"], r["unknown"], r["reversed"])
           for r in T.list_validate(df, "s", known, id_col="id").collect()}
    assert out[1] == (["b", "zz", "a", "yy"], ["zz", "yy"], ["yy", "a", "zz", "b"])
    assert out[2] == (["a"], [], ["a"]) and out[3] == ([], [], [])
    lit = {r["id"]: r["unknown"] for r in T.list_validate(df, "s", ["a", "b"]).collect()}
    assert lit == {k: v[1] for k, v in out.items()}


def test_index_search_equals_one_shot(spark):
    docs = spark.createDataFrame(
        [(1, "apple pie, apple tart"), (2, "banana split"), (3, ""), (4, None), (5, "?!"),
         (6, "Apple and banana"), (7, "pie")], "doc_id long, text string")
    path = work_path(spark, "t_index")
    search.build_index(docs, path, buckets=4)
    for q in ["apple", "banana pie", "tart split apple"]:
        one = [tuple(r) for r in search.match(docs, q, k=5).collect()]
        idx = [tuple(r) for r in search.match_index(spark, path, q, k=5).collect()]
        assert one == idx, (q, one, idx)
    st = spark.read.parquet(f"{path}/stats").first()
    assert st["n"] == 7.0


def test_bm25_staged_counts_give_the_same_ranking(spark):
    docs = spark.createDataFrame(
        [(1, "apple pie apple"), (2, "banana"), (3, None), (4, "pie and banana pie")],
        "doc_id long, text string")
    plain = [tuple(r) for r in search.match(docs, "apple pie", k=10).collect()]
    staged = [tuple(r) for r in search.match(docs, "apple pie", k=10,
                                             stage_path=work_path(spark, "t_bm25_stage"))
              .collect()]
    assert plain == staged and len(plain) == 2
