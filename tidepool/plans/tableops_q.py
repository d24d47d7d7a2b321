"""Registered dataflow queries (D01-D15) and their DuckDB oracles.

Inputs are the given tables or rows Spark derives from them per row (arrays,
label maps, log lines), never a fixed literal input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import tableops as T
from ..sources.tables import load

# Parameters of the registered queries.
SELECTOR = "app=purchase,k=69"
DELETED_PHASES = ("error", "signup")
KNOWN_HOST_LABELS = ("m", "blog", "www", "example", "com", "org", "net")
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HOST_RE = r"^[A-Za-z]+://([^/:?#]+)"


def count_by_desc(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select(
        F.explode(F.split("text", "\n")).alias("line"))
    return T.count_by_desc(lines, T.first_field("line"), "key")


def top_metric(spark, sf_dir):
    return T.top_metric(load(spark, sf_dir, "orders"), "o_totalprice", 10, "o_orderkey") \
        .select("o_orderkey", "o_custkey", "o_totalprice")


def latest_row(spark, sf_dir):
    return T.latest_row(load(spark, sf_dir, "events"), "ts", "event_id", ["user_id"],
                        by=["event_type"])


def _labels(ev: DataFrame):
    return F.map_concat(F.from_json("props", "map<string,string>"),
                        F.create_map(F.lit("app"), F.col("event_type")))


def label_select(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return T.label_select(ev.withColumn("labels", _labels(ev)), "labels", SELECTOR) \
        .select("event_id", "ts", "user_id")


def phase_filter(spark, sf_dir):
    return T.phase_filter(load(spark, sf_dir, "events"), "event_type", DELETED_PHASES) \
        .select("event_id", "event_type")


def _ports():
    def port(name, num):
        return F.struct(name.alias("name"), num.cast("bigint").alias("nodePort"))
    return F.array(port(F.lit("part"), F.col("l_partkey")),
                   port(F.col("l_returnflag"), F.col("l_linenumber")),
                   port(F.col("l_linestatus"), F.col("l_suppkey")))


def array_find(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").withColumn("ports", _ports())
    return li.select("l_orderkey", "l_linenumber",
                     T.array_find("ports", "name", "R", "nodePort").alias("port_r"),
                     T.array_find("ports", "name", "O", "nodePort").alias("port_o"))


def flatten_nested(spark, sf_dir):
    items = F.transform(
        F.split("text", "\n"),
        lambda l: F.struct(F.transform(F.split(l, " "),
                                       lambda w: F.struct(w.alias("image"))).alias("containers")))
    docs = load(spark, sf_dir, "documents").select(items.alias("items"))
    images = docs.select(F.explode(T.flatten_field("items", "containers", "image")).alias("image"))
    return images.groupBy("image").agg(F.count(F.lit(1)).alias("n"))


def json_field_eq(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return ev.filter(T.json_field_eq("props", "$.k", "69")).select("event_id", "user_id")


def list_validate(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", HOST_RE, 1).alias("host"))
    return T.list_validate(pages, "host", KNOWN_HOST_LABELS, sep=".") \
        .select("page_id", "items", "unknown", "reversed")


def text_match(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    out = docs.select("doc_id", T.text_match("text", substring="License").alias("license"),
                      # every address holds '@': a cheap substring test first
                      T.text_match("text", substring="@", pattern=EMAIL_RE).alias("email"))
    return out.filter(F.col("license") | F.col("email"))


def text_replace(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    lit = T.text_replace("text", "the", "THE")
    rgx = T.text_replace("text", "[0-9]+", "#", regex=True)
    return docs.select("doc_id", F.md5(lit).alias("lit_md5"), F.md5(rgx).alias("re_md5"),
                       F.length(rgx).cast("bigint").alias("re_len"))


def ts_format(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return ev.select("event_id", T.ts_name("ts").alias("ts_name"),
                     T.ts_iso_utc("ts").alias("ts_iso"))


def unit_div(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(
        T.unit_div(F.sum("n_chars"), 1024).alias("kib_total"),
        F.max(T.unit_div("n_chars", 1000)).alias("max_kb"))


def json_pretty(spark, sf_dir):
    return T.json_pretty(load(spark, sf_dir, "nation").orderBy("n_nationkey"))


def server_log_lines(ev: DataFrame) -> DataFrame:
    return ev.select(server_log_line().alias("value"))


def server_log_line() -> Column:
    """Server log text of a row of ``events``: one line per event.

    Error events become continuation lines that the prefix does not match;
    signups have an empty user, views an empty app; every message holds
    commas and '='.
    """
    et = F.col("event_type")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "),
        F.when(F.col("user_id") % 3 == 0, "UTC").when(F.col("user_id") % 3 == 1, "CET").otherwise("+03"), F.lit(" ["),
        (F.col("user_id") + 1000).cast("string"), F.lit("]: ["), F.col("event_id").cast("string"),
        F.lit("-1] user="), F.when(et == "signup", F.lit("")).otherwise(
            F.concat(F.lit("u"), F.col("user_id").cast("string"))),
        F.lit(",db="), F.when(et == "purchase", F.lit("shop")).otherwise(F.lit("app")),
        F.lit(",app="), F.when(et == "view", F.lit("")).otherwise(F.lit("psql")),
        F.lit(",client=10.0.0."), F.col("user_id").cast("string"),
        F.lit(" LOG:  statement: UPDATE t SET v="), F.col("event_id").cast("string"),
        F.lit(", k="), F.get_json_object("props", "$.k"))
    cont = F.concat(F.lit("\tcontinued statement "), F.col("event_id").cast("string"))
    return F.when(et == "error", cont).otherwise(line)


def log_summary(parsed: DataFrame) -> DataFrame:
    """Per (user, db): statements, first time, last line, with app, zones, max pid, min message."""
    return parsed.groupBy("user", "db").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"),
        F.max("line").alias("last_line"), F.count("app").alias("with_app"),
        F.min("zone").alias("first_zone"), F.max("zone").alias("last_zone"),
        F.max("pid").alias("max_pid"), F.min("message").alias("min_message"))


def server_log_parse(spark, sf_dir):
    parsed, _ = T.parse_server_log(server_log_lines(load(spark, sf_dir, "events")))
    return log_summary(parsed)


def server_log_rejects(spark, sf_dir):
    _, rejects = T.parse_server_log(server_log_lines(load(spark, sf_dir, "events")))
    return rejects.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"))


QUERIES = {
    "count_by_desc": count_by_desc,
    "top_metric": top_metric,
    "latest_row": latest_row,
    "label_select": label_select,
    "phase_filter": phase_filter,
    "array_find": array_find,
    "flatten_nested": flatten_nested,
    "json_field_eq": json_field_eq,
    "list_validate": list_validate,
    "text_match": text_match,
    "text_replace": text_replace,
    "ts_format": ts_format,
    "unit_div": unit_div,
    "json_pretty": json_pretty,
    "server_log_parse": server_log_parse,
    "server_log_rejects": server_log_rejects,
}

_LOG_LINES_SQL = r"""
SELECT CASE WHEN event_type = 'error' THEN '	continued statement ' || event_id
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE user_id % 3 WHEN 0 THEN ' UTC' WHEN 1 THEN ' CET' ELSE ' +03' END || ' [' || (user_id + 1000) || ']: ['
            || event_id || '-1] user='
            || CASE WHEN event_type = 'signup' THEN '' ELSE 'u' || user_id END
            || ',db=' || CASE WHEN event_type = 'purchase' THEN 'shop' ELSE 'app' END
            || ',app=' || CASE WHEN event_type = 'view' THEN '' ELSE 'psql' END
            || ',client=10.0.0.' || user_id
            || ' LOG:  statement: UPDATE t SET v=' || event_id
            || ', k=' || json_extract_string(props, '$.k') END AS value
FROM events
"""

_RE = T.LOG_LINE_RE.replace("'", "''")

ORACLE = {
    "count_by_desc": r"""
SELECT regexp_extract(line, '^\s*(\S+)', 1) AS key, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
GROUP BY 1""",
    "top_metric": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
                  "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "latest_row": """
SELECT event_type, ts, event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""",
    "label_select": "SELECT event_id, ts, user_id FROM events "
                    "WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') = '69'",
    "phase_filter": "SELECT event_id, event_type FROM events "
                    "WHERE event_type NOT IN ('error', 'signup')",
    "array_find": """
SELECT l_orderkey, l_linenumber,
       list_filter(p, lambda x: x.name = 'R')[1].nodePort AS port_r,
       list_filter(p, lambda x: x.name = 'O')[1].nodePort AS port_o
FROM (SELECT l_orderkey, l_linenumber,
             [{'name': 'part', 'nodePort': CAST(l_partkey AS BIGINT)},
              {'name': l_returnflag, 'nodePort': CAST(l_linenumber AS BIGINT)},
              {'name': l_linestatus, 'nodePort': CAST(l_suppkey AS BIGINT)}] AS p
      FROM lineitem)""",
    "flatten_nested": """
SELECT image, count(*) AS n FROM (
  SELECT unnest(string_split(line, ' ')) AS image
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
GROUP BY image""",
    "json_field_eq": "SELECT event_id, user_id FROM events "
                     "WHERE json_extract_string(props, '$.k') = '69'",
    "list_validate": f"""
SELECT page_id, items,
       list_filter(items, lambda x: NOT list_contains({list(KNOWN_HOST_LABELS)}, x)) AS unknown,
       list_reverse(items) AS reversed
FROM (SELECT page_id,
             list_filter(list_transform(string_split(regexp_extract(url, '{HOST_RE}', 1), '.'),
                                        lambda x: trim(x)), lambda x: x <> '') AS items
      FROM pages)""",
    "text_match": f"""
SELECT doc_id, contains(text, 'License') AS license,
       regexp_matches(text, '{EMAIL_RE}') AS email
FROM documents
WHERE contains(text, 'License') OR regexp_matches(text, '{EMAIL_RE}')""",
    "text_replace": """
SELECT doc_id, md5(replace(text, 'the', 'THE')) AS lit_md5,
       md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS re_md5,
       CAST(length(regexp_replace(text, '[0-9]+', '#', 'g')) AS BIGINT) AS re_len
FROM documents""",
    "ts_format": "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS ts_name, "
                 "strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso FROM events",
    "unit_div": """
SELECT source, CAST(sum(n_chars) // 1024 AS BIGINT) AS kib_total,
       CAST(max(n_chars // 1000) AS BIGINT) AS max_kb
FROM documents GROUP BY source""",
    "json_pretty": """
SELECT '{' || chr(10) || '  "n_nationkey" : ' || n_nationkey || ',' || chr(10)
       || '  "n_name" : ' || to_json(n_name) || ',' || chr(10)
       || '  "n_regionkey" : ' || n_regionkey || chr(10) || '}' AS json
FROM nation""",
    "server_log_parse": f"""
WITH lines AS ({_LOG_LINES_SQL}),
parsed AS (
  SELECT strptime(regexp_extract(value, '{_RE}', 1), '%Y-%m-%d %H:%M:%S') AS ts,
         regexp_extract(value, '{_RE}', 2) AS zone,
         CAST(regexp_extract(value, '{_RE}', 3) AS INT) AS pid,
         CAST(regexp_extract(value, '{_RE}', 4) AS BIGINT) AS line,
         nullif(regexp_extract(value, '{_RE}', 5), '') AS "user",
         nullif(regexp_extract(value, '{_RE}', 6), '') AS db,
         nullif(regexp_extract(value, '{_RE}', 7), '') AS app,
         nullif(regexp_extract(value, '{_RE}', 8), '') AS client,
         regexp_extract(value, '{_RE}', 9) AS message
  FROM lines WHERE regexp_matches(value, '{_RE}'))
SELECT "user", db, count(*) AS n, min(ts) AS first_ts, max(line) AS last_line,
       min(zone) AS first_zone, max(zone) AS last_zone,
       count(app) AS with_app, max(pid) AS max_pid, min(message) AS min_message
FROM parsed GROUP BY "user", db""",
    "server_log_rejects": f"""
WITH lines AS ({_LOG_LINES_SQL})
SELECT count(*) AS n, min(value) AS "first" FROM lines
WHERE NOT regexp_matches(value, '{_RE}') OR value IS NULL""",
}
