"""Registered stream and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_path
from ..operators import tableops as T
from ..sources import files, jsonio, logs
from ..sources.tables import load
from ..streaming import appended
from ..streaming import ingest as S
from .tableops_q import ORACLE as _TABLEOPS_ORACLE
from .tableops_q import _LOG_LINES_SQL, log_summary, server_log_line, server_log_lines

# The time that splits events into two produce batches.
SPLIT_TS = "2024-01-15 00:00:00"


def _two_batches(df, ts="ts"):
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    return df.filter(F.col(ts) < cut), df.filter(F.col(ts) >= cut)


def _event_lines(spark, sf_dir, folder):
    """Two batches of events as JSON lines; a line in seven of the second is cut off in the middle."""
    ev = load(spark, sf_dir, "events")
    for i, b in enumerate(_two_batches(ev)):
        line = F.to_json(F.struct(*ev.columns), {"timestampNTZFormat": jsonio.TS_NTZ_FORMAT})
        whole = b.select(line.alias("value"))
        cut = b.filter(F.col("event_id") % 7 == 0).select(F.substring(line, 1, 20).alias("value"))
        (whole if i == 0 else whole.unionByName(cut)).write.mode("append").text(folder)
        yield ev.schema


def _ingested(spark, sf_dir):
    folder, sink, ckpt = work_path(spark, "event_lines"), work_path(spark, "lake_events"), work_path(spark, "ckpt")
    for schema in _event_lines(spark, sf_dir, folder):
        S.ingest_with_rejects(S.follow_text(spark, folder), schema, sink, ckpt)
    S.ingest_with_rejects(S.follow_text(spark, folder), schema, sink, ckpt)  # nothing new: must add no rows
    return S.ingested(spark, sink, schema)


def stream_ingest(spark, sf_dir):
    """The rows of the ingest."""
    return _ingested(spark, sf_dir)[0]


def stream_rejects(spark, sf_dir):
    """What the ingest turned away."""
    return _ingested(spark, sf_dir)[1].groupBy(F.length("value").alias("chars")).agg(F.count("*").alias("rejected"))


def log_follow_append(spark, sf_dir):
    """Lines appended to files that are being followed, the last one unfinished at first."""
    ev = load(spark, sf_dir, "events")
    folder, sink, ckpt = work_path(spark, "growing"), work_path(spark, "followed"), work_path(spark, "ckpt")
    first, later = (b.select("event_id", server_log_line().alias("value")) for b in _two_batches(ev))
    in_file = F.concat(F.lit("log-"), F.floor(F.col("event_id") / 5000))
    first = first.select(in_file.alias("file"), F.col("event_id").alias("place"), "value")
    later = later.select(in_file.alias("file"), (F.col("event_id") + (1 << 40)).alias("place"), "value")
    for lines, ended in ((first, False), (first.unionByName(later), True)):
        appended.write_lines(lines, folder, ended)
        S.ingest(appended.follow(spark, folder), sink, ckpt)
    return spark.read.parquet(sink).select("value")


def _messages(spark, sf_dir):
    """Two batches of events as keyed JSON messages in a folder, each message once."""
    ev, folder = load(spark, sf_dir, "events"), work_path(spark, "messages")
    value = F.to_json(F.struct(*ev.columns), {"timestampNTZFormat": jsonio.TS_NTZ_FORMAT}).alias("value")
    for i, b in enumerate(_two_batches(ev)):
        files.write(b.select(F.lit(i).cast("bigint").alias("batch"), F.col("user_id").cast("string").alias("key"), value), folder, mode="append")
    return ev, files.scan(spark, folder)


def topic_produce(spark, sf_dir):
    """S05 re-aimed at files: messages written, those missing (gaps) or there twice
    (dup_offsets), and the first batch's number (min_offset)."""
    ev, sent = _messages(spark, sf_dir)
    ids = sent.select("batch", F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))
    per = ids.withColumn("n", F.lit(1)).unionByName(ev.select("event_id", F.lit(0).alias("n")), allowMissingColumns=True) \
        .groupBy("event_id").agg(F.sum("n").alias("n"), F.min("batch").alias("batch"))
    return per.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("gaps"),
                   F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("dup_offsets"), F.min("batch").alias("min_offset"))


def topic_consume(spark, sf_dir):
    """S06 re-aimed at files: the messages as typed rows."""
    ev, sent = _messages(spark, sf_dir)
    return S.split_values(sent.select("value"), ev.schema)[0]


def log_tail(spark, sf_dir):
    return logs.tail(load(spark, sf_dir, "events").select("event_id", "ts", "event_type"),
                     "ts", "event_id", n=50)


def log_follow(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    log_dir = work_path(spark, "logs")
    sink, ckpt = work_path(spark, "followed"), work_path(spark, "ckpt")
    for b in _two_batches(ev):
        server_log_lines(b).write.mode("append").text(log_dir)
        S.ingest(S.follow_text(spark, log_dir), sink, ckpt)
    return spark.read.parquet(sink)


def log_follow_parse(spark, sf_dir):
    """Follow a log folder and parse each new line as it arrives (S12 + D15)."""
    ev = load(spark, sf_dir, "events")
    log_dir = work_path(spark, "logs")
    sink, ckpt = work_path(spark, "parsed"), work_path(spark, "ckpt")
    for b in _two_batches(ev):
        server_log_lines(b).write.mode("append").text(log_dir)
        parsed, _ = T.parse_server_log(S.follow_text(spark, log_dir))
        S.ingest(parsed, sink, ckpt)
    return log_summary(spark.read.parquet(sink))


QUERIES = {
    "topic_produce": topic_produce,
    "topic_consume": topic_consume,
    "stream_ingest": stream_ingest,
    "stream_rejects": stream_rejects,
    "log_follow_append": log_follow_append,
    "log_tail": log_tail,
    "log_follow": log_follow,
    "log_follow_parse": log_follow_parse,
}

ORACLE = {
    "topic_produce": "SELECT count(*) AS rows, 0 AS gaps, 0 AS dup_offsets, 0 AS min_offset FROM events",
    "topic_consume": "SELECT * FROM events",
    "stream_ingest": "SELECT * FROM events",
    "stream_rejects": f"SELECT 20 AS chars, count(*) AS rejected FROM events WHERE event_id % 7 = 0 AND ts >= TIMESTAMP '{SPLIT_TS}'",
    "log_follow_append": _LOG_LINES_SQL,
    "log_tail": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC "
                "LIMIT 50",
    "log_follow": _LOG_LINES_SQL,
    "log_follow_parse": _TABLEOPS_ORACLE["server_log_parse"],
}
