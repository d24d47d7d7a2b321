"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` words (an item of fewer words is
one window). A document contains a window if its words stand there in order.
Windows and documents are sets of shingles; containment of a whole window
needs every shingle of it, so the necessary prefix is one shingle: the rarest
one, by its count over all documents. Documents are joined on that shingle
alone; its place in the window then says where the window would start
(positional bound) and end (length bound), and only there the words are compared.

A word that lies in any occurrence of a window is hit. Results by case: a null
or empty text has no words and no hits; repeated documents get a row each;
items with the same words all count; null ids of items are left out of the item list;
without items nothing is hit; an empty table gives an empty table; columns
named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path, written
from .common import ascii_lower, shielded

# What is not part of a word, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3            # words in a shingle
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20  # most rows, and bytes of words and ids, that are sent to every executor


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingle(words_: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words_, at + i) for i in range(size)])


def _fits(df: DataFrame) -> bool:
    """Whether a written table is small enough to be sent to every executor."""
    size = [F.octet_length(F.concat_ws(" ", c)) for c, t in df.dtypes if t.startswith("array")]
    n, most = df.agg(F.count("*"), F.coalesce(F.sum(sum(size, F.lit(0))), F.lit(0))).first()
    return n <= BROADCAST_ROWS and most <= BROADCAST_BYTES


def windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, start, words of every window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item_id", "w", F.explode(starts).alias("start")) \
        .select("item_id", F.slice("w", F.col("start") + 1, size).alias("gram")) \
        .groupBy("gram").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def shingles_of(docs: DataFrame, size: int) -> DataFrame:
    """Every shingle occurrence of the documents with its place, and the words
    as ``_w``, for use in the same step only (a shuffle would copy them per row)."""
    return docs.withColumn("_w", words(F.col("text"))).select("*", F.posexplode("_w").alias("_at", "_first")) \
        .withColumn("shingle", F.xxhash64(F.lit(size), "_first", *[F.get("_w", F.col("_at") + i) for i in range(1, size)])) \
        .drop("_first")


def hits(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """(doc key columns, start, length, items) of each window occurrence in ``docs``
    (columns key, text)."""
    grams = windows(items, window).withColumn("size", F.least(F.size("gram"), F.lit(SHINGLE)))
    sizes = [r[0] for r in grams.select("size").distinct().orderBy("size").collect()]  # at most SHINGLE values
    if not sizes:
        return docs.select("key", F.lit(0).alias("start"), F.lit(0).alias("length"),
                           F.array().cast("array<string>").alias("items")).limit(0)
    places = _union([grams.filter(F.col("size") == n).select(
        "gram", "items", "size", F.explode(F.sequence(F.lit(0), F.size("gram") - n)).alias("offset"))
        .withColumn("shingle", _shingle(F.col("gram"), F.col("offset"), n)) for n in sizes])
    # rarity over all documents, of the shingles that windows hold
    path = work_path(docs.sparkSession, "decontaminate")
    wanted = written(places.select("shingle").distinct(), f"{path}/wanted")
    wanted = F.broadcast(wanted) if _fits(wanted) else wanted
    counts = _union([shingles_of(docs.select("text"), n).select("shingle") for n in sizes]) \
        .join(wanted, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    # a window with a shingle that no document holds occurs nowhere
    prefix = written(places.join(counts, "shingle", "left").groupBy("gram", "items", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest")) \
        .filter("rarest.n > 0").select("gram", "items", "size", "rarest.offset", "rarest.shingle"), f"{path}/prefix")
    small, found = _fits(prefix), []
    start, size = F.col("_at") - F.col("offset"), F.size("gram")
    for n in sizes:
        own = prefix.filter(F.col("size") == n).drop("size")
        rows = shingles_of(docs.select("key", "text"), n)
        if small:  # the words are at hand where the broadcast join meets the shingle
            rows = rows.join(F.broadcast(own), "shingle").filter((start >= 0) & (start + size <= F.size("_w")))
        else:  # join places alone, then look the words up again
            rows = rows.select("key", "_at", "shingle", F.size("_w").alias("_n")).join(own, "shingle") \
                .filter((start >= 0) & (start + size <= F.col("_n"))) \
                .join(docs.select("key", words(F.col("text")).alias("_w")).dropDuplicates(["key"]), "key")
        found.append(rows.filter(F.slice("_w", F.greatest(start, F.lit(0)) + 1, size) == F.col("gram"))
                     .select("key", start.alias("start"), size.alias("length"), "items"))
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Append n_words, n_hit, items (ids of occurring items as strings, sorted)
    and contaminated (some hit, and ``share * n_hit >= n_words``)."""
    return shielded(docs, ("text",), ("n_words", "n_hit", "items", "contaminated"), lambda d: _judged(d, items, window, share))


def _judged(docs: DataFrame, items: DataFrame, window: int, share: int) -> DataFrame:
    # the same text has the same hits: texts are the key, so repeated rows and ids do no harm
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    occ = hits(docs.select(key.alias("key"), "text").filter(F.col("text").isNotNull()), items, window) \
        .groupBy("key", "start").agg(F.max("length").alias("length"), F.flatten(F.collect_set("items")).alias("items"))
    # words covered: each occurrence adds what lies beyond all earlier ones
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("length")).over(before), F.lit(0))
    end = F.col("start") + F.col("length")
    per = occ.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), reach))) \
        .groupBy("key").agg(F.sum("new").alias("n_hit"),
                            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = docs.withColumns({"_key": key, "n_words": F.size(words(F.col("text"))).cast("long")}) \
        .join(per.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    return out.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"),
        "items": F.coalesce("items", F.array().cast("array<string>"))}) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
