"""Source divergence audit: how far the sources of a language differ in their words.

Every group (a language's source) and every language gives each kept term a
price, a whole number close to 10**9 times its smoothed share. Two sources of a
language differ by the sum of the absolute price differences over all kept
terms; a source differs from its language by single terms.

Pairs are priced by a sparse merge. A group's kept terms are sorted arrays
(term id, count), cut at the borders of the id ranges ("chunks") in which the
ids were given. For each unordered pair the two arrays of a chunk are
co-grouped: the shorter one's ids are searched in the longer one's (galloping:
each search starts where the last one ended), which prices the overlap; ids of
one side only are priced against the other's price of an absent term, and the
kept terms that neither has are priced by their number alone. The sum serves both
directions of the pair. A task holds two arrays of one chunk, whatever the
size of the vocabulary.

Words are counted per task before anything is shuffled, so a hot source or word costs a
row a task. All arithmetic is exact (whole numbers; sums of counts below
9 * 10**15). Results by case: null text, language and source count as ''; a
group without terms has count 0 of every kept term; a language without kept
terms has divergence 0 for all pairs and no rows of part ``term``; repeated
rows count as often as they stand; an empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path

SCALE_STEPS = 3          # prices are shares times 1000 ** SCALE_STEPS
SMOOTHING = 5
HELD_TERMS = 200_000     # distinct terms that a task holds before it gives its counts on

# Every byte that ends a word becomes a space, A-Z become a-z, others stay: a
# word is made of ASCII letters and of the bytes of non-ASCII characters.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of what the task has read; a term may come several times."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            if n:
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()), pa.array(list(n.values()), pa.int64()),
                     pa.array([df[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "df"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0), b.column(1), b.column(2)):
            n, df = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            terms = terms_of(text.as_py())
            n.update(terms)
            df.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from given()
    yield from given()


def _price(count: Column, total: Column) -> Column:
    """1 + floor(1000 ** SCALE_STEPS * (count + SMOOTHING) / total), digit by digit."""
    rest = count + F.lit(SMOOTHING)
    div = lambda a, b: F.call_function("div", a, b)
    out = div(rest, total)
    for _ in range(SCALE_STEPS):
        rest = (rest % total) * 1000
        out = out * 1000 + div(rest, total)
    return out + 1


def price(count: np.ndarray, total: int) -> np.ndarray:
    """The same in numpy."""
    rest = count.astype(np.int64) + SMOOTHING
    out = rest // total
    for _ in range(SCALE_STEPS):
        rest = (rest % total) * 1000
        out = out * 1000 + rest // total
    return out + 1


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted term ids and their counts as they are shuffled: deflated gaps and counts."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), counts]).astype("<i8").tobytes(), 1)


def unpack(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if raw is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(zlib.decompress(raw), "<i8")
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total_a: int, total_b: int) -> tuple[int, int]:
    """Summed absolute price differences over the terms that either side has, and their number."""
    if len(a[0]) > len(b[0]):
        a, b, total_a, total_b = b, a, total_b, total_a
    none_a, none_b = (int(price(np.zeros(1, np.int64), t)[0]) for t in (total_a, total_b))
    of_a, of_b = price(a[1], total_a), price(b[1], total_b)
    at = np.searchsorted(b[0], a[0])
    both = np.zeros(len(a[0]), bool)
    inside = at < len(b[0])
    both[inside] = b[0][at[inside]] == a[0][inside]
    only_b = np.ones(len(b[0]), bool)
    only_b[at[both]] = False
    total = np.abs(of_a[both] - of_b[at[both]]).sum() + np.abs(of_a[~both] - none_b).sum() + np.abs(of_b[only_b] - none_a).sum()
    return int(total), len(a[0]) + int(only_b.sum())


def _pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, chunk, entries) to (lang, source, chunk, packed)."""
    for b in batches:
        packed = []
        for entries in b.column(3):
            ids, counts = (entries.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            packed.append(pack(ids, counts))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())], names=["lang", "source", "chunk", "packed"])


def _price_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, total_a, total_b, packed_a, packed_b) to (lang, a, b, value, seen)."""
    for b in batches:
        rows = [merged(unpack(x.as_py()), unpack(y.as_py()), m.as_py(), n.as_py()) for m, n, x, y in zip(*b.columns[3:7])]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                                         names=["lang", "a", "b", "value", "seen"])


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for every occurring (lang, source).

    Part ``pair``: every other source of the language with the summed price
    difference, all ranks. Part ``term``: the terms that the source has and
    prices above its language, the ``top`` largest differences. Kept terms
    stand in at least ``min_docs`` documents of the language. Ranks count from
    1, larger values first, then smaller items (UTF-8).
    """
    spark = docs.sparkSession
    path = work_path(spark, "divergence")

    def written(df: DataFrame, name: str) -> DataFrame:
        """A table in the shared folder: computed once, and it cuts the lineage."""
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").cast("binary").alias("text"))
    partial = written(read.mapInArrow(_counted, "lang string, source string, term binary, n long, df long")
                      .withColumn("term", F.col("term").cast("string")), "partial")
    # the kept terms of each language, with ids in sorted ranges
    kept = partial.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).filter(F.col("df") >= min_docs)
    vocabulary = written(kept.select("lang", "term", F.col("n").alias("lang_n")).repartitionByRange("lang", "term")
                         .sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    counts = written(partial.join(vocabulary.select("lang", "term", "id", "lang_n"), ["lang", "term"])
                     .groupBy("lang", "source", "term", "id", "lang_n").agg(F.sum("n").alias("n")), "counts")
    smooth = lambda n, v: F.coalesce(n, F.lit(0)) + F.lit(SMOOTHING) * F.coalesce(v, F.lit(0))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_sum"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = written(read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), smooth(F.col("sum"), F.col("kept")).alias("total"),
        smooth(F.col("lang_sum"), F.col("kept")).alias("lang_total")), "groups")

    # part pair: a task for each unordered pair and chunk
    arrays = written(counts.groupBy("lang", "source", F.shiftright("id", 33).alias("chunk"))
                     .agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("entries"))
                     .select("lang", "source", "chunk", "entries").mapInArrow(_pack_groups, "lang string, source string, chunk long, packed binary"), "arrays")
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), "kept")
    pairs = side("a").join(side("b").drop("kept"), "lang").filter("a < b")
    key = ["lang", "a", "b", "chunk"]
    brought = lambda s: pairs.join(arrays.withColumnRenamed("source", s), ["lang", s]).select(
        *key, *[F.col(c).alias(f"{c}_of_{s}") for c in ("total_a", "total_b")], F.col("packed").alias(f"packed_{s}"))
    met = brought("a").join(brought("b"), key, "full").select(
        "lang", "a", "b", *[F.coalesce(f"{c}_of_a", f"{c}_of_b").alias(c) for c in ("total_a", "total_b")], "packed_a", "packed_b")
    priced = met.mapInArrow(_price_pairs, "lang string, a string, b string, value long, seen long") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    absent = lambda s: F.when(F.col("kept") > 0, _price(F.lit(0).cast("long"), F.nullif(F.col(f"total_{s}"), F.lit(0).cast("long"))))
    whole = pairs.join(priced, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", (F.coalesce("value", F.lit(0)) + F.coalesce(
            (F.col("kept") - F.coalesce("seen", F.lit(0))) * F.abs(absent("a") - absent("b")), F.lit(0))).cast("long").alias("value"))
    both_ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = whole.select("lang", both_ways.alias("way"), "value").select(
        "lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(by_rank))

    # part term: a source's terms against its language
    own = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _price(F.col("n"), F.col("total")).alias("p"),
        _price(F.col("lang_n"), F.col("lang_total")).alias("q")).filter("p > q")
    term = own.select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value")) \
        .withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
