"""A corpus pipeline over ``documents``: five stages, each one operator.

Each stage takes what the one before kept, written as Parquet and read again.
The first four return the columns of ``documents``; the last returns each
kept document's token ids with the digests of ids and decoded bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe, decontaminate, jaccard, pseudonyms, queries, toxicity
from tidepool.session import prepare, work_path, written
from tidepool.sources.tables import load


def _boxed(docs: DataFrame) -> DataFrame:
    """``text``, and all other columns in one (``rest``): no column of the caller's can
    clash with those that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("text", F.struct(*rest).alias("rest"))


def _unboxed(done: DataFrame, docs: DataFrame) -> DataFrame:
    return done.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose worst sentence scores as toxic (0.7 or more).

    Null and empty texts score as the model's bias alone and stay; rows of one text
    fare alike; an empty table, or one without both labels, loses nothing."""
    model = toxicity.fit(load(spark, sf_dir, "documents"), queries.learnable(spark, sf_dir))
    scored = toxicity.score(_boxed(docs), model, out="toxicity")
    return _unboxed(scored.filter(F.col("toxicity") < model.settings.threshold), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by five-word shingles at 0.8 or more, the
    one with the smallest id (null last); documents without words stay."""
    return jaccard.keep_first(docs, 5, 80, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which benchmark windows cover a twentieth or more.

    Null and empty texts have no words and stay; rows of one text fare alike; an
    empty table, or an empty benchmark, loses nothing."""
    judged = decontaminate.decontaminate(_boxed(docs), load(spark, sf_dir, "benchmark"))
    return _unboxed(judged.filter(~F.col("contaminated")), docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms for personal values; n_chars follows the new text (null for a null one).

    Keeps every row; null and empty texts and all other columns stay as they are."""
    done = _unboxed(pseudonyms.pseudonymise(_boxed(docs), queries.PSEUDONYM_KEY), docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian 32-bit), their count, and digests.

    A row for every row, repeated ones included; a null text has the ids of the empty one: none."""
    ranks, pattern = queries.bpe_parts()
    # written in between: chained, a task would hold the workers of both operators at once
    coded = written(bpe.encode(docs.select("doc_id", "text"), ranks, pattern).drop("text"), work_path(spark, "token_ids"))
    return bpe.decode(coded, ranks).select(
        "doc_id", bpe.token_count(F.col("token_ids")).alias("n_tokens"), "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _prepared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session with the settings that the operators rely on, also when it is called alone."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _prepared(drop_toxic)),
    ("near copies", _prepared(drop_near_copies)),
    ("benchmark decontamination", _prepared(drop_contaminated)),
    ("private values", _prepared(replace_private)),
    ("byte-level tokens", _prepared(tokenise)),
]

#: The stages' models, permutations and encodings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = load(spark, sf_dir, "documents")
    path = work_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{path}/{i}")
    return docs
