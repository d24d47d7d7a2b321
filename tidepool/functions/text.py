"""Text expressions built from Spark built-ins (JVM side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Tokeniser rule. Lower-case, then split on every run of
# characters that are neither letters nor digits; empty pieces are dropped.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# BM25 parameters (Robertson & Zaragoza 2009 defaults).
BM25_K1 = 1.2
BM25_B = 0.75


def raw_tokens(text: Column | str) -> Column:
    """``split(lower(text))``: the tokens plus an empty piece at either end when
    the text starts or ends with a separator. Codegen-friendly (no lambda)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.lower(c), TOKEN_SPLIT)


def tokens(text: Column | str) -> Column:
    """array<string> of the lower-cased word tokens of ``text``."""
    return F.array_remove(raw_tokens(text), "")


def words(text: Column | str) -> Column:
    """The tokens of ``text`` with one space between them, as one string."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(c), TOKEN_SPLIT, " "))


def word_count(joined: Column) -> Column:
    """Number of tokens in a ``words`` string."""
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)


def token_count(raw: Column) -> Column:
    """Number of tokens in a ``raw_tokens`` array (empty pieces not counted)."""
    return F.size(F.array_remove(raw, ""))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query string, by the documents' own expression, first-seen order.
    (Of one literal row, which Spark folds: no job runs.)"""
    one = SparkSession.active().sql("SELECT 1").select(F.array_distinct(tokens(F.lit(query))))
    return list(one.first()[0])


def term_count(raw: Column, term: str) -> Column:
    """How often ``term`` occurs in a token array: its size minus the size
    without ``term``. Built-in array functions only, so the whole scoring
    projection stays in whole-stage codegen (a ``filter`` lambda would not)."""
    return F.size(raw) - F.size(F.array_remove(raw, F.lit(term)))
