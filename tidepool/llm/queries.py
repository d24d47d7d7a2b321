"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import (bitslice, bpe, conversations, decontaminate, divergence, jaccard, kdshards, leaks, licences, pseudonyms, quality,
               toxicity, urlrules)
from .common import is_held_out

# The secret of the registered query and pipeline; a deployment names its own.
PSEUDONYM_KEY = b"change this key in production"
VOCABULARY = "byte_bpe_50k.tiktoken"
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    return labels.filter(~is_held_out(F.col("doc_id")))


def _scored(docs: DataFrame, threshold: float) -> DataFrame:
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-kernel SVM scores of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, learnable(spark, sf_dir))
    return _scored(toxicity.score(docs, model), model.settings.threshold)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its numbers, dates and addresses replaced."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.known_table(spark)).select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword-embedding quality scores of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, learnable(spark, sf_dir))
    return _scored(quality.score(docs, model), 0.5)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.85: size and component of every document."""
    return jaccard.jaccard_join(load(spark, sf_dir, "documents"), 4, 85, 100)


def op6_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every vector whose id is divisible by 50."""
    return bitslice.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_kdshards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", kdshards.size_of(F.col("text")).alias("size"), kdshards.checksum(F.col("text")).alias("text_crc32"))
    placed = kdshards.shard(docs, 24, F.col("size"), {"size": F.col("size"), "text": F.col("text_crc32")}, [F.col("doc_id")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in every document."""
    out = decontaminate.decontaminate(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(load(spark, sf_dir, "pages").select("page_id", "url"), rules) \
        .select("page_id", "host", "path", "rule", "verdict")


def bpe_parts(path: str | None = None):
    """Ranks and pre-token pattern; the vocabulary's path is a parameter."""
    import public_tokenizers
    return bpe.read_ranks(path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    ranks, pattern = bpe_parts(path)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, pattern).select("doc_id", "token_ids")
    return bpe.decode(coded, ranks).select(
        "doc_id", bpe.token_count(F.col("token_ids")).alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of a language from the others and from the language."""
    return divergence.audit(load(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after the planted damage."""
    rows = load(spark, sf_dir, "conversations")
    edits = conversations.repair(rows, conversations.damage(rows))
    said = conversations.digests(edits.turns).withColumnRenamed("conv_id", "said_of")
    empty = hashlib.sha256(b"").hexdigest()
    return edits.report.join(said, F.col("conv_id").eqNullSafe(F.col("said_of")), "left").select(
        *edits.report.columns, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op13_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base formats, and values that are costly to guess."""
    found = leaks.scan(load(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(of_kind, leaks.KINDS[:3]), F.sha2(named(base), 256).alias("base_sha256"),
                        named(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_pseudonyms, op3_licences, op4_quality, op5_jaccard, op6_bitslice, op7_kdshards,
    op8_decontaminate, op9_urlrules, op10_bpe, op11_divergence, op12_conversations, op13_leaks)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = ("list_filter(string_split_regex(" + _LOWER.format("coalesce(text, '')") +
          r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")


def _licence_sql() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in licences.SENTENCES)
    rules = ", ".join("{'left': '%s', 'found': '%s'}" % ("".join(f"|{i}|" for i in ids), licence) for licence, ids in licences.RULES)
    used = f"""list_reduce([{rules}], lambda now, rule: {{
        'left': replace(now.left, rule.left, '|#|'),
        'found': CASE WHEN contains(now.left, rule.left) THEN now.found || rule.found || '|' ELSE now.found END}},
        {{'left': '|' || array_to_string(ids, '||') || '|', 'found': '|'}}).found"""
    # each licence once, in the order of the rules
    names = list(dict.fromkeys(n for n, _ in licences.RULES))
    plain = f"replace(lower(text), '{licences.SPDX_LINE}', chr(10) || 'spdx license identifier ')"
    plain = rf"regexp_replace({plain}, '[.!?:]+([ \t\n\x0B\f\r]+|$)', chr(10) || chr(10), 'g')"
    for words in licences.OPENINGS:
        plain = f"replace({plain}, '{words}', chr(10) || '{words}')"
    # runs grow piece by piece while they begin a known sentence; then the longest from each place that no earlier one covers
    return rf"""
    WITH RECURSIVE known(id, sentence) AS (VALUES {known}),
    d AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM documents),
    cut AS MATERIALIZED (SELECT r, place, trim(piece) AS piece FROM (SELECT r, generate_subscripts(s, 1) AS place, unnest(s) AS piece FROM (
        SELECT r, string_split_regex(regexp_replace({plain}, '[^a-z0-9\n]+', ' ', 'g'), ' ?\n ?') AS s FROM d)) WHERE trim(piece) <> ''),
    run AS (SELECT r, place, 1 AS n, piece AS said, id, sentence FROM cut
            JOIN known ON split_part(piece, ' ', 1) = split_part(sentence, ' ', 1) AND starts_with(sentence || ' ', piece || ' ')
        UNION ALL SELECT run.r, run.place, n + 1, said || ' ' || piece, id, sentence FROM run JOIN cut ON cut.r = run.r
            AND cut.place = run.place + n AND starts_with(sentence || ' ', said || ' ' || piece || ' ')),
    hit AS MATERIALIZED (SELECT DISTINCT r, place, n, id FROM run WHERE said = sentence),
    top AS MATERIALIZED (SELECT r, place, max(n) AS n FROM hit GROUP BY r, place),
    hop AS MATERIALIZED (SELECT t.r, t.place, t.n, u.place AS next FROM top t ASOF LEFT JOIN top u ON t.r = u.r AND t.place + t.n <= u.place),
    way AS (SELECT * FROM hop WHERE (r, place) IN (SELECT (r, min(place)) FROM top GROUP BY r)
        UNION ALL SELECT hop.* FROM way JOIN hop ON hop.r = way.r AND hop.place = way.next),
    seq AS (SELECT r, list(id ORDER BY place, id) AS ids FROM hit JOIN way USING (r, place, n) GROUP BY r),
    out AS (SELECT r, array_to_string(ids, ',') AS sentence_ids, {used} AS found FROM seq)
    SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, array_to_string(list_filter([{', '.join(f"'{n}'" for n in names)}],
        lambda x: contains(coalesce(found, ''), '|' || x || '|')), ',') AS licences
    FROM d LEFT JOIN out USING (r)"""


ORACLE = {
    "op3_licences": _licence_sql(),
    "op6_bitslice": """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON c.r <> q.r AND q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5""",
    "op8_decontaminate": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 13], ' ') AS gram, least(len(w), 13) AS n
        FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
    lens AS (SELECT DISTINCT n FROM win),
    pos AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS gram
        FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
    occ AS (SELECT r, i, pos.n, item_id FROM pos JOIN win ON win.gram = pos.gram AND win.n = pos.n),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
    its AS (SELECT r, list(DISTINCT item_id) AS l FROM occ GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
        sha256(coalesce(array_to_string(list_sort(l), ','), '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
    "op11_divergence": rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
    c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS s FROM (SELECT DISTINCT lang, source FROM d)
        LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
    p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (s + 5 * v) AS p
        FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
        FROM c JOIN v USING (lang) GROUP BY lang, term),
    f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
            WHERE x.lang = g.lang AND x.source = g.source AND y.source = h.source), 0) AS value
        FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
        CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM f QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50""",
    "op9_urlrules": rf"""
    WITH p AS (SELECT page_id, coalesce({_LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    f AS (SELECT *, ('.' || host) LIKE '%.com' AS com, ('.' || host) LIKE '%.example.com' AS example,
        ('.' || host) LIKE '%.www.example.com' AS www, ('.' || host) LIKE '%.net' AS net FROM p),
    r AS (SELECT *, CASE WHEN www AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN example AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN com AND path LIKE '/%' THEN 'com/' WHEN net AND path LIKE '/es/%' THEN 'net/es/' WHEN net AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM f)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}
