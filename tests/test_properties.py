"""Property tests against brute force on small random inputs."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.functions.text import BM25_B, BM25_K1, query_terms
from tidepool.operators import search
from tidepool.operators import snapshot as B
from tidepool.session import work_path

try:
    import regex as _re
except ImportError:  # pragma: no cover
    import re as _re

WORDS = ["alpha", "beta", "Gamma", "délta", "ß", "x1", "the"]
SEPS = [" ", ", ", "--", "\n", "!? "]

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def brute_bm25(docs, query, k=10):
    toks = {d: [t for t in _re.split(r"[^\p{L}\p{N}]+", text.lower()) if t] for d, text in docs}
    n = len(toks)
    nonempty = [len(t) for t in toks.values() if t]
    avgdl = sum(nonempty) / len(nonempty) if nonempty else 0.0
    terms = query_terms(query)
    df = {t: sum(1 for ts in toks.values() if t in ts) for t in terms}
    out = []
    for d, ts in toks.items():
        s, hit = 0.0, False
        for t in terms:
            tf = ts.count(t)
            if tf:
                hit = True
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                s += idf * tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * len(ts) / avgdl))
        if hit:
            out.append((d, s))
    out.sort(key=lambda r: (-r[1], r[0]))
    return [(d, round(s, 6)) for d, s in out[:k]]


doc_text = st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(SEPS)), max_size=12).map(
    lambda ps: "".join(w + s for w, s in ps))


@SETTINGS
@given(texts=st.lists(doc_text, min_size=1, max_size=12),
       query=st.lists(st.sampled_from(WORDS), min_size=1, max_size=3).map(" ".join))
def test_bm25_equals_brute_force(spark, texts, query):
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["score"]) for r in search.match(df, query, k=5).collect()]
    want = brute_bm25(docs, query, k=5)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got, want))


@SETTINGS
@given(a=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 3)),
                  max_size=10),
       perm_seed=st.integers(0, 1000))
def test_checksum_equals_iff_multisets_equal(spark, a, perm_seed):
    import random
    b = list(a)
    random.Random(perm_seed).shuffle(b)
    if b and perm_seed % 2:
        b[0] = (b[0][0], b[0][1] + 1)  # a real change
    da = spark.createDataFrame(a, "x int, y int")
    db = spark.createDataFrame(b, "x int, y int")
    same = sorted(a, key=repr) == sorted(b, key=repr)
    assert B.same_checksum(da, db).first()["equal"] == same
    assert (B.diff(da, db).count() == 0) == same
