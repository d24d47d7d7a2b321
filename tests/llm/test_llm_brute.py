"""Scores and shards against plain, slow versions of the same definitions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from tidepool.llm import kdshards, pseudonyms, quality, queries, toxicity
from tidepool.sources.tables import load

TRICKY = [None, "", " \t\n", "...", "n u m b s k u l l", "What a NUMB5KULL! You n-u-m-b-s-k-u-l-l.", "x" * 90, "é" * 30 + " ünder",
          "a b", "yes yes yes no no", "\U0001F600 \U0001F600", "12 34", "word " * 500]


def plain_features(word, s):
    """Every subsequence of three, from every place, with the decay of its gaps."""
    marked = "^" + word + "$"
    code = lambda c, at: 1 if at == 0 else 2 if at == len(marked) - 1 else ord(c) - 94 if "a" <= c <= "z" else 29 + ord(c) % 20
    at = [code(c, i) for i, c in enumerate(marked)]
    out, norm = Counter(), 0.0
    for i in range(len(at)):
        for j in range(i + 1, len(at)):
            for k in range(j + 1, min(len(at), i + s.span + 1)):
                weight = s.decay ** (k - i - 2)
                out[at[i], at[j], at[k]] += weight
                norm += weight ** 2
    return {f: x / math.sqrt(max(norm, 1e-9)) for f, x in out.items()}


def plain_margin(model, word):
    s, n = model.settings, toxicity.CLASSES
    form = toxicity.plain(word)
    if not form:
        return model.bias
    parts = [form] if len(form) <= s.longest else [form[i:i + s.longest] for i in range(0, len(form) - s.longest // 2, s.longest // 2)]
    return max(model.bias + sum(x * float(model.weights[(a * n + b) * n + c]) for (a, b, c), x in plain_features(p, s).items()) for p in parts)


def plain_toxicity(model, text, known):
    words, run = (text or "").split(), []
    spelled = []
    for w in words + ["end"]:
        if len(w) == 1:
            run.append(w)
        else:
            spelled += ["".join(run)] if len(run) >= 4 else []
            run = []
    for w in set(words + spelled) - set(known):
        known[w] = plain_margin(model, w)
    top = max((known[w] for w in words + spelled), default=model.bias)
    a, b = model.curve
    return 1 / (1 + math.exp(-min(60, max(-60, a * top + b))))


def test_kernel_equals_all_subsequences():
    s, rng = toxicity.Settings(), random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["a", "numbskull", "é"]
    marks = words[::7]
    plain = {w: plain_features(w, s) for w in words}
    want = [[sum(x * plain[m].get(f, 0.0) for f, x in plain[w].items()) for m in marks] for w in words]
    assert np.allclose(toxicity.kernel(words, marks, s), want, atol=1e-4)


def test_toxicity_query_equals_plain_scores(spark):
    docs = load(spark, SF_SMALL, "documents").select("doc_id", "text")
    model, known = toxicity.fit(docs, queries.learnable(spark, SF_SMALL)), {}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op1_toxicity(spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        want = plain_toxicity(model, text[r["doc_id"]], known)
        assert r["score"] == pytest.approx(want, abs=1e-4)
        assert r["predicted"] == int(r["score"] >= 0.7)
    assert toxicity.Scorer(model).scores(TRICKY) == pytest.approx([plain_toxicity(model, t, known) for t in TRICKY], abs=1e-4)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_near_copies(rows, k, num, den):
    """Every pair compared; of each linked group the smallest id stays."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda x: rows[x][0])
                group[b] = a
    return [r for i, r in enumerate(rows) if root(i) == i]


def plain_contaminated(text, windows):
    w, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_pipeline_equals_its_stages_done_plainly(spark):
    """Toxicity, near copies, decontamination and tokens by slow versions. The pseudonyms are
    keyed, so those of the operator are taken; their round trips are tested by themselves."""
    docs = load(spark, SF_SMALL, "documents").select("doc_id", "text")
    model, known = toxicity.fit(docs, queries.learnable(spark, SF_SMALL)), {}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = [r for r in rows if plain_toxicity(model, r[1], known) < 0.7]
    single = plain_near_copies(clean, 5, 80, 100)
    windows = set()
    for item in load(spark, SF_SMALL, "benchmark").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item["text"]))
        windows.update(tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12)) if w)
    kept = [r for r in single if not plain_contaminated(r[1], windows)]
    assert len(rows) > len(clean) > len(single) > len(kept) > 0
    said = pseudonyms.pseudonymise(spark.createDataFrame(kept, "doc_id long, text string"), queries.PSEUDONYM_KEY).collect()
    ranks, pattern = queries.bpe_parts()
    coder = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in said:
        text = r["text"] or ""
        ids = coder.encode_ordinary(text)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


WRAP = (1 << 64) - 1


def plain_rows(word, s):
    """Table rows of a word and of its n-grams, in whole numbers that wrap at 64 bits."""
    c = [ord(x) for x in f"<{word}>"]
    keys, power = [0], 1
    for x in c:
        power = power * 0x9E3779B97F4A7C15 & WRAP
        keys[0] = keys[0] + x * power & WRAP
    for n in range(s.shortest, s.longest + 1):
        for i in range(len(c) - n + 1):
            key = c[i] + 1
            for x in c[i + 1:i + n]:
                key = key * 0x100000001B3 + x & WRAP
            keys.append((key << 3) + n & WRAP)
    out = []
    for h in keys:
        h = h * 0xD6E8FEB86659FD93 & WRAP
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & WRAP
        out.append(h >> 64 - s.bits | 2)
    return out


def plain_quality(model, text, known):
    s, words = model.settings, (text or "").split()
    for w in set(words) - set(known):
        rows = plain_rows(w, s)
        known[w] = sum(float(model.direction[r]) for r in rows), len(rows)
    again = s.again * sum(a == b for a, b in zip(words, words[1:]))
    total = sum(known[w][0] for w in words) + s.pad * float(model.direction[0]) + again * float(model.direction[1])
    mean = total / (sum(known[w][1] for w in words) + s.pad + again)
    return 1 / (1 + math.exp(-min(60, max(-60, model.bias + mean))))


def test_quality_query_equals_plain_averages(spark):
    docs = load(spark, SF_SMALL, "documents").select("doc_id", "text")
    model, known = quality.fit(docs, queries.learnable(spark, SF_SMALL)), {}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op4_quality(spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        assert r["score"] == pytest.approx(plain_quality(model, text[r["doc_id"]], known), abs=1e-6)
    assert quality.Scorer(model).scores(TRICKY) == pytest.approx([plain_quality(model, t, known) for t in TRICKY], abs=1e-6)


def plain_tree(rows, shards, tolerance=0.02):
    """Shard of each row (id, weight, coordinates) by the recursive definition."""
    spread = lambda rs, d: max(r[2][d] for r in rs) - min(r[2][d] for r in rs)
    root = [max(1, spread(rows, d)) for d in range(2)]
    out = {}

    def split(rs, first, k):
        if k == 1 or not rs:
            out.update((r[0], first) for r in rs)
            return
        d = max(range(2), key=lambda d: (spread(rs, d) / root[d], -d))
        total = sum(r[1] for r in rs)
        goal, below = total * (k // 2) / k, 0
        for v in sorted({r[2][d] for r in rs}):
            at = sum(r[1] for r in rs if r[2][d] == v)
            if below + at >= goal:
                break
            below += at
        assert min(abs(below - goal), abs(below + at - goal)) <= tolerance * total / k, "a heavy value: not for this test"
        takes = abs(below + at - goal) <= abs(below - goal)
        left = [r for r in rs if r[2][d] < v or (takes and r[2][d] == v)]
        chosen = {r[0] for r in left}
        split(left, first, k // 2)
        split([r for r in rs if r[0] not in chosen], first + k // 2, k - k // 2)

    split(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_equal_the_recursive_tree(spark, shards):
    rng = random.Random(shards)
    rows = [(i, rng.randint(50, 100), (rng.randint(-5000, 5000), rng.randint(0, 10 ** 9))) for i in range(900)]
    df = spark.createDataFrame([(i, w, a, b) for i, w, (a, b) in rows], "id long, w long, a long, b long")
    got = kdshards.shard(df, shards, F.col("w"), {"a": F.col("a"), "b": F.col("b")}, [F.col("id")]).collect()
    assert {r["id"]: r["shard"] for r in got} == plain_tree(rows, shards)
