"""The join, search, sharding, decontamination and URL operators against brute force."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidepool.llm import bitslice, decontaminate, jaccard, kdshards, queries, shingles, urlrules
from tidepool.sources.tables import load

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, len(s), root(i)) for i, s in flat)


def near_copies(seed, groups=6, words=60):
    rng, rows, n = np.random.default_rng(seed), [], 0
    for g in range(groups):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(3, words)))]
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = f"x{rng.integers(50)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_join_finds_the_components_of_brute_force(spark, k, num, den):
    rows = near_copies(k) + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "a b c"), (905, "a\tb\nc"), (905, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted(tuple(r) for r in jaccard.jaccard_join(docs, k, num, den).collect())
    assert got == brute_components(rows, k, num, den)


def test_jaccard_join_on_given_documents(spark):
    docs = load(spark, SF_SMALL, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op5_jaccard(spark, SF_SMALL).collect())
    assert got == brute_components(rows, 4, 85, 100)


def test_jaccard_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(docs).collect() == []


def test_a_cell_is_shared_by_every_linked_pair():
    rng = np.random.default_rng(5)
    edges = jaccard.bands(100_000)
    for n in [1, 2, 5, 6, 7, 12, 13, 40, 100, 333, 1000]:
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(20):
            # as different as the threshold allows: some left out, some put in
            out, new = int(rng.integers(0, n)), int(rng.integers(0, n))
            other = np.unique(np.concatenate([base[out:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            a = np.unique(base)
            shared = len(np.intersect1d(a, other))
            if 100 * shared >= 85 * (len(a) + len(other) - shared):
                assert set(jaccard.cells(a, 85, 100, edges).tolist()) & set(jaccard.cells(other, 85, 100, edges).tolist())


def test_tree_pairs_drop_no_pair_that_the_minima_allow():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 6, (20, jaccard.BOUND_GROUPS))
    points = np.concatenate([np.clip(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0, None) for _ in range(12)])
    comp = rng.integers(0, 4, len(points))
    got = {tuple(sorted(p)) for part in jaccard.tree_pairs(points, comp, 85, 100) for p in part.tolist()}
    size = points.sum(1)
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if comp[i] != comp[j]
            and jaccard.enough(int(np.minimum(points[i], points[j]).sum()), size[i], size[j], 85, 100)}
    assert got == want and want


def test_shingle_sets_of_whole_texts():
    long = " ".join(f"w{i}" for i in range(30_000))
    sets = shingles.shingle_sets(["A b  C d", "a\tb\nc d", None, "", "a b", long], 4)
    assert sets[0].tolist() == sets[1].tolist() and [len(s) for s in sets] == [1, 1, 0, 0, 1, 29_997]


def exact_top(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, x) in enumerate(ok):
        if q % 50:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for at, (i, y) in enumerate(ok) if at != own and len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_is_exact_with_ties_nulls_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(6)] + [rows[7], rows[50], rows[50], (50, rows[8][1])]
    rows += [(500, None), (501, [None] * 16), (502, [float("nan")] * 16), (550, [float("inf")] + [0.0] * 15),
             (600, [0.0] * 16), (650, []), (651, []), (700, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in bitslice.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == exact_top(rows, 5)
    assert bitslice.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_top_k_over_many_blocks_and_very_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", 40)
    monkeypatch.setattr(bitslice, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(bitslice, "BLOCK_CELLS", 6000)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 5000 if i % 25 == 0 else 8)]) for i in range(500)]
    rows += [(1000, [3e9] * 8), (1001, [-3e9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(tuple(r) for r in bitslice.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()) == exact_top(rows, 5)


def test_bit_sliced_sums_equal_plain_ones():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-150, 150, (200, 12)), rng.integers(-150, 150, 12)
    block = bitslice.Block(x, drop=0)
    total = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(np.int64) << b) for b, s in enumerate(block.scores(q)))
    full = (1 << block.bits) - 1
    assert (total + (q * block.low).sum() - full * -q[q < 0].sum() == x @ q).all()


def check_shards(rows, shards, tolerance):
    slots, weight = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert set(slots) <= set(range(shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(weight.values()) / shards
    assert max(weight.values()) <= mean * (1 + tolerance) + max(r["size"] for r in rows)


def test_shards_hold_near_equal_bytes(spark):
    rows = queries.op7_kdshards(spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in load(spark, SF_SMALL, "documents").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    check_shards(rows, 24, 0.2)


def _sharded(spark, data, shards):
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    df = df.select("doc_id", kdshards.size_of(F.col("text")).alias("size"), kdshards.checksum(F.col("text")).alias("sum"), "shard")
    return kdshards.shard(df, shards, F.col("size"), {"size": F.col("size"), "text": F.col("sum")}, [F.col("doc_id")])


def test_equal_texts_stay_together_unless_too_heavy(spark):
    rng = np.random.default_rng(3)
    data = [(i, "x" * int(rng.integers(1, 300))) for i in range(3000)] + [(5000 + i, "copy " * 30) for i in range(12)]
    data += [(None, None), (7, ""), (7, "")]
    rows = _sharded(spark, data, 6).collect()
    assert len(rows) == len(data)
    check_shards(rows, 6, 0.05)
    assert len({r["shard"] for r in rows if r["doc_id"] and r["doc_id"] >= 5000}) == 1
    hot = _sharded(spark, [(i, "same text" if i % 3 else f"t{i}") for i in range(2000)], 6).collect()
    check_shards(hot, 6, 0.05)


def test_shards_of_few_rows_and_none(spark):
    assert _sharded(spark, [], 4).collect() == []
    check_shards(_sharded(spark, [(1, "a"), (1, "a")], 4).collect(), 4, 10)


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        for a in range(max(len(x) - 13, 0) + 1) if x else ():
            g = x[a:a + 13]
            for p in range(len(w) - len(g) + 1):
                if w[p:p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocab = [f"v{i}" for i in range(30)]
    line = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, line(int(rng.integers(10, 30)))) for i in range(12)] + [(20, "Solo"), (21, "two words"), (22, ""), (23, None), (24, "ÀB c-d 9")]
    items.append((30, items[0][1]))
    docs = [(i, f"{line(20)}, {rng.choice([t for _, t in items if t])}! {line(5)}") for i in range(60)]
    docs += [(100, None), (101, ""), (102, "solo " * 500), (102, "solo"), (103, "TWO--WORDS"), (104, "Àb C d 9"), (None, items[1][1])]
    docs += [(105, line(5000) + " " + items[2][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect()]
    want = [(i, *brute_hits(t, items)) for i, t in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)  # the way for large benchmarks
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    none = decontaminate.decontaminate(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0 and decontaminate.decontaminate(df.limit(0), bench).collect() == []


def brute_rule(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(p), h + p, v) for h, p, v in rules if m and host and ("." + host).endswith("." + h) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_url_rules_match_brute_force(spark):
    rules = [*queries.URL_RULES, ("com", "/en/deep/", "block"), ("a.example.com", "/", "block"), ("b.a.example.com", "/x", "allow")]
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "notexample.com", "x.net", "net", "a.example.com", "c.b.a.example.com",
             "example.com:80", "", "example.org"]
    paths = ["", "/", "/en/", "/en", "/en/deep/1", "/es/9", "/fr/", "/x/y"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#f")] + [None, "", "no scheme", "a://b://c/", "http://"]
    urls += ["http://www.example.com/en/hot"] * 500
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(df, table).collect())
    assert got == [(i, *brute_rule(u, rules)) for i, u in enumerate(urls)]
    assert {r["verdict"] for r in urlrules.judge(df, table.limit(0)).collect()} == {"allow"}
    assert urlrules.judge(df.limit(0), table).collect() == []


def test_near_copies_leave_no_tables_but_those_the_result_reads(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{i}" for i in range(4_000)], k=150)) for _ in range(40)]
    texts = base + [t + f" tail{i}" for i, t in enumerate(base)] + [t.replace(" ", "  ") for t in base[:5]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, base[0]), (500, ""), (500, ""), (501, None)]
    monkeypatch.setattr(jaccard, "work_path", lambda s, name: f"file://{tmp_path}/{name}")
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100)
    assert {p.name for p in (tmp_path / "jaccard").iterdir()} <= {"again", "apart"}
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 500, 500, 501]


def test_a_point_is_sent_short_and_loses_no_link():
    rng = np.random.default_rng(6)
    for n in (1, 40, 300, 2_000, 9_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:n * 9 // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        x, y = jaccard.point(a), jaccard.point(b)
        s, t = jaccard.walked(x), jaccard.walked(y)
        assert s.sum(dtype=np.int64) == len(a) and len(s) <= max(jaccard.WALK_GROUPS, min(jaccard.MOST_GROUPS, len(x) // 4))
        assert jaccard.overlap_bound(s, t) >= jaccard.overlap_bound(x, y) >= len(np.intersect1d(a, b))
        assert n < 2_000 or 2 * len(jaccard.pack(s)) < len(jaccard.pack(x))
    heavy = np.full(256, 255, np.uint8)  # counts that no byte holds together stay apart
    assert (jaccard.walked(heavy) == heavy).all()


def test_cells_are_stored_in_six_bytes():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 30, 700)]
    cells = [jaccard.cells(h, 80, 100, jaccard.bands(2_000)) for h in sets]
    packed = pa.array([jaccard.pack_cells(c) for c in cells], pa.binary())
    assert [len(v.as_py()) for v in packed] == [6 * len(c) for c in cells]
    assert (jaccard.unpack_cells(packed).view(np.uint64) == np.concatenate(cells)).all()
    assert len(jaccard.unpack_cells(packed.slice(0, 0))) == 0
