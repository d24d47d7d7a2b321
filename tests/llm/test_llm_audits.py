"""Source divergence, conversation repair and secret scans against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidepool.llm import conversations as cv
from tidepool.llm import divergence, leaks, queries
from tidepool.sources.tables import load

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- source divergence -------------------------------------------------------

def brute_divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    df, out = defaultdict(Counter), []
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept}
        counts = defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                counts[source].update(terms)
        p = {s: price(c) for s, c in counts.items()}
        q = price(sum(counts.values(), Counter()))
        for s in counts:
            found = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s],
                     "term": [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def divergent_rows(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)] + ["É", "é", "ÀB", "漢字", "😀x", "İ"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "É"]),
             " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, k=rng.randrange(40)))) for _ in range(n)]
    return rows + [("en", "only", "1 2 3"), ("xx", "a", "word word"), ("xx", "b", ""), ("xx", "c", None), ("en", "a", "wa" * 50_000), ("", "", "waa wab")] + rows[:20]


def test_divergence_equals_brute_force(spark):
    rows = divergent_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for name in ("value", "rank", "id", "term", "total", "n", "item"):
        docs = docs.withColumn(name, F.lit("clash"))
    for min_docs, top in ((1, 1000), (30, 50), (60, 3), (10_000, 50)):
        got = sorted(tuple(r) for r in divergence.audit(docs, min_docs, top).collect())
        assert got == brute_divergence(rows, min_docs, top)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_divergence_over_several_chunks_and_held_counts(spark, monkeypatch):
    rows = divergent_rows(2)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(tuple(r) for r in divergence.audit(docs, 5, 20).collect()) == brute_divergence(rows, 5, 20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prices_are_exact_for_large_counts(spark):
    n, total = [0, 7, 10**12 + 3, 8 * 10**15], 9 * 10**15 - 11
    want = [1 + 10**9 * (x + 5) // total for x in n]
    assert divergence.price(np.array(n), total).tolist() == want
    got = spark.createDataFrame([(x,) for x in n], "n long").select(divergence._price(F.col("n"), F.lit(total))).collect()
    assert [r[0] for r in got] == want


# --- conversation repair -----------------------------------------------------

def row_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not last else "d" if (role, text) in seen else "-" if last[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """The cheapest edits by a search over all audits in order of cost, then of letters."""
    import heapq
    faults = row_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, said = heapq.heappop(heap)
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        if i == len(rows) and roles[-1:] in ("", "a"):
            return cost, audit, list(said)
        good = lambda c: re.fullmatch(r"s?(ua)*u?", roles + c)
        for c, role in (("u", "user"), ("a", "assistant")):
            if good(c):
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + c, said + ((role, ""),)))
        if i == len(rows):
            continue
        (role, text), more = rows[i], faults[i] == "t"
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, said))
        if faults[i] in "-t":
            if good(role[:1] or "?"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], said + ((role, text),)))
            for c, new in (("u", "user"), ("a", "assistant")):
                if good(c):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + c, said + ((new, text),)))


def brute_report(rows):
    """(conv_id, turn, role, text) rows after damage of one conversation, in order -> the query's columns."""
    said = [(r, t) for _, r, t in rows]
    turns = [x for x, _, _ in rows if x is not None]
    faults = row_faults(said)
    cost, audit, out = brute_repair(said)
    initials = "".join(r[:1] or "?" for r, _ in said)
    return ((max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def brute_conversations(rows):
    out, by_conv = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by_conv[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, said in by_conv.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out[conv] = brute_report(said) if said else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return out


LINES = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "ux"]), st.sampled_from(["Hi.", "no", "", " \n", "x!", "y? "])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(rows=LINES, cut=st.integers(1, 4))
def test_blocks_and_checkpoints_give_the_least_edits(rows, cut):
    lines = [(r[:1], f, 1) for (r, _), f in zip(rows, row_faults(rows))]
    blocks = [lines[i:i + cut] for i in range(0, len(lines), cut)]
    behind, v = [], np.array(cv.END)
    for b in reversed(blocks):
        behind.append(tuple(v.tolist()))
        v = (cv.matrix(b) + v).min(1)
    audit, q = "", cv.ENTER
    for b, last in zip(blocks, reversed(behind)):
        made, q = cv.walk(b, q, last)
        audit += "".join(c for m in made for c, _ in m)
    audit += "".join(c for c, _ in cv.closing(q))
    cost, want, _ = brute_repair(rows)
    assert audit == want and int(v[cv.ENTER]) == cost


def conversation_rows(seed=3):
    rng, rows = random.Random(seed), []
    texts = ["Hello there.", "and so", "What?", "", " \t", "Yes!", None, "é. ", "one. two"]
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2), role, rng.choice(texts)))
    return rows + [(900, 1, "user", "long " * 60_000 + ".")] + rows[:12]


@pytest.mark.parametrize("least", [2, 1024])
def test_repair_equals_brute_force(spark, least):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("place", "edits", "block", "copies", "cost", "kind"):
        df = df.withColumn(name, F.lit("clash"))
    edits = cv.repair(df, cv.damage(df), least_block=least)
    said = {r["conv_id"]: r["repaired_sha256"] for r in cv.digests(edits.turns).collect()}
    report = edits.report.collect()
    got = {r["conv_id"]: (*r[1:], said.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in report}
    assert len(report) == len(got) and got == brute_conversations(rows)
    assert cv.repair(df.limit(0)).report.collect() == []


def test_a_conversation_of_many_blocks(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"text {i if rng.random() < 0.9 else 0}.") for i in range(3000)]
    rows += [(1, 5000, "user", "again.")] * 500 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    few, many = (cv.repair(df, least_block=n) for n in (100_000, 16))
    assert sorted(few.report.collect()) == sorted(many.report.collect())
    got = {r["conv_id"]: r for r in many.report.collect()}
    assert got[2]["audit"] == "KK" and got[1]["duplicate"] >= 499
    roles = [r["role"][0] for r in many.turns.filter("conv_id = 1").orderBy("place", "part").collect()]
    assert re.fullmatch("s?(ua)+", "".join(roles))


def test_query_over_the_given_conversations(spark):
    rows = [tuple(r) for r in load(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in queries.op12_conversations(spark, SF_SMALL).collect()}
    assert got == brute_conversations(rows)


# --- secret scans ------------------------------------------------------------

def brute_base(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 12]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [x for _, _, x in sorted(out)]


PIECES = st.sampled_from(["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "=", " : ", '"', "'", " ", "\n", "abcdef0123456789", "deadbeef", "AKIA",
                          "ABCDEFGH1234567890", "é😀", "hunter2-x", "Kſ", "tokſen", "+/_.=-", "x" * 12, ":", "= "])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_equal_plain_patterns(text):
    spans = sorted(leaks.base_spans(text), key=lambda s: (s[0], leaks.KINDS.index(s[2])))
    assert [f"{k}:{s}:{e}" for s, e, k in spans] == brute_base(text)


def all_segmentations(piece, costs):
    """The least cost over every way to cut a piece, with brute force and words only."""
    best = float("inf")
    for cuts in itertools.product((0, 1), repeat=len(piece) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(piece[at:i])
                at = i
        parts.append(piece[at:])
        for how in itertools.product((0, 1), repeat=len(parts)):
            if all(not w or p in costs for p, w in zip(parts, how)):
                best = min(best, sum(1 + (costs[p] if w else sum(leaks._brute(c) for c in p)) for p, w in zip(parts, how)))
    return best


@settings(max_examples=60, deadline=None)
@given(st.text("bkz9", min_size=1, max_size=7))
def test_the_dynamic_programme_finds_the_least_cost(piece):
    costs = {"bkz": 5.0, "kzb": 4.0, "zzk": 3.0, "zkb": 9.0, "bkzk": 2.5}
    plain = all_segmentations(piece, costs)
    assert leaks.guess_bits(piece, costs) <= plain + 1e-9
    if not re.search(r"(.)\1|(..+)\2|99", piece) and "zb" not in piece and "kb" not in piece and "kz" not in piece:
        assert abs(leaks.guess_bits(piece, costs) - plain) < 1e-9


def test_cheap_and_costly_values():
    words = dict.fromkeys(leaks.COMMON, leaks.COMMON_BITS) | {"correct": 14.0, "horse": 13.0}
    for cheap in ("password123", "P4ssw0rd!", "aaaaaaaaaaaaaaaa", "qwertyuiop", "asdfghjkl;", "1990-12-31", "12345678901", "abababababab",
                  "changeme", "xxxxxxxxxxxx", "your_token_here", "****************", "correcthorse"):
        assert leaks.guess_bits(cheap, words) < leaks.SECRET_BITS, cheap
    for costly in ("hT7$kq2Zp!", "x9fK2mQ7vB", "wJalrXUtnFEMI/K7MDENG", "83746520918273645"):
        assert leaks.guess_bits(costly, words) >= leaks.SECRET_BITS, costly


def test_scan_finds_planted_secrets_and_leaves_words(spark):
    prose = "the thention of whaning is here and there was thention in whaning "
    rows = [(1, "login pwd is hT7$kq2Zp! and so"), (2, "password: hunter"), (3, "the secret: thention of it, token = whaning."),
            (4, "Authorization: Bearer x9fK2mQ7vB8 end"), (5, "é😀 pass=Zk8#mmQ1p, next"), (6, 'token = "6838a6ec953eec92e8f68d7c24ee4c3f"'),
            (7, None), (8, ""), (9, prose * 3000), (9, "passphrase: " + "q7" * 60 + "X"), (None, "api key: yT5#wq88Lk"), (10, "pin: changeme1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "id", "base", "spans", "values", "word"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = leaks.scan(docs).collect()
    assert len(got) == len(rows)
    texts = {(i, t): t for i, t in rows}
    found = defaultdict(list)
    for r in got:
        for s in r["spans"]:
            if s["kind"] == "guess":
                found[r["doc_id"]].append(s)
    cut = lambda i, t: [t[s["start"]:s["end"]] for s in found[i]]
    assert cut(1, rows[0][1]) == ["hT7$kq2Zp!"] and cut(4, rows[3][1]) == ["x9fK2mQ7vB8"] and cut(5, rows[4][1]) == ["Zk8#mmQ1p"]
    assert cut(None, rows[10][1]) == ["yT5#wq88Lk"]
    assert not found[2] and not found[3] and not found[6] and not found[9] and not found[10]
    assert [[s["kind"] for s in r["spans"]] for r in got if r["doc_id"] == 6] == [["assign", "hex"]]
    assert len(texts) == len(rows) and leaks.scan(docs.limit(0)).collect() == []


def test_query_over_the_given_documents(spark):
    got = {r["doc_id"]: r for r in queries.op13_leaks(spark, SF_SMALL).collect()}
    for r in load(spark, SF_SMALL, "documents").collect():
        base = brute_base(r["text"])
        row = got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert [x for x in row["spans"].split(",") if x and not x.startswith("guess")] == base
