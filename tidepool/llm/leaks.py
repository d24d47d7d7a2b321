"""Secret scans by password guess cost.

Base findings are formats: an assignment to a key named like a credential
(``assign``, the whole match), an access key id (``access``) and a long run of hex
digits (``hex``). The method adds findings of kind ``guess``: values that stand where a
credential stands ("pwd is ...", "Authorization: Bearer ...") and are costly to guess.

The cost of a value is that of its cheapest segmentation, found by dynamic
programming over its prefixes, in bits: words (rarer words in the corpus cost
more; capitals and digits written for letters cost extra), dates and years, repeats of a sign or
of what came just before, keyboard walks and letter or digit sequences, and
single signs by brute force. A value that a guesser reaches only after
2 ** ``SECRET_BITS`` tries or more is a secret; names, words, dates and
placeholders after a key are not.

Word counts come from the whole corpus, less the values themselves: each task
counts the words it reads and gives on those that some value needs (told by a
bit table of fixed size; words let through by chance find no value in the
join). Values are distinct before they are costed and joined back by row, so a
value that stands in a third of the documents is costed once.

Results by case: null and empty texts have no spans; texts and values are read
whole, a value beyond ``PIECE`` signs costs the sum of its pieces; repeated rows
give equal rows; an empty table gives an empty table; other columns are not
read, whatever their names. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from .divergence import terms_of

SECRET_BITS = 32.0       # a value of fewer bits is guessed
LEAST_VALUE = 8          # signs of a value that is costed
PIECE = 128              # signs that are segmented at a time
WORD_SIZES = 3, 16       # signs of a word in a value
HELD_WORDS = 200_000     # distinct words that a task holds before it gives its counts on
TABLE_BITS = 1 << 23     # of the table of needed words
KINDS = ("assign", "access", "hex", "guess")

# The base formats.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_SIGNS, ACCESS_SIGNS, HEX_SIGNS = 12, 18, 16

# Where a credential's value stands. What stands in the value is anything but space, quotes and brackets.
_CONTEXT = re.compile(r"""
    (?: password|passwd|passphrase|passcode|(?<![A-Za-z])pass|pwd|secret|token|(?:api|access|private|client|encryption|signing)[_\-\x20]?key
      | credentials?|auth(?:orization)?|bearer|(?<![A-Za-z])pin(?![A-Za-z]) )
    ["']? (?: \x20*(?::=|=>|[:=])\x20* | \x20+(?:is|was)\x20+:?\x20* )
    (?:(?:bearer|basic|token)\x20+)? ["'`]?
    ([^\x00-\x20\x7F"'`<>,;(){}\[\]|\\]+)
""", re.I | re.A | re.X)
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"cred", b"auth", b"bearer", b"pin")
_HEX_BYTES = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))

# What guessers try first, each as good as a very common word.
COMMON = ("password passwd secret token admin administrator root user guest test testing example sample demo default changeme "
          "change letmein welcome login master qwerty dragon monkey football iloveyou sunshine princess shadow none null true "
          "false undefined required optional string your here replace placeholder insert value hidden redacted removed "
          "private public access auth bearer basic key api client server service account").split()
COMMON_BITS = 7.0
# Keys in rows as they lie, each row a little to the right of the one above.
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./")
_LEET = str.maketrans("013457@$!", "oleastasi")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d)", re.A)
_YEAR = re.compile(r"(?:19|20)\d\d", re.A)
DATE_BITS, YEAR_BITS, SEPARATED_BITS, SEGMENT_BITS = log2(365 * 200), log2(200), 2.0, 1.0
MOST_REPEATED = 16       # signs of a block that may be repeated


def _keyboard() -> dict[tuple[str, str], int]:
    """(key, next key) -> direction."""
    place = {k: (2 * x + y, y) for y, row in enumerate(_ROWS) for x, k in enumerate(row)}
    return {(a, b): 10 * (bx - ax) + (by - ay) for a, (ax, ay) in place.items() for b, (bx, by) in place.items()
            if a != b and abs(by - ay) <= 1 and abs(bx - ax) <= (2 if ay == by else 1)}


_NEXT_KEY = _keyboard()


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base formats, leftmost and not overlapping per kind."""
    raw, out = text.encode("utf-8", "surrogatepass") if raw is None else raw, []
    low = raw.lower()
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_SIGNS]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_SIGNS]
    if b"h" * HEX_SIGNS in raw.translate(_HEX_BYTES):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def context_values(text: str, raw: bytes | None = None) -> list[tuple[int, int]]:
    """(start, end) of the values that stand where a credential stands."""
    low = (text.encode("utf-8", "surrogatepass") if raw is None else raw).lower()
    if not any(h in low for h in _HINTS):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".:":  # the end of a sentence
            end -= 1
        if end - start >= LEAST_VALUE:
            out.append((start, end))
    return out


def words_in(piece: str) -> list[str]:
    """What may be a word in a piece of a value: its letter runs and their parts, lower-cased and read as letters."""
    out = set()
    for form in {piece.lower(), piece.lower().translate(_LEET)}:
        for run in re.findall(r"[^\W\d_]+", form):
            for size in range(WORD_SIZES[0], min(WORD_SIZES[1], len(run)) + 1):
                out.update(run[i:i + size] for i in range(len(run) - size + 1))
    return sorted(out)


def _brute(c: str) -> float:
    if "0" <= c <= "9":
        return log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log2(26)
    if c in "-_.":  # between words, tried first
        return 2.0
    return log2(33) if c < "\x80" else log2(100)


def guess_bits(piece: str, word_bits: dict[str, float]) -> float:
    """The least cost of a segmentation of ``piece``; ``word_bits``: what each known word costs."""
    n, low = len(piece), piece.lower()
    plain, keys = low.translate(_LEET), low.translate(_SHIFTED)
    best = [0.0] + [float("inf")] * n
    brute = [float("inf")] * (n + 1)  # the best way that ends with a sign by brute force

    def offer(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for i in range(n):
        here = best[i] + SEGMENT_BITS
        brute[i + 1] = _brute(piece[i]) + min(brute[i], here)
        offer(i + 1, brute[i + 1])
        for size in range(WORD_SIZES[0], min(WORD_SIZES[1], n - i) + 1):
            for form in (low, plain):
                bits = word_bits.get(form[i:i + size])
                if bits is not None:
                    part = piece[i:i + size]
                    capitals = sum(c.isupper() for c in part)
                    bits += 0 if not capitals else 1 if capitals == size or (capitals == 1 and part[0].isupper()) else capitals
                    bits += sum(a != b for a, b in zip(low[i:i + size], form[i:i + size]))
                    offer(i + size, here + bits)
        for pattern, bits in ((_DATE, DATE_BITS), (_YEAR, YEAR_BITS)):
            m = pattern.match(piece, i)
            if m:
                offer(m.end(), here + bits + (SEPARATED_BITS if re.search(r"[^0-9]", m[0]) else 0))
        # the same sign again and again, a sequence, a walk over the keys
        j = i + 1
        while j < n and piece[j] == piece[i]:
            j += 1
            offer(j, here + _brute(piece[i]) + log2(j - i))
        j = i + 1
        step = ord(piece[j]) - ord(piece[i]) if j < n else 0
        while j < n and step in (1, -1) and ord(piece[j]) - ord(piece[j - 1]) == step and piece[j].isalnum():
            j += 1
            if j - i >= 3:
                offer(j, here + 1 + _brute(piece[i]) + log2(j - i))
        j, turns, way = i + 1, 0, None
        while j < n and (keys[j - 1], keys[j]) in _NEXT_KEY:
            now = _NEXT_KEY[keys[j - 1], keys[j]]
            turns += now != way
            way, j = now, j + 1
            if j - i >= 3:
                offer(j, here + log2(47) + 2 * turns + log2(j - i) + (low[i:j] != keys[i:j] or piece[i:j] != low[i:j]))
        # what came just before, once more or several times
        for size in range(2, min(MOST_REPEATED, i, n - i) + 1):
            j = i
            while piece[j:j + size] == piece[i - size:i]:
                j += size
                offer(j, here + 1 + log2(size) + log2((j - i) // size))
    return best[n]


def pieces(value: str) -> list[str]:
    return [value[i:i + PIECE] for i in range(0, len(value), PIECE)]


def word_cost(count: int, total: int) -> float:
    """Bits of a word that stands ``count`` times among ``total``."""
    return log2(1 + total / count)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, base, values): the spans of base formats, and of costed values with their texts."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    value = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for b in batches:
        base, values = [], []
        for raw in b.column(1):
            raw = raw.as_py()
            text = raw.decode("utf-8", "replace")
            found = base_spans(text, raw)
            base.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
            values.append([{"start": s, "end": e, "value": text[s:e]} for s, e in context_values(text, raw)
                           if not any(x <= s and e <= y for x, y, _ in found)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(values, value)], names=["id", "base", "values"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value) to (value, place, piece, words)."""
    for b in batches:
        rows = [(v.as_py(), i, p) for v in b.column(0) for i, p in enumerate(pieces(v.as_py()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()),
             pa.array([words_in(r[2]) for r in rows], pa.list_(pa.string()))], names=["value", "place", "piece", "words"])


def _word_counter(needed: bytes):
    """Counts, per task, of the words that the bit table names, and of all words (as '')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            total = sum(held.values())
            at = {w: zlib.crc32(w) % TABLE_BITS for w in held}
            rows = [(w, n) for w, n in held.items() if needed[at[w] >> 3] >> (at[w] & 7) & 1] + [(b"", total)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

        for b in batches:
            for raw in b.column(0):
                raw = raw.as_py()
                if any(h in raw.lower() for h in _HINTS):
                    text = raw.decode("utf-8", "replace")
                    at = 0
                    rest = []
                    for s, e in context_values(text, raw):  # a value teaches no word
                        rest.append(text[at:s])
                        at = e
                    raw = " ".join([*rest, text[at:]]).encode("utf-8", "surrogatepass")
                held.update(terms_of(raw))
            if len(held) > HELD_WORDS:
                yield given()
        yield given()

    return run


def _bits(total: int):
    """(value, place, piece, known words with counts) to (value, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = dict.fromkeys(COMMON, COMMON_BITS)
        for b in batches:
            bits = []
            for piece, known in zip(b.column(1), b.column(2)):
                costs = {k["word"]: word_cost(k["n"], total) for k in known.as_py() or ()}
                costs.update({w: min(c, costs.get(w, c)) for w, c in common.items()})
                bits.append(guess_bits(piece.as_py(), costs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.float64())], names=["value", "bits"])

    return run


def needed_table(words: DataFrame) -> bytes:
    """A bit for each word's checksum: at most ``TABLE_BITS / 8`` bytes, whatever the number of words."""
    at = F.crc32(F.col("word").cast("binary")) % TABLE_BITS
    rows = words.select(at.alias("at")).groupBy((F.col("at") / 32).cast("int").alias("slot")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 AS int))")).alias("bits"))
    out = bytearray(TABLE_BITS // 8)
    for r in rows.toLocalIterator():  # a bounded number of rows
        out[4 * r["slot"]:4 * r["slot"] + 4] = int(r["bits"]).to_bytes(4, "little")
    return bytes(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", secret_bits: float = SECRET_BITS) -> DataFrame:
    """One row per document: its id and ``spans``, (start, end, kind) by start, then kind as in ``KINDS``."""
    spark = docs.sparkSession
    path = work_path(spark, "leaks")

    def written(df: DataFrame, name: str) -> DataFrame:
        """A table in the shared folder: computed once, and it cuts the lineage."""
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    kind = docs.schema[id_col].dataType.simpleString()
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    span = "struct<start:int,end:int,kind:string>"
    found = written(docs.select(F.col(id_col).alias("id"), raw.alias("text")).mapInArrow(
        _found, f"id {kind}, base array<{span}>, values array<struct<start:int,end:int,value:string>>")
        .withColumn("row", F.monotonically_increasing_id()), "found")
    stand = found.select("row", F.explode("values").alias("v")).select("row", "v.start", "v.end", "v.value")
    cut = written(stand.select("value").distinct().mapInArrow(_cut, "value string, place int, piece string, words array<string>"), "pieces")
    needed = cut.select("value", "place", F.explode("words").alias("word"))
    counts = written(docs.select(raw.alias("text")).mapInArrow(_word_counter(needed_table(needed)), "word binary, n long")
                     .groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n")), "words")
    total = counts.filter("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = needed.join(counts.filter("word != ''"), "word").groupBy("value", "place").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    bits = cut.select("value", "place", "piece").join(known, ["value", "place"], "left").select("value", "piece", "known") \
        .mapInArrow(_bits(int(total)), "value string, bits double").groupBy("value").agg(F.sum("bits").alias("bits"))
    secret = written(bits.filter(F.col("bits") >= secret_bits).select("value"), "secret")
    added = stand.join(secret, "value").groupBy("row").agg(F.collect_list(F.struct("start", "end", F.lit("guess").alias("kind"))).alias("added"))
    # by start, then by the kinds' own order
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    both = F.concat("base", F.coalesce("added", F.array().cast(f"array<{span}>")))
    return found.join(added, "row", "left").select(
        F.col("id").alias(id_col),
        F.transform(F.array_sort(F.transform(both, place)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))
