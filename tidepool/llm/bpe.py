"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can end its encoding. The
encoder stores that last token per prefix: the encoding of any prefix is read
by walking back, bytes can be appended without touching what was stored, and
an edit recomputes only until the stored tokens agree again.

The ids equal those of greedy lowest-rank-first merging (tested against
tiktoken). Results by case: null text encodes like the empty text (no ids);
repeated rows give equal ids; texts of any length are encoded whole, in time
proportional to their length.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_parts, map_column

# pre-tokens, token pairs and moves between suffixes remembered per task (memory bound)
CACHE_ENTRIES, PAIR_ENTRIES, MOVE_ENTRIES = 250_000, 800_000, 400_000
PART_CHARS = 1_000_000  # characters whose pieces are learnt together
_NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """Last-token table over the prefixes of one pre-token at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.raw = {r: b for b, r in ranks.items()}
        self._edges: dict[tuple[int, bool], list[tuple[bytes, int]] | None] = {}
        self._pairs: dict[int, bool] = {}  # by left rank << 32 | right rank
        # Suffixes of a text that begin some token, by number (0: none), with the tokens that end each.
        # At most as many as the vocabulary has bytes.
        self._begun = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self._suffixes, self._number = [b""], {b"": 0}
        self._ending: list[tuple[tuple[int, int], ...]] = [()]
        self._moves: dict[int, int] = {}  # by number << 8 | next byte

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes ``token``; None if merging never makes it."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            made = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            i = min(range(len(made)), key=made.__getitem__)
            if made[i] >= self.ranks[token]:
                return None
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _edge(self, rank: int, right: bool) -> list[tuple[bytes, int]] | None:
        """What the token shows at one end while it is being merged, smallest
        first: (bytes, rank at which it grows to the next)."""
        key = (rank, right)
        if key not in self._edges:
            steps, part, grows = [], self.raw[rank], _NEVER
            while True:
                steps.append((part, grows))
                if len(part) == 1:
                    break
                halves = self._halves(part)
                if halves is None:
                    steps = None
                    break
                grows = self.ranks[part]
                part = halves[right]
            self._edges[key] = steps and steps[::-1]
        return self._edges[key]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a b`` ends in exactly those two tokens.

        Merges happen in rank order, so both ends grow along their edges by
        rank; the pair holds if no merge across the border comes first. A
        merge inside ``a`` stands left of the border and wins a tie with it;
        one inside ``b`` stands right and loses it.
        """
        known = self._pairs.get(a << 32 | b)
        if known is None:
            left, right = self._edge(a, True), self._edge(b, False)
            known = left is not None and right is not None
            i = j = 0
            while known:
                (x, grow_x), (y, grow_y) = left[i], right[j]
                across = self.ranks.get(x + y, _NEVER)
                if across < grow_x and across <= grow_y and across != _NEVER:
                    known = False
                elif grow_x == grow_y == _NEVER:
                    break
                elif grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) >= PAIR_ENTRIES:
                self._pairs.clear()
            self._pairs[a << 32 | b] = known
        return known

    def _move(self, suffix: int, byte: int) -> int:
        """The number of the longest suffix that begins a token, after one more byte."""
        grown = self._suffixes[suffix] + bytes((byte,))
        while grown and grown not in self._begun:
            grown = grown[1:]
        number = self._number.get(grown)
        if number is None:
            number = self._number[grown] = len(self._suffixes)
            self._suffixes.append(grown)
            ending = (self.ranks.get(grown[i:]) for i in range(len(grown)))
            self._ending.append(tuple((t, len(self.raw[t])) for t in ending if t is not None and self._edge(t, True) is not None))
        if len(self._moves) >= MOVE_ENTRIES:
            self._moves.clear()
        self._moves[suffix << 8 | byte] = number
        return number

    def extend(self, data: bytes, last: list[int], suffixes: list[int], upto: int) -> None:
        """Grow ``last`` (``last[e]``: the token that ends prefix ``e``) and ``suffixes`` (the number
        of the longest suffix of prefix ``e`` that begins a token) to ``upto``. Only the tokens that
        end the suffix are tried, the longest first."""
        pairs, moves, ending = self._pairs, self._moves, self._ending
        suffix = suffixes[-1]
        for end in range(len(last), upto + 1):
            byte = data[end - 1]
            suffix_after = moves.get(suffix << 8 | byte)
            suffix = self._move(suffix, byte) if suffix_after is None else suffix_after
            for token, size in ending[suffix]:
                if size == end:
                    break
                before = last[end - size]
                known = pairs.get(before << 32 | token)
                if known or known is None and self.fits(before, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(token)
            suffixes.append(suffix)

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the longest stored prefix."""
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.raw[last[end]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; one that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(piece, last, [0], len(piece))
        return self.walk(last)


class EditableEncoding:
    """One pre-token's table, kept for appends and edits."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last, self.suffixes = encoder, b"", [-1], [0]
        self.recomputed = 0
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; stored prefixes stay as they are."""
        self.data += more
        self.encoder.extend(self.data, self.last, self.suffixes, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` for bytes ``start:stop``. Tokens after the edit are taken
        over once as many stored ones agree as the longest token has bytes."""
        old, tail, shift = self.last, self.data[stop:], len(new) - (stop - start)
        self.data = self.data[:start] + new + tail
        last, suffixes, agreed, self.recomputed = old[:start + 1], self.suffixes[:start + 1], 0, 0
        while len(last) <= len(self.data):
            end = len(last)
            self.encoder.extend(self.data, last, suffixes, end)
            self.recomputed += 1
            after = end - start - len(new)  # bytes beyond the edit that this prefix holds
            same = after > 0 and old[end - shift] == last[end] and \
                len(self.encoder.raw[last[end]]) <= after
            agreed = agreed + 1 if same else 0
            if agreed >= self.encoder.longest:
                last += old[end - shift + 1:]
                suffixes += self.suffixes[end - shift + 1:]
                break
        self.last, self.suffixes = last, suffixes

    def ids(self) -> list[int]:
        return self.encoder.encode(self.data)[:] if self.data in self.encoder.ranks \
            else self.encoder.walk(self.last)


class _Pieces(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet, in byte order: what a piece shares
        with the one before is a stored prefix, and only its own bytes are appended."""
        new = {p for p in pieces if p not in self}
        if len(self) + len(new) > CACHE_ENTRIES:
            self.clear()
            new = pieces
        encoder, last, suffixes, before = self.encoder, [-1], [0], b""
        for data, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in new):
            whole = encoder.ranks.get(data)
            if whole is not None:
                ids = [whole]
            else:
                shared = 0
                for x, y in zip(data, before):
                    if x != y:
                        break
                    shared += 1
                del last[shared + 1:], suffixes[shared + 1:]
                encoder.extend(data, last, suffixes, len(data))
                ids, before = encoder.walk(last), data
            self[piece] = struct.pack(f"<{len(ids)}I", *ids)


class Vocabulary:
    """All tokens' bytes in one buffer, so that ids become bytes by one gather."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values(), default=-1) + 1
        self.size = np.full(top + 1, -1, np.int64)
        self.first = np.zeros(top + 1, np.int64)
        at, parts = 0, []
        for token, rank in ranks.items():
            self.size[rank], self.first[rank] = len(token), at
            at += len(token)
            parts.append(token)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[np.minimum(ids, len(self.size) - 1)]
        if (size < 0).any():
            raise ValueError("an id outside the vocabulary")
        end = np.cumsum(size)
        if not len(end):
            return b""
        return self.bytes[np.repeat(self.first[ids] - (end - size), size) + np.arange(end[-1])].tobytes()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
           ids: str = "token_ids") -> DataFrame:
    """Append ``ids``: the text's token ids as little-endian unsigned 32-bit bytes.

    Each match of ``pattern`` is encoded separately; no special tokens. The
    vocabulary (tens of thousands of short strings, its size fixed) is
    broadcast. A column named like ``ids`` is replaced.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        import regex
        split, pieces = regex.compile(pattern).findall, _Pieces(PrefixEncoder(vocabulary.value))

        def part(texts: list) -> list[bytes]:
            cut = [split(t or "") for t in texts]
            pieces.learn(set().union(*cut))
            return [b"".join(map(pieces.__getitem__, c)) for c in cut]

        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(in_parts(texts, part, PART_CHARS), pa.binary())]
        return work

    return map_column(docs, text, T.StructType([_through(docs, text), T.StructField(ids, T.BinaryType())]),
                      lambda: _keeping(make()))


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids",
           decoded: str = "decoded") -> DataFrame:
    """Append ``decoded``: the bytes that the ids stand for (null ids: none).
    An id outside the vocabulary is an error."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        known = Vocabulary(vocabulary.value)

        def work(col: pa.Array) -> list[pa.Array]:
            return [col, pa.array((known.decode(np.frombuffer(v.as_py() or b"", "<u4")) for v in col), pa.binary())]
        return work

    return map_column(docs, ids, T.StructType([_through(docs, ids), T.StructField(decoded, T.BinaryType())]), make)


def token_count(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")


def _through(df: DataFrame, name: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name == name)


def _keeping(work):
    return lambda col: [col, *work(col)]
