"""Format-preserving pseudonyms by a keyed Feistel permutation.

Values are found by their format, checked (card numbers by their check digit,
bank accounts by their remainder, addresses by their range, dates by the
calendar; phone numbers have no check), turned into a whole number below the format's count of values, permuted by a Feistel network keyed with a
secret, and written back in the same format and punctuation. The permutation is
one to one and depends on the value alone, so equal values stay equal in all
documents and different ones stay different. Check digits of the result hold.

Results by case: null text stays null; text without values is unchanged; text
of any length is read whole; values that fail their check are left as they are;
repeated rows give equal results; the columns text and n_replaced are replaced.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_column

ROUNDS = 10
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
SMALL_BITS = 128
CACHE_ENTRIES = 100_000

# Formats. A run of digits and the signs that stand in numbers
# is found first; the formats are then tried inside it.
_RUN = re.compile(r"\d[\d .\-/()]*")
_NUMBER = re.compile(r"""
    (?P<phone>(?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))
  | (?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
  | (?P<iso>(?<![\w-])\d{4}-\d\d-\d\d(?!(?![Tt]\d)[\w-]))
  | (?P<dmy>(?<![\w./])\d{1,2}([./])\d{1,2}\5\d{4}(?![\w/]))
  | (?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))
  | (?P<card>(?<![\w-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))
""".replace(r"\5", r"(?P=sep)").replace("([./])", "(?P<sep>[./])"), re.X | re.A)
_IBAN = re.compile(r"[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]){11,30}")
# Letters and digits of a bank account number by country.
IBAN_SIZES = {c: int(n) for n, cs in {
    "15": "NO", "16": "BE", "18": "DK FI FO GL NL SD FK", "19": "MK SI", "20": "AT BA EE KZ LT LU XK MN",
    "21": "CH HR LI LV", "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL",
    "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM",
    "28": "AL AZ BY CY DO GT HN HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC",
    "33": "RU"}.items() for c in cs.split()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
# The value of a key is quoted, or goes on to a space or a sign that stands between values.
_SECRET = re.compile(r"""
    (?i:password|passwd|secret|token|api_key)\\?["']?[ \t]*[=:][ \t]*
    (?: \\?"((?:\\[^"]|[^"\\\n]){8,})\\?" | '((?:\\.|[^'\\\n]){8,})' | \\?["']?([^\s"'`<>,;&|(){}\[\]\\]{8,}) )
  | (?<![A-Za-z0-9])AKIA([A-Z0-9]{16})(?![A-Za-z0-9])
""", re.X)
_ALPHABETS = {"0": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz"}


class Feistel:
    """Keyed permutation of 0..n-1 for any n: x = u * b + v, the halves are
    shifted in turn by a keyed function of the other; values that land beyond
    n go through again until they land below."""

    def __init__(self, key: bytes):
        self.key = key

    def _shift(self, tag: str, n: int, i: int, half: int) -> int:
        """A keyed number of 192 bits, for larger n of 128 bits more than a half has."""
        bits = n.bit_length()
        text = f"{tag}|{n}|{i}|{half}" if bits <= SMALL_BITS else f"{tag}|{n:x}|{i}|{half:x}"
        mac = hashlib.blake2b(text.encode(), key=self.key, digest_size=24 if bits <= SMALL_BITS else 64).digest()
        return int.from_bytes(mac if bits <= SMALL_BITS else hashlib.shake_256(mac).digest(bits // 16 + 18), "big")

    @staticmethod
    def _sides(n: int) -> tuple[int, int]:
        a = 1 << ((n - 1).bit_length() + 1) // 2
        return a, -(-n // a)

    def permute(self, x: int, n: int, tag: str) -> int:
        a, b = self._sides(n)
        while n > 1:
            u, v = divmod(x, b)
            for i in range(0, ROUNDS, 2):
                u = (u + self._shift(tag, n, i, v)) % a
                v = (v + self._shift(tag, n, i + 1, u)) % b
            x = u * b + v
            if x < n:
                break
        return x

    def restore(self, x: int, n: int, tag: str) -> int:
        a, b = self._sides(n)
        while n > 1:
            u, v = divmod(x, b)
            for i in range(ROUNDS - 2, -1, -2):
                v = (v - self._shift(tag, n, i + 1, u)) % b
                u = (u - self._shift(tag, n, i, v)) % a
            x = u * b + v
            if x < n:
                break
        return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_rest(country: str, body: str, check: str = "00") -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _own(c: str) -> bool:
    """ASCII letters and digits are replaced, other characters stay."""
    return c.isascii() and c.isalnum()


def _refill(pattern: str, new: str) -> str:
    """The characters of ``new`` in the places where ``pattern`` has letters or digits."""
    it = iter(new)
    return "".join(next(it) if _own(c) else c for c in pattern)


class Pseudonymiser:
    """Finds, checks and replaces the values of one text. ``forward=False`` undoes it."""

    def __init__(self, key: bytes, forward: bool = True):
        f = Feistel(key)
        self.turn: Callable[[int, int, str], int] = f.permute if forward else f.restore
        self.known: dict[tuple[str, str], str | None] = {}

    def _digits(self, digits: str, tag: str) -> str:
        return str(self.turn(int(digits), 10 ** len(digits), tag + str(len(digits)))).zfill(len(digits))

    def _mixed(self, text: str, tag: str) -> str:
        """Letters and digits permuted together, each place keeping its kind; other characters stay."""
        kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in text if _own(c)]
        x, n = 0, 1
        for c, k in zip([c for c in text if _own(c)], kinds):
            x, n = x * len(_ALPHABETS[k]) + _ALPHABETS[k].index(c), n * len(_ALPHABETS[k])
        x, out = self.turn(x, n, f"{tag}:{''.join(kinds)}"), []
        for k in reversed(kinds):
            x, i = divmod(x, len(_ALPHABETS[k]))
            out.append(_ALPHABETS[k][i])
        return _refill(text, "".join(reversed(out)))

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, None if it fails its check."""
        if (kind, text) not in self.known:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[kind, text] = getattr(self, "_" + kind)(text)
        return self.known[kind, text]

    def _card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        new = self._digits(digits[:-1], "card")
        return _refill(text, new + luhn_digit(new))

    def _phone(self, text: str) -> str:
        """Numbers of the numbering plan (area and exchange from 200) stay in it, others outside it."""
        digits = "".join(c for c in text if c.isdigit())
        planned, ten = self._planned(digits[-10:]), digits[-10:]
        while True:
            ten = self._digits(ten, "phone")
            if self._planned(ten) == planned:
                return _refill(text, digits[:-10] + ten)

    @staticmethod
    def _planned(ten: str) -> bool:
        return ten[0] >= "2" and ten[3] >= "2"

    def _ssn(self, text: str) -> str | None:
        a, b, c = map(int, text.split("-"))
        if a in (0, 666) or a >= 900 or not b or not c:
            return None
        area = a - 1 - (a > 666)
        x = self.turn((area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, "ssn")
        x, c = divmod(x, 9999)
        area, b = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{b + 1:02d}-{c + 1:04d}"

    def _day(self, year: int, month: int, day: int) -> dt.date | None:
        try:
            x = dt.date(year, month, day).toordinal() - FIRST_DAY
        except ValueError:
            return None
        return dt.date.fromordinal(FIRST_DAY + self.turn(x, DAYS, "date")) if 0 <= x < DAYS else None

    def _iso(self, text: str) -> str | None:
        d = self._day(*map(int, text.split("-")))
        return d and d.isoformat()

    def _dmy(self, text: str) -> str | None:
        sep = "." if "." in text else "/"
        a, b, year = text.split(sep)
        # month first with a slash where that is a date, else day first
        if sep == "/" and int(a) <= 12:
            d = self._day(int(year), int(a), int(b))
            return d and f"{d.month:02d}/{d.day:02d}/{d.year}"
        d = self._day(int(year), int(b), int(a))
        # days that only fit day first stay among themselves, so no two dates meet in one
        while d and sep == "/" and d.day <= 12:
            d = self._day(d.year, d.month, d.day)
        return d and f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year}"

    def _ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.turn(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if iban_rest(plain[:2], plain[4:], plain[2:4]) != 1:
            return None
        country, size, body = plain[:2], IBAN_SIZES.get(plain[:2], len(plain)), plain[4:]
        while True:
            body = self._mixed(body, "iban" + country)
            new = f"{country}{98 - iban_rest(country, body):02d}{body}"
            # a longer one must not begin with one of the country's length
            if len(plain) <= size or iban_rest(country, new[4:size], new[2:4]) != 1:
                return _refill(text, new)

    def _iban_end(self, text: str, m: re.Match) -> int | None:
        """Where the account number ends: at its country's length, else at the last place
        before a sign that is no letter or digit where the remainder is right."""
        start, end = m.span()
        places = [i + 1 for i in range(start, end) if text[i] != " "]
        size = IBAN_SIZES.get(text[start:start + 2], 0)
        ends = [p for p in reversed(places[14:]) if not text[p:p + 1].isalnum()]
        return next((p for p in places[size - 1:size] * bool(size) + ends if self.value("iban", text[start:p])), None)

    def _email(self, text: str) -> str:
        local, domain = text.rsplit("@", 1)
        return self._mixed(local, "email") + "@" + domain

    def _secret(self, text: str) -> str | None:
        return self._mixed(text, "secret") if any(map(_own, text)) else None

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of what looks like a value, in order, without overlaps."""
        found = []
        at = text.find("@")
        while at >= 0:
            a, b = at, _DOMAIN.match(text, at + 1)
            while b and a and text[a - 1] in _LOCAL:  # no "@" in it, so no sign is passed twice
                a -= 1
            if b and a < at:
                found.append((a, b.end(), "email"))
            at = text.find("@", at + 1)
        for m in _SECRET.finditer(text):
            found.append((*m.span(m.lastindex), "secret"))
        done = 0
        for run in _RUN.finditer(text):
            start, end = run.span()
            if start >= 2 and text[start - 2:start].isupper() and text[start - 2:start].isascii() and not text[start - 3:start - 2].isalnum():
                if m := _IBAN.match(text, start - 2):
                    if iban_end := self._iban_end(text, m):
                        found.append((m.start(), iban_end, "iban"))
                        done = iban_end
                        continue
            if end - start >= 7 and start >= done:
                found += [(*m.span(), m.lastgroup if m.lastgroup != "sep" else "dmy")
                          for m in _NUMBER.finditer(text, max(0, start - 2), end + 2)]
        found.sort()
        out, last = [], 0
        for s, e, kind in found:
            if s >= last:
                out.append((s, e, kind))
                last = e
        return out

    def replace(self, text: str | None) -> tuple[str | None, int]:
        if not text:
            return text, 0
        out, last, n = [], 0, 0
        for s, e, kind in self.spans(text):
            new = self.value(kind, text[s:e])
            if new is not None:
                out += [text[last:s], new]
                last, n = e, n + 1
        return "".join([*out, text[last:]]) if n else text, n


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """``docs`` with the values in ``text`` replaced and their number in ``count``."""

    def make():
        work = Pseudonymiser(key)

        def run(col: pa.Array) -> list[pa.Array]:
            done = [work.replace(t.as_py()) for t in col]
            return [pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())]
        return run

    return map_column(docs, text, T.StructType([T.StructField(text, T.StringType()), T.StructField(count, T.IntegerType())]), make)
