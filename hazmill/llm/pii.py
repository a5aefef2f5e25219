"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates are validated (Luhn, mod 97, octets, calendar, numbering plan) and permuted within the
set of valid values of their format: separators, lengths, letter case and check digits stay valid. One key
gives one permutation for each kind of value, so that equal values get equal pseudonyms in all documents and
different ones stay different: a date has one pseudonym however it is written, an IBAN with or without spaces, an address of version 6
in any of its forms. What looks like a long account number but fails its check is permuted among
those that fail it. E-mail local parts and secrets are permuted character class by character class.

Defined results: a null text stays null with no finds; empty texts, null ids and repeated rows pass through;
texts without finds come back unchanged. Kept columns may have any names but those of the results, which can be given.
"""

from __future__ import annotations

import calendar
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmill.llm.common import free, released, slices

ROUNDS = 8
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)++[A-Za-z]{2,}+",
    "secret": r"(?i:pass(?:word|wd)|secret|token|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[A-Za-z0-9_\-+/]{6,}+)",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+)(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*+\d)[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)(?!\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![\w:.])",
    "date": r"(?<![\w\-/.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w\-/])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w(])(?:\+?\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w\-.])(?:\+\d{1,3}[ .\-])?\d{3}(?P<sep>[ .\-])\d{3}(?P=sep)\d{4}(?!\w)|(?<!\w)\+\d{8,15}(?!\w)|(?<![\w\-.+/])[2-9]\d{2}[2-9]\d{6}(?![\w\-])",
    "card": r"(?<![\w\-])(?:\d{13,19}|\d{4}(?P<gap>[ \-])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<dot>[ \-])\d{6}(?P=dot)\d{5})(?![\w\-])",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
#: Every pattern needs one of these: texts without any need no further look.
_MAYBE = re.compile(r"[0-9@=:]|AKIA|gh[pousr]_")


class Permuter:
    """Keyed permutations of mixed-radix numbers."""

    def __init__(self, key: bytes):
        self.key = key
        self.memo: dict[tuple[str, str], str] = {}

    def _round(self, tweak: str, k: int, other: int, size: int) -> int:
        n = (size.bit_length() + 7) // 8 + 16
        text = f"{tweak}|{k}|{other}".encode()
        return int.from_bytes(hashlib.shake_256(len(self.key).to_bytes(4, "big") + self.key + text).digest(n), "big") % size

    def pair(self, tweak: str, left: int, right: int, a: int, b: int) -> tuple[int, int]:
        """A permutation of the pairs (left < a, right < b)."""
        for k in range(ROUNDS):
            if k % 2:
                right = (right + self._round(tweak, k, left, b)) % b
            else:
                left = (left + self._round(tweak, k, right, a)) % a
        return left, right

    def digits(self, tweak: str, values: list[int], radices: list[int]) -> list[int]:
        """A permutation of the numbers with these radices."""
        half = len(radices) // 2
        sides = []
        for lo, hi in ((0, half), (half, len(radices))):
            n, size = 0, 1
            for v, r in zip(values[lo:hi], radices[lo:hi]):
                n, size = n * r + v, size * r
            sides.append([n, size])
        (left, a), (right, b) = sides
        left, right = self.pair(f"{tweak}|{','.join(map(str, radices))}", left, right, a, b)
        out: list[int] = []
        for n, part in ((left, radices[:half]), (right, radices[half:])):
            some = []
            for r in reversed(part):
                n, v = divmod(n, r)
                some.append(v)
            out += reversed(some)
        return out

    def walk(self, tweak: str, values: list[int], radices: list[int], valid: Callable[[list[int]], bool]) -> list[int]:
        """A permutation of the valid numbers: step on until the next valid one."""
        while True:
            values = self.digits(tweak, values, radices)
            if valid(values):
                return values

    def number(self, tweak: str, value: int, size: int) -> int:
        """A permutation of 0..size-1."""
        a = int(size**0.5) + 1
        b = -(-size // a)
        while True:
            left, right = self.pair(f"{tweak}|{size}", *divmod(value, b), a, b)
            value = left * b + right
            if value < size:
                return value

    def classes(self, tweak: str, text: str, hexadecimal: bool = False) -> str:
        """Each ASCII letter and digit within its class, the rest as it is."""
        kinds = [(HEX if hexadecimal and c in HEX else DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else "") for c in text]
        at = [i for i, k in enumerate(kinds) if k]
        if not at:
            return text
        new = self.digits(tweak, [kinds[i].index(text[i]) for i in at], [len(kinds[i]) for i in at])
        out = list(text)
        for i, v in zip(at, new):
            out[i] = kinds[i][v]
        return "".join(out)


def luhn(digits: list[int]) -> bool:
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _refill(text: str, digits: list[int]) -> str:
    new = iter(digits)
    return "".join(str(next(new)) if c in DIGITS else c for c in text)


def _date(text: str) -> tuple[int, str] | None:
    """The ordinal and the format of a valid date of the years 1900 to 2099."""
    sep = next(c for c in text if c not in DIGITS)
    parts = text.split(sep)
    for order in ("ymd",) if sep == "-" else ("mdy", "dmy") if sep == "/" else ("dmy",):
        y, m, d = (int(parts[order.index(c)]) for c in "ymd")
        if 1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]:
            return date(y, m, d).toordinal(), sep + order
    return None


def _written(ordinal: int, form: str, text: str) -> str:
    day = date.fromordinal(ordinal)
    sep, order = form[0], form[1:]
    old = text.split(sep)
    wide = [len(p) > 1 and p[0] == "0" or len(p) == 2 for p in old]
    parts = {"y": f"{day.year:04d}", "m": str(day.month), "d": str(day.day)}
    padded = all(w for w, c in zip(wide, order) if c != "y")
    return sep.join(parts[c].zfill(2) if c != "y" and padded else parts[c] for c in order)


def pseudonym(kind: str, text: str, p: Permuter) -> str | None:
    """The value's pseudonym, or null if it fails its validation and isn't private."""
    if kind == "email":
        local, _, domain = text.partition("@")
        return f"{p.classes('email', local)}@{domain}"
    if kind in ("secret", "key"):
        lead = 4 if kind == "key" else 0
        return text[:lead] + p.classes(kind, text[lead:], all(c in HEX for c in text))
    if kind == "hex":
        return p.classes("hex", text, True)
    if kind == "iban":
        plain = text.replace(" ", "")
        if not iban_ok(plain):
            return None
        body = p.classes("iban", plain[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        return ".".join(map(str, p.digits("ip", octets, [256] * 4)))
    if kind == "ip6":
        try:
            was = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        if was.is_loopback or was.is_unspecified:
            return None
        return ":".join(f"{x:x}" for x in p.digits("ip6", [int.from_bytes(was.packed[i : i + 2], "big") for i in range(0, 16, 2)], [1 << 16] * 8))
    if kind == "date":
        if not (found := _date(text)):
            return None
        new = p.number("date", found[0] - _FIRST, _LAST - _FIRST + 1)
        return _written(new + _FIRST, found[1], text)
    digits = [int(c) for c in text if c in DIGITS]
    if kind == "ssn":
        valid = lambda d: d[:3] not in ([0, 0, 0], [6, 6, 6]) and d[0] != 9 and any(d[3:5]) and any(d[5:])
        return _refill(text, p.walk("ssn", digits, [10] * 9, valid)) if valid(digits) else None
    if kind == "phone":
        lead = max(0, len(digits) - 10) if "(" in text or "+" not in text or len(digits) > 10 else 0
        body = digits[lead:]
        plan = lambda d: len(d) == 10 and d[0] > 1 and d[3] > 1
        was = plan(body)
        return _refill(text, digits[:lead] + p.walk(f"phone{was}", body, [10] * len(body), lambda d: plan(d) == was))
    was = luhn(digits)
    if was:
        body = p.digits("card", digits[:-1], [10] * (len(digits) - 1))
        return _refill(text, [*body, next(c for c in range(10) if luhn([*body, c]))])
    return _refill(text, p.walk("account", digits, [10] * len(digits), lambda d: not luhn(d)))


def _prefixes(kind: str, text: str) -> list[str]:
    """The value itself; of an IBAN in groups, which capitals may follow, also what it begins with."""
    if kind != "iban" or " " not in text:
        return [text]
    groups = text.split(" ")
    return [" ".join(groups[:k]) for k in range(len(groups), 3, -1)]


def rewrite(text: str, p: Permuter) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms and, for each, its kind and its place in the original."""
    if not _MAYBE.search(text):
        return text, []
    out, spans, at, look = [], [], 0, 0
    while m := PATTERN.search(text, look):
        kind = next(k for k in _PATTERNS if m[k] is not None)
        begin, end = m.span("value") if kind == "secret" else m.span()
        look = m.start() + 1  # what fails its check may hold something else
        for value in _prefixes(kind, text[begin:end]):
            if (kind, value) not in p.memo:
                if len(p.memo) > 100_000:
                    p.memo.clear()
                p.memo[kind, value] = pseudonym(kind, value, p)
            if (new := p.memo[kind, value]) is not None:
                out += [text[at:begin], new]
                look = at = begin + len(value)
                spans.append((kind, begin, at))
                break
    return "".join([*out, text[at:]]) if spans else text, spans


def pseudonymise(df: DataFrame, key: bytes, keep: list[str], text: str = "text", names: tuple[str, str, str] = ("text", "n_pii", "finds")) -> DataFrame:
    """The columns to keep, the rewritten text, n_pii and the finds as (kind, begin, end) of the original."""
    inner = free("__text", keep)
    rows = df.select(*keep, F.col(text).cast("string").alias(inner))
    span = T.StructType().add("kind", T.StringType()).add("begin", T.IntegerType()).add("end", T.IntegerType())
    schema = df.select(*keep).schema.add(names[0], T.StringType()).add(names[1], T.IntegerType()).add(names[2], T.ArrayType(span))
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for batch in slices(batches, inner):
            got = [(None, []) if t is None else rewrite(t, p) for t in batch.column(inner).to_pylist()]
            finds = [[{"kind": k, "begin": b, "end": e} for k, b, e in s] for _, s in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in got], pa.string()), pa.array([len(s) for _, s in got], pa.int32()), pa.array(finds, kinds)], schema.fieldNames())

    return rows.mapInArrow(released(rewritten), schema)
