"""Personal data replaced by format-preserving pseudonyms.

Validated values (cards by their check digit, account numbers by theirs, addresses of machines
by their octets, calendar dates, social security and telephone numbers, e-mail addresses) are
permuted by a keyed Feistel network within the values of their own format, walking on past
values that the format doesn't allow. The permutation depends on the value and the key alone,
so equal values get equal pseudonyms in every document, however they are punctuated, and
different ones stay apart. Where an expression's longest match doesn't validate, its shorter
parts up to a separator and later starts are tried; what then doesn't is left as it is.

The caller brings the key; who has it can undo the permutation, so it is no part of this module.
A null text stays null. Rows are kept as they come, repeated ones too, with all their columns.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "date")
ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def feistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size)."""
    right_size = math.isqrt(size - 1) + 1
    left_size = -(-size // right_size)
    width = (max(left_size, right_size).bit_length() + 7) // 8
    while True:
        left, right = divmod(value, right_size)
        for k in range(ROUNDS):
            seed = k.to_bytes(1, "big") + tweak + b"|" + (left if k % 2 else right).to_bytes(width, "big")
            noise = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=min(64, width + 8)).digest(), "big")
            if k % 2:
                right = (right + noise) % right_size
            else:
                left = (left + noise) % left_size
        value = left * right_size + right
        if value < size:
            return value


def _walk(value: int, size: int, key: bytes, tweak: bytes, allowed) -> int:
    while not allowed(value := feistel(value, size, key, tweak)):
        pass
    return value


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 1
    body = str(_walk(int(d[:-1]), 10**n, key, b"card%d" % n, lambda v: v >= 10 ** (n - 1) or d[0] == "0")).zfill(n)
    return _fill(s, body + luhn_digit(body))


def _phone(s: str, key: bytes) -> str | None:
    d = _digits(s)
    head = len(d) - 10 if len(d) in (10, 11) else len(d) - 7
    if not 10 <= len(d) <= 15 or head < 0:
        return None
    n = len(d) - head
    low = "23456789"
    strict = n == 10 and d[head] in low and d[head + 3] in low
    ok = (lambda v: len(t := str(v)) == 10 and t[0] in low and t[3] in low) if strict else (lambda v: True)
    return _fill(s, d[:head] + str(_walk(int(d[head:]), 10**n, key, b"phone%d" % n, ok)).zfill(n))


def _ip(s: str, key: bytes) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    usual = lambda first: first not in (0, 127) and first < 224
    kind = usual(parts[0])
    value = _walk(int.from_bytes(bytes(parts), "big"), 2**32, key, b"ip%d" % kind, lambda v: usual(v >> 24) == kind)
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


def _ssn(s: str, key: bytes) -> str | None:
    ok = lambda v: (t := str(v).zfill(9))[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000"
    value = int(_digits(s))
    return _fill(s, str(_walk(value, 10**9, key, b"ssn", ok)).zfill(9)) if ok(value) else None


def _mixed(s: str, key: bytes, tweak: bytes) -> str:
    """Digits to digits and letters to letters of the same case; other characters stay."""
    value, size, radix = 0, 1, []
    for c in s:
        base, zero = (10, "0") if c in "0123456789" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c)
        radix.append((base, zero))
        value, size = value * base + (ord(c) - ord(zero)), size * base
    if size == 1:
        return s
    value, out = feistel(value, size, key, tweak + b"|" + "".join(z for _, z in radix).encode()), []
    for base, zero in reversed(radix):
        value, d = divmod(value, base)
        out.append(chr(ord(zero) + d))
    return "".join(reversed(out))


def _email(s: str, key: bytes) -> str | None:
    local, _, host = s.rpartition("@")
    return f"{_mixed(local, key, b'email@' + host.lower().encode())}@{host}"


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _mixed(plain[4:], key, b"iban" + plain[:2].encode())
    out = plain[:2] + str(98 - _iban_rest(plain[:2] + "00" + body)).zfill(2) + body
    it = iter(out)
    return "".join(c if c == " " else next(it) for c in s)


def _date(s: str, key: bytes) -> str | None:
    sep = re.search(r"[-/.]", s)[0]
    a, b, c = s.split(sep)
    orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy")
    for order in orders:
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            day = date(int(part["y"]), int(part["m"]), int(part["d"]))
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        width = 1 if min(len(part["d"]), len(part["m"])) == 1 else 2
        new = FIRST_DAY + timedelta(days=feistel((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, key, b"date"))
        out = {"y": str(new.year), "m": str(new.month).zfill(width), "d": str(new.day).zfill(width)}
        return sep.join(out[x] for x in order)
    return None


#: (kind, expression, pseudonym); where matches overlap, the earlier start holds, then the earlier kind here.
FINDERS = (
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("date", re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.-])[0-9]{1,2}\1[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"), _date),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"), _ssn),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"), _ip),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+(?!1[ .(-])[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5})(?![0-9A-Za-z])"), _phone),
    ("card", re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"), _card),
)
#: Kinds whose expressions may run on into what stands behind a value.
OPEN_ENDED = {"iban", "phone", "card"}
#: Lengths of account numbers by country, tried before others.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_ANY = re.compile(r"[0-9@]")


def _parts(kind: str, s: str) -> list[str]:
    """s and its beginnings up to a separator, in the order they are tried: the longest first, but an account number of its country's length before all."""
    if kind not in OPEN_ENDED:
        return [s]
    parts = [s, *(s[: m.start()] for m in reversed(list(re.finditer(r"(?<=[0-9A-Za-z)])[ .-]", s))))]
    if kind == "iban":
        parts.sort(key=lambda x: len(x.replace(" ", "")) != IBAN_LENGTH.get(s[:2]))
    return parts


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.of = functools.lru_cache(1 << 16)(lambda change, s: change(s, self.key))

    def _spans(self, text: str, rank: int, kind: str, pattern: re.Pattern, change) -> Iterator[tuple]:
        """What validates from each start on; spans may overlap."""
        at = 0
        while m := pattern.search(text, at):
            for part in _parts(kind, m[0]):
                if new := self.of(change, part):
                    yield m.start(), rank, m.start() + len(part), kind, new
                    break
            at = m.start() + 1

    def __call__(self, text: str) -> tuple[str, list[int]]:
        counts = [0] * len(KINDS)
        if not _ANY.search(text):
            return text, counts
        spans = []
        if "@" in text:
            spans += [(m.start(), -1, m.end(), "email", new) for m in EMAIL.finditer(text) if (new := self.of(_email, m[0]))]
        for rank, (kind, pattern, change) in enumerate(FINDERS):
            spans += self._spans(text, rank, kind, pattern, change)
        out, at = [], 0
        for start, _, end, kind, new in sorted(spans):
            if start >= at:
                out += [text[at:start], new]
                at = end
                counts[KINDS.index(kind)] += 1
        return "".join([*out, text[at:]]), counts


def _mask(batches: Iterator[pa.RecordBatch], key: bytes, at: int, names: list[str], counted: bool) -> Iterator[pa.RecordBatch]:
    change = Pseudonyms(key)
    for batch in batches:
        texts, counts = [], []
        for t in batch.column(at):
            new, n = (None, [0] * len(KINDS)) if (t := t.as_py()) is None else change(t)
            texts.append(new)
            counts.append(n)
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        if counted:
            columns += [pa.array([n[k] for n in counts], pa.int64()) for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays(columns, names)


def pseudonymise(docs: DataFrame, key: bytes, counted: bool = False) -> DataFrame:
    """docs with text replaced; if counted, n_<kind> follows for each kind of value found, in place of columns of that name."""
    extra = [f"n_{k}" for k in KINDS] if counted else []
    kept = docs.withColumn("text", F.col("text").cast("string")).drop(*extra)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(name, T.LongType()) for name in extra]])
    return kept.mapInArrow(functools.partial(_mask, key=key, at=kept.columns.index("text"), names=schema.names, counted=counted), schema)
