"""Personal data replaced by format-preserving pseudonyms.

A recognised and validated value is permuted by a keyed Feistel network within its own format:
digits stay digits, separators stay where they are, check digits stay valid, dates stay dates.
The permutation depends on the key and the kind of value alone, so equal values, however they
are spaced, get equal pseudonyms in every document.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALNUM = LETTERS + "0123456789"


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: unbalanced Feistel rounds, walked into range."""
    if size < 2:
        return value
    left = math.isqrt(size - 1) + 1
    right = -(-size // left)
    while True:
        a, b = divmod(value, right)
        m, n = left, right
        for i in range(ROUNDS):
            word = hashlib.blake2b(f"{tweak}|{size}|{i}|{b}".encode(), key=key, digest_size=16).digest()
            a, b, m, n = b, (a + int.from_bytes(word, "big")) % m, n, m
        value = a * right + b
        if value < size:
            return value


def _digits(digits: str, key: bytes, kind: str) -> str:
    return str(permuted(int(digits), 10 ** len(digits), key, f"{kind}{len(digits)}")).zfill(len(digits))


def _letters(text: str, alphabet: str, key: bytes, kind: str) -> str:
    base, value = len(alphabet), 0
    for c in text:
        value = value * base + alphabet.index(c)
    value, out = permuted(value, base ** len(text), key, f"{kind}{len(text)}"), []
    for _ in text:
        value, r = divmod(value, base)
        out.append(alphabet[r])
    return "".join(reversed(out))


def _refill(shape: str, digits: str) -> str:
    """The digits of ``shape`` replaced in order; everything else stays."""
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), shape)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _number(text: str, key: bytes) -> str | None:
    """Card numbers of 13 to 19 digits with a valid check digit, which stays valid.

    Those of fewer than 16 digits begin with 3 to 6 as such cards do, and keep that digit;
    book numbers, times in milliseconds and the like do not.
    """
    digits = re.sub("[^0-9]", "", text)
    head = digits[0] if len(digits) < 16 else ""
    if luhn_digit(digits[:-1]) != digits[-1] or head and head not in "3456":
        return None
    payload = head + _digits(digits[len(head) : -1], key, "card" + head)
    return _refill(text, payload + luhn_digit(payload))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = "".join(
        _digits(p, key, "iban") if p.isdigit() else _letters(p.lower(), LETTERS, key, "iban").upper()
        for p in re.findall("[0-9]+|[A-Z]+", plain[4:])
    )
    check = 98 - number(body + plain[:2] + "00") % 97
    it = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in text)


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    name = "".join(
        _letters(p, ALNUM, key, "email") if set(p) <= set(ALNUM) else p for p in re.findall("[a-z0-9]+|[^a-z0-9]+", local.lower())
    )
    name = re.sub(r"[^\x00-\x7f]", lambda m: LETTERS[permuted(ord(m[0]), 0x110000, key, "char") % 26], name)
    if len(name) == len(local):
        name = "".join(n.upper() if c.isupper() else n for n, c in zip(name, local, strict=True))
    return f"{name}@{domain}"


def _phone(text: str, key: bytes) -> str:
    """The subscriber's digits; the country code after a plus sign stays."""
    lead = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head = lead[0] if lead else ""
    return head + _refill(text[len(head) :], _digits(re.sub("[^0-9]", "", text[len(head) :]), key, "phone" + head))


def _address(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    value = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(order: str) -> Callable[[str, bytes], str | None]:
    def run(text: str, key: bytes) -> str | None:
        parts = re.findall("[0-9]+", text)
        try:
            day = datetime.date(*(int(parts[order.index(x)]) for x in "ymd")).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        new = datetime.date.fromordinal(permuted(day, DAYS, key, "date") + FIRST_DAY)
        value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return _refill(re.sub("[0-9]+", lambda m: "0" * (4 if len(m[0]) == 4 else 2), text), "".join(value[x] for x in order))

    return run


def _ssn(text: str, key: bytes) -> str | None:
    """Area 001-899 but 666, group 01-99, serial 0001-9999, permuted among the valid ones."""
    area, group, serial = (int(p) for p in re.findall("[0-9]+", text))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    index, serial = divmod(permuted(index, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(index, 99)
    return _refill(text, f"{area + 1 + (area + 1 >= 666):03d}{group + 1:02d}{serial + 1:04d}")


def _secret(text: str, key: bytes) -> str:
    new = _letters(text.lower(), "0123456789abcdef", key, "secret")
    return new.upper() if text == text.upper() else new


#: Kinds in the order in which they are tried; a value is of the first kind that accepts it.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}", _email),  # the name is found from here
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "secret": (r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])", _secret),
    "date_ymd": (r"(?<![0-9./-])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9]|[./-][0-9])", _date("ymd")),
    "date_dmy": (r"(?<![0-9./-])[0-9]{2}([-/.])[0-9]{2}\1[0-9]{4}(?![0-9]|[./-][0-9])", _date("dmy")),
    "date_mdy": (r"(?<![0-9./-])[0-9]{2}(/)[0-9]{2}\1[0-9]{4}(?![0-9]|[./-][0-9])", _date("mdy")),
    "ip": (r"(?<![0-9.vV])(?<!ersion )[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _address),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    "number": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _number),
    "phone": (
        r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
        r"|(?<![0-9+.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9]|[.-][0-9])"
        r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
        _phone,
    ),
}
_COMPILED = {kind: (re.compile(pattern), rule) for kind, (pattern, rule) in KINDS.items()}
_MAY_HOLD = re.compile(r"@|[0-9][ .()/-]?[0-9]")


_NAME = re.compile(r"[\w.+%-]")


def _spans(kind: str, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Where a kind's pattern stands; mail names reach back from the ``@`` to the last address."""
    last = 0
    for m in pattern.finditer(text):
        begin = m.start()
        if kind == "email":
            while begin > last and _NAME.match(text, begin - 1):
                begin -= 1
            last = m.end()
            if not re.search(r"\w", text[begin : m.start()]):
                continue
        yield begin, m.end()


@lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it is not a valid value of the kind."""
    return _COMPILED[kind][1](value, key)


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and (kind, begin, end) of each in the input."""
    if not _MAY_HOLD.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    for kind, (pattern, _) in _COMPILED.items():
        if kind == "email" and "@" not in text:
            continue
        found = []
        for begin, end in _spans(kind, pattern, text):
            new = pseudonym(kind, text[begin:end], key)
            if new is not None:
                found.append((begin, end, kind, new))
        if found:
            taken = _without_overlaps(taken, found)
    out, at = [], 0
    for begin, end, _, new in taken:
        out += [text[at:begin], new]
        at = end
    return "".join([*out, text[at:]]), [(k, b, e) for b, e, k, _ in taken]


def _without_overlaps(held: list, new: list) -> list:
    """Both lists in order of place; where they overlap, the values held already stay."""
    out, i = [], 0
    for x in new:
        while i < len(held) and held[i][1] <= x[0]:
            out.append(held[i])
            i += 1
        if i == len(held) or held[i][0] >= x[1]:
            out.append(x)
    return sorted([*out, *held[i:]])


def _replaced(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            done = [(None, []) if t is None else pseudonymised(t, key) for t in batch.column("text").to_pylist()]
            spans = [[{"kind": k, "begin": b, "end": e} for k, b, e in s] for _, s in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([t for t, _ in done], pa.string()), pa.array(spans, span)], names=["row", "text", "found"]
            )

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``row, text, found`` for each row of ``docs``: the text with pseudonyms, and where.

    ``row`` is the row itself with all its columns.  ``found`` lists kind and character range
    (in the input text) of each value.  Null texts stay null, texts without values stay as they
    are, and repeated rows get equal texts.  ``key`` is a secret of 1 to 64 bytes: who has it can
    undo every pseudonym.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    packed = docs.select(F.struct("*").alias("row"))
    kind = packed.schema[0].dataType.simpleString()
    return packed.select("row", F.col("row.text").cast("string").alias("text")).mapInArrow(
        _replaced(key), f"row {kind}, text string, found array<struct<kind:string,begin:long,end:long>>"
    )
