"""PII: format-preserving pseudonyms by a keyed Feistel network.

Personal values are found by pattern, validated (check digits, calendar, ranges)
and permuted within their own format: a card number becomes another number of the
same length that passes the same check, a date another date in the same notation.
The permutation depends on the key and the kind alone, so equal values have equal
pseudonyms in every document, and no two values of one format share one.
"""

from __future__ import annotations

import hmac
import re
from calendar import monthrange
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import small_batches

ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): balanced Feistel rounds on a square grid, cycle-walked.

    Walking on from results outside the range keeps it a permutation; the grid is
    little larger than the range, so few steps are needed.
    """
    if size < 2:
        return value
    half = isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, half)
        for r in range(ROUNDS):
            mac = hmac.digest(key, b"%s|%d|%d|%d" % (tweak, size, r, right), "sha256")
            # wider than the half, so that all of it moves; a wide half takes the whole digest and more
            wide = mac[:16] if half < 1 << 96 else mac + hmac.digest(key, mac, "sha256")
            left, right = right, (left + int.from_bytes(wide, "big")) % half
        value = left * half + right
        if value < size:
            return value


@lru_cache(4096)
def _class(c: str) -> str:
    """The characters that may stand in place of one: ASCII digits, small letters or capitals; of other letters and digits those of their kind in their block of 128."""
    if c < "\x80":
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else c
    kind = lambda x: (x.isdecimal(), x.islower(), x.isupper(), x.isalpha())
    first = ord(c) // 128 * 128
    return "".join(x for x in map(chr, range(first, first + 128)) if kind(x) == kind(c)) if any(kind(c)) else c


def permute_classes(text: str, key: bytes, tweak: bytes) -> str:
    """Digits, small letters, capitals and other letters are permuted within their classes; other characters stay.

    Beyond 64 characters, each block of so many is permuted for itself.
    """
    if len(text) > 64:
        return "".join(permute_classes(text[i : i + 64], key, b"%s|%d" % (tweak, i)) for i in range(0, len(text), 64))
    classes = [_class(c) for c in text]
    shape = "".join({"0": "9"}.get(k[0], k[0]) if len(k) > 1 else c for c, k in zip(text, classes))
    value, total = 0, 1
    for c, k in zip(text, classes):
        value, total = value * len(k) + k.index(c), total * len(k)
    value = permute(value, total, key, tweak + b"|" + shape.encode())
    out = []
    for k in reversed(classes):
        value, d = divmod(value, len(k))
        out.append(k[d])
    return "".join(reversed(out))


def refill(template: str, digits: str) -> str:
    """The template's digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in template)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn_digit(body: str) -> int:
    """The check digit that follows ``body``."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def card(text: str, key: bytes) -> str | None:
    d = digits_of(text)
    if not 13 <= len(d) <= 19 or int(d[-1]) != luhn_digit(d[:-1]) or len(set(d)) == 1:
        return None
    # the first digit tells the network and stays; the rest but the check digit is permuted
    body = d[0] + f"{permute(int(d[1:-1]), 10 ** (len(d) - 2), key, b'card' + d[0].encode()):0{len(d) - 2}d}"
    return refill(text, body + str(luhn_digit(body)))


#: Digits in the groups that cards are written in; a number in one piece is usual too.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}


def cards(text: str, key: bytes) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of the valid numbers in a run of digits with single blanks or hyphens between them.

    Numbers in one piece or in usual groups with equal separators come first, then
    the longest stretch of groups from each start. Short numbers side by side would
    nearly always hold some valid stretch, so unusual groups have three digits or
    more, but for the last one, unless the stretch is the whole run.
    """
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    sizes = [b - a for a, b in groups]
    free, found = [True] * len(groups), []
    short = sum(sizes) <= 19  # the whole run may be one number
    for usual in (True, False):
        for i in range(len(groups)):
            fits, total = [], 0
            for j in range(i, len(groups)):
                total += sizes[j]
                if total > 19 or not free[j] or (j - i > 4 if usual else j > i and sizes[j - 1] < 3 and not (short and i == 0)):
                    break
                if usual:
                    right = j == i or tuple(sizes[i : j + 1]) in CARD_GROUPS and len({text[b] for _, b in groups[i:j]}) == 1
                else:
                    right = all(n >= 3 for n in sizes[i:j]) or i == 0 and j == len(groups) - 1
                if total >= 13 and right:
                    fits.append(j)
            for j in reversed(fits):
                new = card(text[groups[i][0] : groups[j][1]], key)
                if new is not None:
                    found.append((groups[i][0], groups[j][1], new))
                    free[i : j + 1] = [False] * (j + 1 - i)
                    break
    return sorted(found)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def iban(text: str, key: bytes) -> str | None:
    """Capitals that follow the number are not part of it: the longest valid stretch up to a blank counts."""
    for stop in sorted((m.start() for m in re.finditer(" |$", text)), reverse=True):
        plain = text[:stop].replace(" ", "")
        if 15 <= len(plain) <= 34 and _iban_number(plain[4:] + plain[:4]) % 97 == 1:
            body = permute_classes(plain[4:], key, b"iban" + plain[:2].encode())
            check = 98 - _iban_number(body + plain[:2] + "00") % 97
            it = iter(f"{plain[:2]}{check:02d}{body}")
            return "".join(c if c == " " else next(it) for c in text[:stop]) + text[stop:]
    return None


def ssn(text: str, key: bytes) -> str | None:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999 are valid, and stay so."""
    d = digits_of(text)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    at = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    at, serial = divmod(permute(at, 898 * 99 * 9999, key, b"ssn"), 9999)
    area, group = divmod(at, 99)
    return refill(text, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def address(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    # Values with as many digits stay together, so that the text keeps its width.
    spans = [(0, 10) if p < 10 else (10, 90) if p < 100 else (100, 156) for p in parts]
    value, total = 0, 1
    for p, (low, n) in zip(parts, spans):
        value, total = value * n + p - low, total * n
    value, out = permute(value, total, key, b"ip" + bytes(n for _, n in spans)), []
    for low, n in reversed(spans):
        value, d = divmod(value, n)
        out.append(str(low + d))
    return ".".join(reversed(out))


def phone(text: str, key: bytes) -> str | None:
    """Country code and first digits of groups keep off 0 and 1 where they were off: seven digits are permuted."""
    d = digits_of(text)
    if not 7 <= len(d) <= 15:
        return None
    n = min(7, len(d))
    return refill(text, d[:-n] + f"{permute(int(d[-n:]), 10**n, key, b'phone' + d[:-n].encode()):0{n}d}")


FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def _date_class(day: int, month: int, widths: tuple[int, int], padded: bool) -> bool:
    """Whether day and month can be written in these widths, in the same style: with zeros in front or without."""
    mixed = sum(widths) == 3
    return all(x < 10 if w == 1 or mixed and padded else x >= 10 or not mixed for x, w in zip((day, month), widths))


def calendar_date(text: str, key: bytes) -> str | None:
    """Year-month-day, or day-month-year with the first number as the day unless only the second can be one.

    A date becomes another of the same widths: one-digit days and months stay such,
    and where only one of the two has two digits, these are again two digits without
    a zero in front, or again one with a zero.
    """
    parts, marks = re.split(r"[-/.]", text), re.findall(r"[-/.]", text)
    year_first = len(parts[0]) == 4
    swapped = not year_first and int(parts[1]) > 12
    at = (2, 1, 0) if year_first else (1, 0, 2) if swapped else (0, 1, 2)  # where day, month and year stand
    day, month, year = (int(parts[i]) for i in at)
    if not 1900 <= year <= 2099 or not 1 <= month <= 12 or not 1 <= day <= monthrange(year, month)[1]:
        return None
    widths = len(parts[at[0]]), len(parts[at[1]])
    padded = sum(widths) == 3 and "0" in (parts[at[0]][0], parts[at[1]][0])
    span = (LAST_DAY - FIRST_DAY).days + 1
    value = (date(year, month, day) - FIRST_DAY).days
    tweak = b"date" + bytes([*widths, padded, swapped])
    while True:  # walks on to a date of the same class: the permutation of all days is one of the class too
        value = permute(value, span, key, tweak)
        new = FIRST_DAY + timedelta(days=value)
        # day and month must be told apart as before, or the notation would change its meaning
        if _date_class(new.day, new.month, widths, padded) and (new.day > 12 or not swapped):
            break
    for i, n, w in zip(at, (new.day, new.month, new.year), (*widths, 4)):
        parts[i] = f"{n:0{w}d}"
    return parts[0] + marks[0] + parts[1] + marks[1] + parts[2]


def email(text: str, key: bytes) -> str | None:
    name, _, domain = text.rpartition("@")
    return f"{permute_classes(name, key, b'email')}@{domain}"


def secret(text: str, key: bytes) -> str | None:
    """A prefix that tells the issuer stays."""
    if re.fullmatch(r"[0-9a-f]+", text):
        return f"{permute(int(text, 16), 16 ** len(text), key, b'hex'):0{len(text)}x}"
    prefix = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|", text)[0]
    return prefix + permute_classes(text[len(prefix) :], key, b"secret" + prefix.encode())


#: Patterns take time in proportion: each starts at the edge of a run of its characters or is bounded in length
#: (labels have 63 characters at most). Digits are 0 to 9 alone, but for addresses.
#: name, pattern, pseudonym (or several with their places in the match). Earlier kinds win where spans overlap.
KINDS: list[tuple[str, str, Callable[[str, bytes], str | list[tuple[int, int, str]] | None]]] = [
    ("email", r"(?<![\w.%+-])[\w.%+-]++@(?:[\w-]{1,63}\.){1,126}[^\W\d_]{2,63}", email),
    ("secret", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|(?<![0-9a-fA-F])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}(?![0-9a-fA-F])", secret),
    ("secret", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9_+/.-]{6,})", secret),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", address),
    ("date", r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9]|[-.][0-9])", calendar_date),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", ssn),
    ("card", r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,}+", cards),
    ("phone", r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![\w+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[-.][0-9])", phone),
]
_COMPILED = [(name, re.compile(pattern), change) for name, pattern, change in KINDS]
#: A text without any of these has nothing to find: each pattern needs a digit, '@', '=', ':' or an issuer's prefix.
_HINT = re.compile(r"[0-9@=:]|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of what was replaced, in code points of the input.

    What one kind has taken is blanked out for those after it, with characters
    that no pattern matches, so neighbouring values do not run into each other.
    """
    if not _HINT.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    left = text
    for name, pattern, change in _COMPILED:

        def take(m: re.Match) -> str:
            start, end = m.span(pattern.groups)  # the group if there is one, else the match
            new = change(text[start:end], key)
            if new is None:
                return m[0]
            rest, at = [], m.start()
            for a, b, x in [(0, end - start, new)] if isinstance(new, str) else new:
                taken.append((start + a, start + b, name, x))
                rest += [left[at : start + a], "\0" * (b - a)]
                at = start + b
            return "".join([*rest, left[at : m.end()]])

        left = pattern.sub(take, left)
    out, at = [], 0
    taken.sort()
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(a, b, name) for a, b, name, _ in taken]


def pseudonymise_documents(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, text with pseudonyms, n_found and spans (start, stop, kind) of every row.

    key: the secret; under one key equal values have equal pseudonyms everywhere. A
    day is linked to itself in one notation alone: 2020-01-25, 2020/01/25 and
    25/01/2020 stay days of one style and are linked where order and widths are the
    same, 1/5/2020 is not linked to 2020-01-05. Numbers are found in the digits 0 to
    9; those of other scripts stay, but for addresses, whose local parts may have
    letters and digits of any script. Values that fail validation stay as they are, and every text keeps its length:
    digits stay digits, letters keep their case. A null text stays null with nothing
    found, an empty one stays empty; very long texts are read whole, in time that
    grows with their length; ids may be null or repeat; other columns are not read.
    An empty table gives an empty result.
    """
    kind = small_batches(docs).schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, `{text}` string, n_found long, spans array<struct<start:int, stop:int, kind:string>>"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
    secret_key = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None, []) if t is None else pseudonymise(t, secret_key) for t in batch.column(1).to_pylist()]
            found = [[{"start": a, "stop": b, "kind": k} for a, b, k in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array(map(len, found), pa.int64()), pa.array(found, spans)],
                [id_column, text, "n_found", "spans"],
            )

    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, schema)


def op9_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """The key stands in for the one that a deployment keeps in its secret store."""
    docs = pseudonymise_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="tideline-demo-key")
    return docs.select("doc_id", "n_found", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",").alias("spans"), "text")
