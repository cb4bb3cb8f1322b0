"""Licence scan: Aho-Corasick over whole texts, shunting-yard over licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import small_batches, utf8

# The phrases and labels that every scan carries.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: phrase -> (label, how sure one notice makes us that the text states a licence)
NOTICES = {
    "cc by": ("cc-by", 0.7),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.8),
    "creative commons attribution": ("cc-by", 0.9),
    "creative commons zero": ("cc0", 0.9),
    "general public license": ("gpl", 0.8),
    "gnu general public license": ("gpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "all rights reserved": ("reserved", 0.6),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "apache license": ("apache", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "bsd license": ("bsd", 0.8),
    "bsd 2 clause": ("bsd", 0.9),
    "bsd 3 clause": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "public domain": ("public-domain", 0.5),
}
TAG = "spdx license identifier"
#: licence id prefix -> may be used freely under attribution at most
PERMISSIVE = ("MIT", "APACHE", "BSD", "ISC", "CC0", "CC-BY-4", "CC-BY-3", "UNLICENSE", "ZLIB", "PUBLIC")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_TAGGED = re.compile(r"(?i)spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
_RANK = {"OR": 1, "AND": 2, "WITH": 3}


def parse_expression(text: str) -> list[str]:
    """Postfix form of the longest well-formed licence expression at the start of ``text``.

    WITH binds before AND, AND before OR; operators are read in any case.
    What follows a complete expression (a comment's end, prose) is left out; an
    empty list means that there is none.
    """
    out: list[str] = []
    ops: list[str] = []
    good, rest = 0, []  # how much of out is in the longest expression so far, and the operators after it
    operand = True  # whether an operand is due
    opened = 0
    for m in _TOKEN.finditer(text):
        tok, up = m[0], m[0].upper()
        if tok == "(" and operand:
            ops.append("(")
            opened += 1
            continue
        if tok == ")" and not operand and opened:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            opened -= 1
        elif up in _RANK and not operand:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[up]:
                out.append(ops.pop())
            ops.append(up)
            operand = True
            continue
        elif operand and tok != ")" and up not in _RANK:
            out.append(tok)
            operand = False
        else:
            break
        if not opened:  # outside brackets there are three operators at most, one of each rank
            good, rest = len(out), ops[::-1]
    return out[:good] + rest


def evaluate(postfix: list[str], allowed) -> bool | None:
    """Whether the expression leaves a choice made of allowed licences only. None: empty.

    WITH adds an exception to a licence and never takes freedom away, so it has
    its licence's value.
    """
    stack: list = []
    for tok in postfix:
        if tok in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if tok == "OR" else left and right if tok == "AND" else left)
        else:
            stack.append(bool(allowed(tok)))
    return stack[0] if stack else None


def _permissive(identifier: str) -> bool:
    return identifier.upper().startswith(PERMISSIVE)


#: A-Z to a-z, any other ASCII that is no digit or small letter to a blank; bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _automaton(notices: Mapping[str, tuple[str, float]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, (label, sure) in notices.items():
        plain = " ".join(phrase.encode().translate(_FOLD).decode("latin-1").split())
        found.add_word(f" {plain} ", (len(plain) + 1, label, float(sure), phrase in BASE_PHRASES))
    found.add_word(f" {TAG} ", (len(TAG) + 1, None, 0.0, False))
    found.make_automaton()
    return found


def scan_text(body: bytes | None, found) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expression, permitted)."""
    words = (body or b"").translate(_FOLD).split()
    flat = f" {b' '.join(words).decode('latin-1')} "
    n_base, starts, base, labels, doubt, tagged = 0, [], set(), set(), 1.0, False
    for end, (length, label, sure, is_base) in found.iter(flat):
        if label is None:
            tagged = True
            continue
        if label not in labels:
            doubt *= 1.0 - sure
        labels.add(label)
        if is_base:
            n_base += 1
            base.add(label)
            starts.append(end - length)
    expression = permitted = None
    if tagged:
        for m in _TAGGED.finditer(body.decode("utf-8", "replace")):
            if postfix := parse_expression(m[1]):
                labels.update(t.lower() for i, t in enumerate(postfix) if t not in _RANK and postfix[i + 1 : i + 2] != ["WITH"])
                value = evaluate(postfix, _permissive)
                permitted = value if permitted is None else permitted and value
                expression = " ".join(postfix) if expression is None else f"{expression}; {' '.join(postfix)}"
                doubt = 0.0
    first, last = (flat.count(" ", 0, min(starts)), flat.count(" ", 0, max(starts))) if starts else (None, None)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(1.0 - doubt, 6), expression, permitted


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, permitted boolean"


def scan_licenses(df: DataFrame, id_column: str = "doc_id", text: str = "text", notices: Mapping[str, tuple[str, float]] = NOTICES) -> DataFrame:
    """One row for each row of ``df``: its id and what its whole text says about licences.

    Words are maximal runs of digits, letters (A-Z folded) and non-ASCII
    characters. n_base, first_word, last_word and base_labels tell of the base
    phrases; labels has every notice's label and the identifiers in
    ``SPDX-License-Identifier:`` expressions; score is 1 - prod(1 - surety) over
    the labels, 1 for a parsed expression; expression is its postfix form, and
    permitted tells whether it can be met by permissive licences alone (null:
    no expression). A null or empty text has no words and score 0. Repeated rows
    give repeated results; a null id stays null; other columns are not read. An
    empty table gives an empty result.
    """
    kind = small_batches(df).schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {FOUND}"
    notices = dict(notices)
    fields = [id_column, *(x.split()[0] for x in FOUND.split(", "))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(notices)
        for batch in batches:
            rows = [scan_text(b, found) for b in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * (len(fields) - 1)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], fields)

    return df.select(F.col(id_column), utf8(text).alias("_b")).mapInArrow(scan, schema)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
