"""Merge-type piece vocabularies: whole texts to ids and back, each symbol pair merged in the order of its score.

A model file is read as it comes (pieces, scores, kinds, normalisation). A text is
cut where no piece can reach across, each stretch is merged by an agenda of its
adjacent symbol pairs, and a bounded memo keeps what stretches became.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain, groupby
from operator import add, itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import kept_in_worker, sliced, utf8

SPACE = "▁"
#: Stretches of text whose ids a worker remembers, and how long they may be: some 100 MB.
MEMO, MEMO_LENGTH = 1 << 18, 64
#: Symbols whose agenda is a list.
FEW = 24
# Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


@dataclass
class Model:
    """What a model file says: (text, score, kind) of each id, and how texts are prepared."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    suffix: bool = False
    unknown: str = " ⁇ "
    rules: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of an encoded message: ints, bytes of 4 or 8, or byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}[tag & 7] if tag & 7 != 2 else number()
        yield tag >> 3, raw[at : at + size]
        at += size


def read_model(path: str) -> Model:
    """The model in a file of the driver; its contents travel with the tasks.

    Models of merges without normalisation rules and user-defined pieces are
    known; others are refused.
    """
    with open(path, "rb") as f:
        raw = f.read()
    out = Model()
    for n, value in _fields(raw):
        if n == 1:
            piece = dict(_fields(value))
            out.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif n == 2:
            for k, v in _fields(value):
                if k == 3:
                    out.kind = v
                elif k == 24:
                    out.suffix = bool(v)
                elif k == 35:
                    out.byte_fallback = bool(v)
                elif k == 44:
                    out.unknown = v.decode()
        elif n == 3:
            for k, v in _fields(value):
                if k == 2:
                    out.rules = v
                elif k == 3:
                    out.dummy_prefix = bool(v)
                elif k == 4:
                    out.squeeze = bool(v)
                elif k == 5:
                    out.escape = bool(v)
    if out.kind != MERGES or out.rules or out.suffix or not out.escape or any(k in (USER, UNUSED) for _, _, k in out.pieces):
        raise ValueError("only models of merges without rules, suffix marks, user-defined and unused pieces are known")
    return out


def merge(symbols: str, ranks: dict[str, int]) -> list[str]:
    """Symbols merged pair by pair: of all adjacent pairs that make a piece the one of the least rank, of equal ones the leftmost.

    ranks: of each piece, 0 for the highest score; equal scores share one. The
    agenda holds rank and place of a pair each time it comes to be, as one number;
    entries whose symbols have changed since are passed over. n symbols take
    n log n steps. The agenda of a few symbols is a list in their order that is
    searched as a whole: the same pairs in the same turn, with less to keep.
    """
    parts: list[str | None] = list(symbols)
    n = len(parts)
    find = ranks.get
    if n <= FEW:
        agenda = [find(p, _NONE) for p in map(add, parts, parts[1:])]
        while agenda and (r := min(agenda)) < _NONE:
            i = agenda.index(r)
            parts[i] += parts.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = find(parts[i] + parts[i + 1], _NONE)
            if i:
                agenda[i - 1] = find(parts[i - 1] + parts[i], _NONE)
        return parts
    agenda = [r << 40 | i for i, p in enumerate(map(add, parts, parts[1:])) if (r := find(p)) is not None]
    if not agenda:
        return parts
    heapify(agenda)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while agenda:
        top = heappop(agenda)
        i = top & _PLACE
        j = after[i]
        if parts[i] is None or j >= n or find(both := parts[i] + parts[j]) != top >> 40:
            continue
        parts[i], parts[j] = both, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := find(both + parts[k])) is not None:
                heappush(agenda, r << 40 | i)
        h = before[i]
        if h >= 0 and (r := find(parts[h] + both)) is not None:
            heappush(agenda, r << 40 | h)
    return [p for p in parts if p is not None]


_PLACE = (1 << 40) - 1
_NONE = 1 << 40


class _Memo(dict):
    """What ``work`` makes of texts; of short ones it is kept, until there are too many."""

    def __init__(self, work: Callable[[str], tuple[int, ...]], most: int):
        self.work, self.most = work, most

    def __missing__(self, text: str) -> tuple[int, ...]:
        out = self.work(text)
        if len(text) <= MEMO_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[text] = out
        return out


class Pieces:
    """A model made ready: encode() and decode()."""

    def __init__(self, model: Model, memo: int = MEMO):
        self.model = model
        self.ids = {p: i for i, (p, _, k) in reversed(list(enumerate(model.pieces))) if k == NORMAL}
        order = {score: r for r, score in enumerate(sorted({model.pieces[i][1] for i in self.ids.values()}, reverse=True))}
        ranks = {p: order[model.pieces[i][1]] for p, i in self.ids.items()}
        self.unknown = next(i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN)
        values = [int(p[1:-1], 16) if k == BYTE else None for p, _, k in model.pieces]
        self.bytes = {v: i for i, v in enumerate(values) if v is not None}
        self.surface = [
            b"" if k == CONTROL else model.unknown.encode() if k == UNKNOWN else bytes([v]) if k == BYTE else p.replace(SPACE, " ").encode()
            for (p, _, k), v in zip(model.pieces, values)
        ]
        self.kinds = [k for _, _, k in model.pieces]
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.stretches = _stretches(ranks)

        def ids_of(text: str) -> tuple[int, ...]:
            out: list[int] = []
            for p in merge(text, ranks):
                if (i := self.ids.get(p)) is not None:
                    out.append(i)
                elif model.byte_fallback:
                    out += [self.bytes[b] for b in p.encode()]
                else:
                    out.append(self.unknown)
            return tuple(out)

        self.stretch = _Memo(ids_of, memo).__getitem__

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without begin and end marks."""
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        marked = ((" " if self.model.dummy_prefix else "") + text).replace(" ", SPACE)
        out = list(chain.from_iterable(map(self.stretch, map(itemgetter(0), self.stretches.finditer(marked)))))
        if not self.model.byte_fallback and self.unknown in out:  # a run of unknown symbols has one id
            out = [x for i, x in enumerate(out) if x != self.unknown or not i or out[i - 1] != x]
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become a replacement character each; the mark before the first word goes."""
        if not self.controls.isdisjoint(ids):  # they have no text, and no character's bytes lie on both sides of one
            runs = [list(g) for control, g in groupby(ids, self.controls.__contains__) if not control]
            return "".join(self._read(run, not i) for i, run in enumerate(runs))
        return self._read(ids, True)

    def _read(self, ids: Sequence[int], first: bool) -> str:
        parts = [self.surface[i] for i in ids]
        if first and ids and self.kinds[ids[0]] == NORMAL:
            if self.model.squeeze:
                at = 0
                while at < len(ids) and self.kinds[ids[at]] == NORMAL:  # a squeezing model's leading spaces all go
                    parts[at] = parts[at].removeprefix(b" ")
                    if parts[at]:
                        break
                    at += 1
            elif self.model.dummy_prefix:
                parts[0] = parts[0].removeprefix(b" ")
        return b"".join(parts).decode("utf-8", "one-for-each-byte")


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("one-for-each-byte", _each_byte)


def _stretches(pieces: Iterable[str]) -> re.Pattern:
    """Cuts a text where no piece reaches across.

    A character that no longer piece has stands alone. Where pieces have the word
    mark in front only, a stretch ends before it. Letters end a stretch before a
    character that follows no letter in any piece.
    """
    joined = {c for p in pieces if len(p) > 1 for c in p} - {SPACE}
    letters = {c for c in joined if c.isalpha()}
    after = {b for p in pieces for a, b in zip(p, p[1:]) if a in letters} - letters
    mark = f"{SPACE}*"
    if SPACE in after or any(SPACE in p.lstrip(SPACE) for p in pieces):
        mark, letters, after, joined = "", set(), set(), joined | {SPACE}
    some, word, goes_on, other = (f"[{''.join(re.escape(c) for c in sorted(x))}]" if x else "(?!)" for x in (joined, letters, after, joined - letters))
    return re.compile(f"{mark}{word}++(?!{goes_on})|{mark}(?={some})(?:{other}|{word}++(?={goes_on}))*+{word}*+|{SPACE}+|.", re.DOTALL)


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text", decoded: str | None = None, check: str | None = None) -> DataFrame:
    """Id and ``ids`` (array of int) of every row's whole text, by the model in the file ``model``.

    Ids are those of the sentencepiece library, without begin and end marks and
    without sampling. decoded: a column of this name has the text that decode()
    reads the ids as. check: a column ``agrees`` tells for each row whether the
    library, run over the same batch, gives the same ids ("ids"), and also reads
    them as the same text ("both"). A null or empty text has no ids. Bytes that are no UTF-8 count as
    replacement characters. Repeated rows give repeated results; a null id stays
    null; other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    known, name = read_model(model), _name(model)
    raw = _contents(model) if check else None
    fields = [id_column, "ids", *([decoded] if decoded else []), *(["agrees"] if check else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(name, lambda: Pieces(known))
        library = kept_in_worker(f"{name}-library", lambda: _library(raw)) if check else None
        for b in sliced(batches):
            texts = [(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            ids = [pieces.encode(t) for t in texts]
            cols = [b.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if decoded or check == "both":
                read = [pieces.decode(i) for i in ids]
            if decoded:
                cols.append(pa.array(read, pa.string()))
            if check:
                cols.append(pa.array(agreeing(library, texts, ids, read if check == "both" else None), pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, fields)

    schema = f"`{id_column}` {kind}, ids array<int>{f', `{decoded}` string' if decoded else ''}{', agrees boolean' if check else ''}"
    return docs.select(F.col(f"`{id_column}`"), utf8(F.col(f"`{text}`")).alias("_b")).mapInArrow(run, schema)


def _library(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def agreeing(library, texts: list[str], ids: list[list[int]], decoded: list[str] | None) -> list[bool]:
    """Whether the library gives these ids, and reads them as these texts, if there are any."""
    same = [a == b for a, b in zip(ids, library.encode(texts, num_threads=1))]
    return same if decoded is None else [ok and a == b for ok, a, b in zip(same, decoded, library.decode(ids))]


def _name(path: str) -> str:
    return f"pieces-{sha256(_contents(path)).hexdigest()}"


def _contents(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in a column ``name``, as the sentencepiece library's decode(ids) reads them.

    Control ids have no text; null ids have none. Ids that the model does not have are an error.
    """
    known, kept = read_model(model), _name(model)
    rest = [c for c in encoded.columns if c != name]
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest), f"`{name}` string"])
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(kept, lambda: Pieces(known))
        for b in sliced(batches):
            col = b.column(at)
            values, edges = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            there = col.is_valid().to_pylist()
            texts = [pieces.decode(values[start:end].tolist()) if ok else None for ok, start, end in zip(there, [0, *edges[:-1].tolist()], edges.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*rest, name])

    return encoded.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they are read back as."""
    import public_tokenizers as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return encode(docs, p.path("piece_bpe_32k.model"), decoded="read").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("read", 256).alias("decoded_sha256"))
