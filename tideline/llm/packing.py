"""Best-fit packing of token sequences, by hierarchical residual packing.

Documents are tokenised once and cut into pieces. Pieces are dealt out over
partitions, each packs its own by best fit decreasing; bins that are full, or
that nothing small enough is left to fill, are done. The others go on as items of
a round with fewer partitions, until one task has packed all that is left or a
round saves no more than a thousandth of its bins.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialise, row_count, small_batches

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Items that one task packs, about, and rounds of merging at most.
ITEMS_PER_TASK = 50_000
MERGE = 8
MAX_ROUNDS = 12

PIECES = "piece int, start long, length long, ids_crc32 long"

#: Characters on whose classes all versions of the Unicode tables agree; other
#: texts take the slower of two tokenizers that share one vocabulary.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧€]*\Z")


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None):
    """A function from text to token ids.

    vocabulary: a tokenizers JSON file. ranks and pattern: the same vocabulary as
    tiktoken ranks, with its splitting pattern; given these, plain texts are
    encoded by tiktoken, which returns the same ids several times as fast. A text
    that holds the string of an added token has that token's id there, as
    ``tokenizers`` gives it.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    if not ranks:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if _PLAIN.match(text) and not any(t in text for t in added):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def public_encoder():
    """byte_bpe_50k, by the files of the public_tokenizers package on the executor."""
    import public_tokenizers as p

    return encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def cut(ids: list[int], size: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids and the end id after them.

    Only a document of more than ``size`` ids is cut: from its end, so that the
    first piece is the shorter one.
    """
    packed = np.array([*ids, END_ID], "<u4")
    n = len(packed)
    first = n - (n - 1) // size * size
    edges = [0, *range(first, n + 1, size)]
    return [(i, a, b - a, crc32(packed[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SEQUENCE_TOKENS, make_encoder=public_encoder) -> DataFrame:
    """Key, piece, start, length and ids_crc32 of every piece of every row. Null text: empty."""
    kind = small_batches(docs).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for b in batches:
            rows = [cut(encode(t or ""), size) for t in b.column(1).to_pylist()]
            which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            cols = list(zip(*(p for r in rows for p in r), strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {PIECES}")


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each item, best fit in order of falling length. lengths: falling, at most ``size``."""
    at = np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # the distinct rooms left, ascending
    by_room: dict[int, list[int]] = {}
    n = 0
    for i, need in enumerate(lengths.tolist()):
        k = bisect_left(rooms, need)
        if k == len(rooms):
            number, room = n, size
            n += 1
        else:
            room = rooms[k]
            number = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                del rooms[k]
        at[i] = number
        if room := room - need:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(number)
    return at


def _round(items: DataFrame, tasks: int, size: int, seed: int) -> DataFrame:
    """Packs items (id, length, shift, members) within ``tasks`` partitions into bins of the same form.

    An item is a bin of the round before; members holds (row, offset) of the
    pieces in it. The order within a task is fixed by length and id, so a task
    that runs again packs alike.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        df = pd.concat(got, ignore_index=True).sort_values(["length", "id"], ascending=[False, True], kind="stable", ignore_index=True)
        bins = best_fit(df["length"].to_numpy(), size)
        order = np.argsort(bins, kind="stable")
        ids, lengths, rows, offsets = (df[c].to_numpy() for c in ("id", "length", "rows", "offsets"))
        starts = np.flatnonzero(np.r_[True, bins[order][1:] != bins[order][:-1]])
        out = []
        for a, b in zip(starts, np.r_[starts[1:], len(order)]):
            own = order[a:b]
            before = np.r_[0, np.cumsum(lengths[own])[:-1]]
            out.append((ids[own[0]], int(lengths[own].sum()), np.concatenate([rows[i] for i in own]), np.concatenate([offsets[i] + s for i, s in zip(own, before)])))
        for i in range(0, len(out), 10_000):
            yield pd.DataFrame(out[i : i + 10_000], columns=["id", "length", "rows", "offsets"])

    dealt = items.repartition(tasks, F.xxhash64("id", F.lit(seed)))
    return dealt.mapInPandas(pack, "id long, length long, rows array<long>, offsets array<long>")


def pack(sized: DataFrame, row: str = "row", length: str = "length", size: int = SEQUENCE_TOKENS, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``row``, sequence_id and offset for every row of ``sized``.

    row: distinct longs; length: from 1 to ``size``. The sequence_id is the row
    number of one of a sequence's members. Each round but the first has only bins
    that are not full, and a bin whose room is smaller than the least item leaves
    at once, as nothing can fill it. Rounds end when one saves no more than a
    thousandth of its bins or when one task could hold all that is left.
    """
    bad = sized.where(f"{length} is null or {length} < 1 or {length} > {size} or {row} is null").limit(1).count()
    if bad:
        raise ValueError(f"lengths must be from 1 to {size}")
    items = sized.select(F.col(row).alias("id"), F.col(length).cast("long").alias("length"), F.array(F.col(row)).alias("rows"), F.array(F.lit(0).cast("long")).alias("offsets"))
    done = []
    n = row_count(items)
    tasks = max(1, -(-n // items_per_task))
    for k in range(MAX_ROUNDS):
        bins = materialise(_round(items, tasks, size, k), "bins")
        stats = bins.agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least")).first()
        if tasks == 1 or (k and n - stats["n"] <= n // 1000):
            done.append(bins)
            break
        open_bin = F.col("length") + F.lit(stats["least"]) <= size
        done.append(bins.where(~open_bin))
        items = bins.where(open_bin)
        n = row_count(items)
        tasks = min(tasks, max(1, tasks // MERGE, -(-n // items_per_task)))
    else:
        done.append(items)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(F.col("id").alias("sequence_id"), F.explode(F.arrays_zip("rows", "offsets")).alias("m")).select(F.col("m.rows").alias(row), "sequence_id", F.col("m.offsets").alias("offset"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SEQUENCE_TOKENS, make_encoder=public_encoder) -> DataFrame:
    """Pieces of all rows with their sequence_id and offset, in as few sequences as the method finds.

    A null or empty text is one piece that holds the end id alone. Rows with
    equal keys, repeated rows and null keys are packed each for itself. An empty
    table gives an empty result; other columns are not read.
    """
    # A row number that survives a task's second run: the table is written with it.
    numbered = materialise(pieces(docs, key, text, size, make_encoder).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(numbered.select("row", "length"), size=size)
    return numbered.join(placed, "row").drop("row")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
