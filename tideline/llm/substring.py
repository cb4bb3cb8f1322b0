"""Substring dedup over a compacted De Bruijn graph of token k-mers, checked word by word.

Sampled k-mers: every window of 20 words is stood for by the least-hashed of its
6-word k-mers, so equal windows choose equal k-mers at equal places. The windows of
a document that choose the same occurrence of a k-mer form a run, the edge of that
k-mer, labelled by its windows' hashes; the run after it in the document is its
successor. Windows that repeat an earlier one of their own document are settled on
the spot, word by word, and take no further part, as their first place is enough for
all others. K-mers seen once have no repeated edge and are dropped.

Graph: a k-mer with one label is one edge. A k-mer with several labels branches, and
these are cut into windows, of which those stay together that have one predecessor
and one successor in all labels. So each repeated window belongs to one vertex, always
the same. A link between neighbours does not branch if each occurrence of either vertex is next to the other, that is, if link
and both vertices are counted equally often. Links are counted and joined to the
vertices' occurrences, and chains of unbranched links are compacted into paths.

Check: the words of each path are read at every source coordinate and grouped by
what they are, byte by byte; the earliest place of each stays. Hashes only propose:
where the words of one path differ, its windows are grouped by their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import bucketed, discard, materialise, small_batches, utf8

WINDOW = 20
KMER = 6
#: Bytes of text that are hashed together.
CHUNK_BYTES = 1 << 21

#: Bytes of text in a bucket of the texts, about, and the most buckets; there are as many as shuffle partitions at least.
BUCKET_BYTES, MAX_BUCKETS = 128 << 20, 100_000

#: Words longer than this are hashed one by one.
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * _M2
    return a ^ (a >> np.uint64(29))


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return _mix(a[:n] * _M1 + b[:n])


def gram_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 6-word and all 20-word sequences, from those of 2, 4, 8 and 16 words."""
    h2 = _then(words, words[1:])
    h4 = _then(h2, h2[2:])
    h8 = _then(h4, h4[4:])
    h16 = _then(h8, h8[8:])
    return _then(h4, h2[4:]), _then(h16, h4[16:])


def word_hashes(bodies: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, one after the other, and how many words each text has.

    Words are read eight bytes at a time out of the joined texts.
    """
    from xxhash import xxh64_intdigest

    bodies = [b or b"" for b in bodies]
    data = b" ".join([b"", *bodies, b" " * 8])
    blank = _SPACE[np.frombuffer(data, np.uint8)]
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    size = end - start
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # at each place, the eight bytes from there on
    words = _mix((eight[start] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * _M1)
    done, more = 8, np.flatnonzero(size > 8)
    while len(more) and done < LONG_WORD:
        words[more] = _mix(words[more] * _M1 + (eight[start[more] + done] & _KEEP[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in more.tolist():
        words[i] = xxh64_intdigest(data[start[i] : end[i]])
    edges = np.cumsum([1, *(len(b) + 1 for b in bodies)])
    return words, np.diff(np.searchsorted(start, edges))


def _chunks(bodies: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    """(index of the first, texts) for stretches of about CHUNK_BYTES."""
    first, size = 0, 0
    for i, b in enumerate(bodies, 1):
        size += len(b or b"")
        if size >= CHUNK_BYTES or i == len(bodies):
            yield first, bodies[first:i]
            first, size = i, 0


def own_repeats(bodies: list[bytes | None], counts: np.ndarray, doc: np.ndarray, windows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of stretches of windows whose words also start earlier in their text, as places among all words."""
    keys = _mix(windows[at] * _M1 + doc[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    fresh = np.r_[True, keys[order][1:] != keys[order][:-1]]
    later, first = at[order[~fresh]], at[order[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))][~fresh]]
    turn = np.argsort(later)
    later, first = later[turn], first[turn]
    edge = np.flatnonzero(np.r_[True, (np.diff(later) != 1) | (np.diff(first) != 1) | (np.diff(doc[later]) != 0)] if len(later) else np.zeros(0, bool))
    before, split, out = np.cumsum(counts) - counts, (-1, []), []
    for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(later)]):
        d = int(doc[later[a]])
        if doc[first[a]] != d:
            continue
        if split[0] != d:
            split = (d, bodies[d].split())
        x, y, words = int(later[a] - before[d]), int(first[a] - before[d]), split[1]
        n = z - a
        if words[x : x + n + WINDOW - 1] == words[y : y + n + WINDOW - 1]:
            out.append((int(later[a]), n))
        else:
            out += [(int(later[a]) + i, 1) for i in range(n) if words[x + i : x + i + WINDOW] == words[y + i : y + i + WINDOW]]
    start, size = np.array(out, np.int64).reshape(-1, 2).T
    fresh = np.flatnonzero(np.r_[True, start[1:] != start[:-1] + size[:-1]] if len(out) else np.zeros(0, bool))
    return start[fresh], np.add.reduceat(size, fresh) if len(out) else size


def runs_of(bodies: list[bytes | None]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(kmer, label, text, start, windows) of every run in some texts, and (text, start, windows) of their own repeats."""
    words, counts = word_hashes(bodies)
    none = np.zeros(0, np.int64)
    nothing = (none,) * 5, (none,) * 3
    if len(words) < WINDOW:
        return nothing
    kmers, windows = gram_hashes(words)
    doc = np.repeat(np.arange(len(bodies)), counts)
    at = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :])
    if not len(at):
        return nothing
    before = np.cumsum(counts) - counts
    again, again_size = own_repeats(bodies, counts, doc, windows, at)
    if len(again):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, again, 1)
        np.add.at(gone, again + again_size, -1)
        at = at[np.cumsum(gone)[at] == 0]
    least = np.lib.stride_tricks.sliding_window_view(kmers, WINDOW - KMER + 1).argmin(axis=1)[at] + at
    start = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)])
    size = np.diff(np.r_[start, len(at)])
    label = _mix(np.add.reduceat(_mix(windows[at]), start) + size.astype(np.uint64))
    first = at[start]
    which = doc[first]
    own = doc[again]
    return (kmers[least[start]].view(np.int64), label.view(np.int64), which, first - before[which], size), (own, again - before[own], again_size)


def edges(docs: DataFrame) -> DataFrame:
    """(kmer, label, row, doc, place) of every run of (row, doc, body) rows; place packs start and number of windows.

    Of a document's own repeats kmer is null, place the start and label the number of windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kmer", "label", "row", "doc", "place"]
        for b in batches:
            rows, keys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, bodies in _chunks(b.column(2).to_pylist()):
                (kmer, label, which, start, size), (own, own_start, own_size) = runs_of(bodies)
                which, own = which + first, own + first
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (kmer, label, rows[which], keys[which], start << 8 | size)], names)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), *(pa.array(x, pa.int64()) for x in (own_size, rows[own], keys[own], own_start))], names)

    return docs.select("row", "doc", "body").mapInArrow(run, "kmer long, label long, row long, doc long, place long")


class Texts:
    """Documents (row, doc, body and the caller's key) with a number of their own, bucketed by it.

    Three passes join what was found with the texts; over buckets only the found
    places are shuffled, not the texts. Numbers come from a written table, so a
    task that runs again cannot change them.
    """

    def __init__(self, docs: DataFrame, key: str, text: str):
        spark = small_batches(docs).sparkSession
        body = F.coalesce(utf8(text), F.lit(b""))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc"), body.alias("body"))
        plain = materialise(rows, "numbered")
        size = plain.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
        self.buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
        self.docs = bucketed(plain, "row", self.buckets, "texts")
        discard(plain)

    def with_places(self, places: DataFrame, fields: list[str], how: str = "inner") -> DataFrame:
        """The documents and ``at``, the list of their places: structs of ``fields``."""
        listed = places.repartition(self.buckets, "row").groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("at"))
        return self.docs.join(listed.hint("merge"), "row", how)


def _listed(column: pa.ListArray, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The row that each struct of a column of lists is in, and some of its fields."""
    sizes = np.array(column.value_lengths().fill_null(0))
    structs = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(structs.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _windows_at(texts: Texts, places: DataFrame) -> DataFrame:
    """(kmer, label, n, hash[]) for the runs in ``places``: their windows' hashes, read from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, kmer, label, n, place = _listed(b.column(1), ("kmer", "label", "n", "place"))
            for first, bodies in _chunks(b.column(0).to_pylist()):
                words, counts = word_hashes(bodies)
                _, windows = gram_hashes(words)
                own = slice(*np.searchsorted(which, [first, first + len(bodies)]))
                start, size = place[own] >> 8, place[own] & 255
                before = (np.cumsum(counts) - counts)[which[own] - first] + start
                ends = np.cumsum(size)
                flat = windows[np.repeat(before - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].view(np.int64)
                hashes = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (kmer[own], label[own], n[own])), hashes], ["kmer", "label", "n", "hash"])

    joined = texts.with_places(places, ["kmer", "label", "n", "place"]).select("body", "at")
    return joined.mapInArrow(run, "kmer long, label long, n long, hash array<long>")


def vertices(texts: Texts, every: DataFrame) -> DataFrame:
    """(row, doc, start, size, k, v, n): the occurrences of every repeated vertex (k, v), seen n times, of written edges.

    A vertex is a run of a k-mer with one label, or some windows of a run that always
    stand together. Counts are partial sums before any shuffle, and joins
    have written tables on both sides, so that adaptive execution can split k-mers
    and labels that a frequent passage fills.
    """
    every = every.where("kmer is not null")
    seen_again = materialise(every.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kmer"), "kmers")
    some = materialise(every.join(seen_again.hint("merge"), "kmer", "left_semi"), "repeated")
    discard(seen_again)

    # distinct labels, each with one of its places; a k-mer with two or more branches
    labels = materialise(some.groupBy("kmer", "label").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("place").alias("place")), "labels")
    branching = materialise(labels.groupBy("kmer").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("kmer"), "branching")
    branches = labels.join(branching.hint("merge"), "kmer", "left_semi")
    windows = materialise(_windows_at(texts, branches), "windows")
    # degrees inside a run; the ends of a run count as one more neighbour
    side = lambda i: F.coalesce(F.try_element_at("hash", i).bitwiseAND((1 << 32) - 1), F.lit(-1))
    neighbours = F.transform("hash", lambda h, j: F.struct(j.alias("j"), h.alias("hash"), side(j + 2).alias("next"), F.when(j > 0, side(j)).otherwise(-1).alias("prev")))
    window = windows.select("kmer", "label", "n", F.explode(neighbours).alias("w")).select("kmer", "label", "n", "w.*")
    ends = [f(c).alias(f"{c}_{k}") for c in ("next", "prev") for k, f in (("lo", F.min), ("hi", F.max))]
    often = window.groupBy("kmer", "hash").agg(F.sum("n").alias("m"), *ends).where("m > 1")
    often = materialise(often.select("kmer", "hash", "m", F.expr("next_lo = next_hi and next_lo >= 0").alias("one_out"), F.expr("prev_lo = prev_hi and prev_lo >= 0").alias("one_in")), "often")
    shared = window.join(often.hint("merge"), ["kmer", "hash"]).groupBy("kmer", "label").agg(F.sort_array(F.collect_list(F.struct("j", "hash", "m", "one_out", "one_in"))).alias("w"))
    stretch = "struct<j:int,size:int,v:bigint,n:bigint,open:boolean>"
    joined = lambda a, x: F.element_at(a, -1)["open"] & x["one_in"] & (F.element_at(a, -1)["j"] + F.element_at(a, -1)["size"] == x["j"])
    longer = lambda a, x: F.concat(
        F.slice(a, 1, F.size(a) - 1),
        F.array(F.struct(F.element_at(a, -1)["j"].alias("j"), (F.element_at(a, -1)["size"] + 1).alias("size"), F.element_at(a, -1)["v"].alias("v"), F.element_at(a, -1)["n"].alias("n"), x["one_out"].alias("open"))),
    )
    fresh = lambda x: F.array(F.struct(x["j"].alias("j"), F.lit(1).alias("size"), x["hash"].bitwiseAND(-2).alias("v"), x["m"].alias("n"), x["one_out"].alias("open")))
    cut = F.aggregate("w", F.array().cast(f"array<{stretch}>"), lambda a, x: F.when((F.size(a) > 0) & joined(a, x), longer(a, x)).otherwise(F.concat(a, fresh(x))))
    known = labels.select("kmer", "label", "n").join(shared.select("kmer", "label", cut.alias("parts")).hint("merge"), ["kmer", "label"], "left").where("n > 1 or parts is not null")
    known = materialise(known, "known")
    whole = F.array(F.struct(F.lit(0).alias("j"), F.col("place").bitwiseAND(255).cast("int").alias("size"), F.col("label").bitwiseOR(1).alias("v"), "n", F.lit(False).alias("open")))
    part = F.explode(F.coalesce("parts", whole)).alias("x")
    found = some.join(known.hint("merge"), ["kmer", "label"]).select("row", "doc", "kmer", F.shiftright("place", 8).alias("start"), part)
    found = materialise(found.select("row", "doc", (F.col("start") + F.col("x.j")).alias("start"), "x.size", F.col("kmer").alias("k"), "x.v", "x.n"), "vertices")
    discard(some, labels, branching, windows, often, known)
    return found


def paths(found: DataFrame) -> DataFrame:
    """(row, doc, start, size, k, v): each document's stretches of unbranched links, named by their first vertex."""
    in_text = Window.partitionBy("row").orderBy("start")
    before = F.lag(F.struct("start", "size", "k", "v", "n")).over(in_text)
    linked = found.withColumn("b", before)
    near = (F.col("b.start") + F.col("b.size") == F.col("start")) & (F.col("b.n") == F.col("n"))
    linked = materialise(linked.select("row", "doc", "start", "size", "k", "v", "n", F.when(near, F.col("b.k")).alias("bk"), F.when(near, F.col("b.v")).alias("bv")), "linked")
    ends = ["bk", "bv", "k", "v"]
    unbranched = linked.where("bk is not null").groupBy(*ends).agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")).where("m = n")
    unbranched = materialise(unbranched.select(*ends), "links")
    joined = linked.join(unbranched.withColumn("goes_on", F.lit(True)).hint("merge"), ends, "left")
    numbered = joined.withColumn("path", F.count(F.when(F.col("goes_on").isNull(), 1)).over(in_text))
    stretch = numbered.groupBy("row", "path").agg(F.first("doc").alias("doc"), F.min(F.struct("start", "k", "v")).alias("a"), F.sum("size").alias("size"))
    out = materialise(stretch.select("row", "doc", "a.start", "size", "a.k", "a.v"), "paths")
    discard(linked, unbranched)
    return out


def _words_at(texts: Texts, places: DataFrame, single: bool) -> DataFrame:
    """(row, doc, start, k, v, words) of every path in ``places``, or of each of its windows, read from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys, bodies = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            which, start, size, k, v = _listed(b.column(3), ("start", "size", "k", "v"))
            out, held, last, words = [], 0, -1, []
            for i, a, n, *vertex in zip(which.tolist(), start.tolist(), size.tolist(), k.tolist(), v.tolist()):
                if i != last:
                    last, words = i, bodies[i].as_py().split()
                for x, y in ((a + j, 1) for j in range(n)) if single else ((a, n),):
                    span = b" ".join(words[x : x + y + WINDOW - 1])
                    out.append((rows[i], keys[i], x, *vertex, span))
                    held += len(span)
                    if held > CHUNK_BYTES:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)

    names = ["row", "doc", "start", "k", "v", "words"]

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:5]), pa.array([x[5] for x in out], pa.binary())], names)

    joined = texts.with_places(places, ["start", "size", "k", "v"]).select("row", "doc", "body", "at")
    return joined.mapInArrow(run, "row long, doc long, start long, k long, v long, words binary")


def _order() -> Column:
    """(doc, start) as one number of the same order, which hash aggregation can take the least of."""
    return (F.col("doc").cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(13,0)") + F.col("start").cast("decimal(13,0)")).cast("decimal(38,0)")


def repeated_stretches(texts: Texts) -> DataFrame:
    """(row, start, size): stretches of windows whose words also start at an earlier place, checked by their words."""
    runs = materialise(edges(texts.docs), "edges")
    found = vertices(texts, runs)
    own = materialise(runs.where("kmer is null").select("row", F.col("place").alias("start"), F.col("label").alias("size")), "own")
    discard(runs)
    every = paths(found)
    discard(found)
    same = _words_at(texts, every, single=False).select("k", "v", "words", _order().alias("p")).groupBy("k", "v", "words").agg(F.min("p").alias("p"))
    heads = materialise(same.groupBy("k", "v").agg(F.count(F.lit(1)).alias("texts"), F.min("p").alias("p")), "heads")
    later = every.withColumn("at", _order()).join(heads.where("texts = 1").hint("merge"), ["k", "v"]).where("at > p").select("row", "start", "size")
    out = materialise(later, "later")
    # vertices that stand for different words, as hashes are equal by chance or by design: by the words of each window
    unlike = materialise(every.join(heads.where("texts > 1").hint("merge"), ["k", "v"], "left_semi"), "unlike")
    if unlike.limit(1).count():
        window = materialise(_words_at(texts, unlike, single=True).withColumn("at", _order()), "window-words")
        first = materialise(window.groupBy("k", "v", "words").agg(F.min("at").alias("p")), "first-words")
        again = window.join(first.hint("merge"), ["k", "v", "words"]).where("at > p")
        checked, out = out, materialise(out.union(again.select("row", "start", F.lit(1).cast("long").alias("size"))), "later")
        discard(window, first, checked)
    discard(every, heads, unlike)
    return out.union(own)


def _cover(counts: np.ndarray, which: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words of some texts, one after the other, are in a window of a stretch."""
    edge = np.zeros(counts.sum() + 1, np.int32)
    at = (np.cumsum(counts) - counts)[which] + start
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size + WINDOW - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(texts: list[list[bytes]], gone: np.ndarray) -> Iterator[tuple[int, int, list[dict[str, int]], bytes]]:
    """(words, words gone, their spans, the others joined) of each text."""
    at = 0
    for words in texts:
        own = gone[at : at + len(words)]
        at += len(words)
        if not own.any():
            yield len(words), 0, [], b" ".join(words)
            continue
        turn = np.flatnonzero(np.diff(np.r_[False, own, False])).tolist()
        yield len(words), int(own.sum()), [{"start": a, "stop": z} for a, z in zip(turn[::2], turn[1::2])], b" ".join(compress(words, (~own).tolist()))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, removed (spans of word numbers) and kept (text) of every row.

    Each word goes that is covered by a 20-word window whose words also start at an
    earlier place: in a row of smaller key, or earlier in a row of the same key.
    Windows are judged on the input. kept: the other words joined by one blank. Keys
    are integers; a null key comes before all others. Rows that share a key, null
    too, count as one document in this: of equal windows at equal starts in them
    none is earlier, so repeated rows give repeated results, and a window of one
    can repeat an earlier start in another. Null, empty and short texts lose
    nothing. An empty table gives an empty result; other columns are not read, and
    key may have any name.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = Texts(docs, key, text)
    found = repeated_stretches(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, start, size = _listed(b.column(2), ("start", "size"))
            out = []
            for first, bodies in _chunks(b.column(1).to_pylist()):
                texts = [t.split() for t in bodies]
                own = slice(*np.searchsorted(which, [first, first + len(bodies)]))
                gone = _cover(np.array([len(t) for t in texts]), which[own] - first, start[own], size[own])
                out += _kept(texts, gone)
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, "n_words", "n_removed", "removed", "kept"])

    joined = texts.with_places(found, ["start", "size"], "left").select("key", "body", "at")
    out = joined.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, removed array<struct<start:bigint, stop:bigint>>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
