"""Near-duplicates of a stated Jaccard similarity: SimHash tries, exact checks, and a prefix filter for the rest.

SimHash over the same shingles comes first: the tries of simhash link fingerprints
within a few bits, and the shingle sets of each link are compared. That settles
copies and light edits at a few bits each. Sets of similarity 0.8 can lie further
apart than any budget that a trie can prune by, so what is not linked yet goes
through a prefix filter: all shingles are put in one order, those of many
texts last; two sets of similarity t or more share one of the first
n - ceil(t n) + 1 shingles of each, so no pair is missed, whatever the order. Texts
are counted for every shingle: in a sample of a fixed size, a shingle that has to be
found frequent is in the more texts the more there are, and pairs grow with the square. Each
group's members are first compared with one of them, in a few rounds with others; what
is linked needs no more comparisons, so a group of k near copies costs about k a round. Every pair that is
left and could be similar by its sizes, its places and its parity bits is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import connected_components, discard, join_counted, join_written, least_rows, materialise, numbered, small_batches, utf8
from tideline.llm.simhash import MAX_BITS, majority, near_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts that have a frequent shingle, at least, levels for each doubling of their number, and about the most frequent shingles that are told apart.
FREQUENT, LEVELS, MOST_FREQUENT = 8, 8, 1 << 23
#: Bits of the table of levels, at most: eight places for each of the most frequent shingles, a byte each.
ORDER_BITS = 26
#: Shingles that a task holds when it counts them.
COUNTED = 1 << 20
#: Shingles that a task holds before it hands them on.
BATCH = 1 << 18
#: Rounds that compare a group's members with one of them.
STAR_ROUNDS = 2
#: Parity bits of a text: about two for each shingle, between these powers of two.
LEAST_BITS, MOST_BITS = 9, 17
_A_TO_Z = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(body: bytes | None, width: int = SHINGLE_WORDS) -> tuple[int, np.ndarray]:
    """XXH64 (seed 42, signed) of a text's words, and of its distinct shingles in ascending order.

    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    from xxhash import xxh64_intdigest

    words = (body or b"").translate(_A_TO_Z).split()
    flat = b" ".join(words)
    whole = xxh64_intdigest(flat, 42)
    if len(words) <= width:
        hashes = np.array([whole] if words else [], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: 1 - width or None].tolist()
        hashes = np.fromiter((xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))
    return int(np.uint64(whole).astype(np.int64)), np.unique(hashes.view(np.int64))


def parity(s: np.ndarray) -> bytes:
    """One bit for each place of a table: whether an odd number of the shingles is hashed to it."""
    power = min(MOST_BITS, max(LEAST_BITS, len(s).bit_length() + 1))
    return np.packbits(np.bincount(s.view(np.uint64) & np.uint64((1 << power) - 1), minlength=1 << power).astype(np.uint8) & 1, bitorder="little").tobytes()


def most_common(x: bytes, y: bytes, n: int, m: int) -> int:
    """How many shingles two texts of n and m can have in common: each odd bit of both together is one that they have not."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):  # of two places that become one, the parities add up
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return min(n, m, (n + m - int(np.bitwise_count(a ^ b).sum())) // 2)


def marks(rows: DataFrame, width: int) -> DataFrame:
    """row, key, id (of the text's words), fp (SimHash of its distinct shingles), n (their number) and odd (their parity bits) of (row, key, text) rows."""
    kind = small_batches(rows).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x in b.column(2):
                i, s = shingles(x.as_py(), width)
                got.append((i, int(np.uint64(majority(s.view(np.uint64))).astype(np.int64)), len(s), parity(s)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            more = [pa.array(c, k) for c, k in zip(list(zip(*got)) or [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], ["row", "key", "id", "fp", "n", "odd"])

    return rows.select("row", "key", utf8("text").alias("b")).mapInArrow(run, f"row long, key {kind}, id long, fp long, n int, odd binary")


def frequent_shingles(texts: DataFrame, width: int, power: int) -> DataFrame:
    """top (upper 32 bits of the hash) and level (from 1, by the number of texts) of the shingles of FREQUENT texts or more of (id, b).

    Shingles are dealt by the first ``power`` bits, and told apart by these and 32 more. They only set the order.
    """

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        v, k = np.unique(np.concatenate(found).view(np.uint64) >> np.uint64(32 - power), return_counts=True)
        ends = np.searchsorted(v, np.arange(1, (1 << power) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
        low, once = v.astype(np.uint32), k == 1
        got = [(p, low[a:b][once[a:b]].tobytes(), low[a:b][~once[a:b]].tobytes(), k[a:b][~once[a:b]].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), [pa.int32(), *[pa.binary()] * 3], strict=True)], ["part", "once", "more", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            for x in b.column(0):
                s = shingles(x.as_py(), width)[1]
                found.append(s)
                held += len(s)
                if held > COUNTED:
                    yield packed(found)
                    found, held = [], 0
        if held:
            yield packed(found)

    def often(part: pa.Table) -> pa.Table:
        once, more, k = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint32) for c in ("once", "more", "k"))
        v, at = np.unique(np.concatenate([once, more]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([np.ones(len(once)), k]), minlength=len(v))
        v, n = v[n >= FREQUENT].astype(np.int64), n[n >= FREQUENT]
        top = (part["part"][0].as_py() << 32 | v) >> power
        return pa.table({"top": top, "level": np.minimum(1 + LEVELS * np.log2(n / FREQUENT), 255).astype(np.int32)})

    parts = texts.select("b").mapInArrow(run, "part int, once binary, more binary, k binary")
    return parts.groupBy("part").applyInArrow(often, "top long, level int")


def order_levels(frequent: DataFrame) -> np.ndarray:
    """The levels of a written table of frequent shingles by the first bits of the hash, 0 where there is none; bounded, whatever the table.

    Shingles that share a place have its highest level. Beyond MOST_FREQUENT, the lowest levels are left out.
    """
    least, held = 256, 0
    for r in frequent.groupBy("level").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect():
        if held and held + r.k > MOST_FREQUENT:
            break
        least, held = r.level, held + r.k
    bits = min(ORDER_BITS, (8 * held).bit_length())
    got = frequent.where(F.col("level") >= least).select(F.shiftright("top", 32 - bits).cast("int").alias("at"), F.col("level").cast("short").alias("level")).toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    np.maximum.at(levels, got["at"].to_numpy(), got["level"].to_numpy().astype(np.uint8))
    return levels


def prefixes(texts: DataFrame, levels: np.ndarray, similarity: float, width: int) -> DataFrame:
    """h, id, n (shingles of the text) and at (place in the order) for the shingles that similar texts must share one of."""
    unused = np.uint64(65 - len(levels).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, ids, sizes, places, held = [], [], [], [], 0
            for i, body in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(body.as_py(), width)[1]
                if not len(s):
                    continue
                first = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
                if len(levels) > 1:
                    s = s[np.argsort(levels[s.view(np.uint64) >> unused], kind="stable")]
                found.append(s[:first])
                ids.append(np.full(first, i, np.int64))
                sizes.append(np.full(first, len(s), np.int32))
                places.append(np.arange(first, dtype=np.int32))
                held += first
                if held > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, ids, sizes, places)], ["h", "id", "n", "at"])
                    found, ids, sizes, places, held = [], [], [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, ids, sizes, places)], ["h", "id", "n", "at"])

    return texts.select("id", "b").mapInArrow(run, "h long, id long, n int, at int")


class Texts:
    """(row, b) of all rows, and (id, row, fp, n, odd) of one row for each text of its own words."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.classes = rows, classes

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, b) for a written table of (id, row)."""
        return join_written(self.rows, ids, ["row"]).select("id", "b")


def similar(pairs: DataFrame, texts: Texts, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts' shingle sets have the similarity or more.

    Parity bits, which are a small part of the texts, leave out most pairs that have not.
    """

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            could = []
            for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                common = most_common(x, y, n, m)
                could.append(common >= similarity * (n + m - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(could, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, None
        for batch in batches:
            near = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, s = a, shingles(x.as_py(), width)[1]
                t = shingles(y.as_py(), width)[1]
                common = len(np.intersect1d(s, t, assume_unique=True))
                near.append(common >= similarity * (len(s) + len(t) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    pairs = materialise(pairs, "pairs")
    side = lambda c: texts.classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}")).hint("merge")
    marked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "odda", "nb", "oddb")
    could = materialise(marked.mapInArrow(sifted, "a long, b long"), "pairs")
    ids = could.select(F.col("a").alias("id")).union(could.select("b")).distinct()
    ids = materialise(texts.classes.select("id", "row").join(ids.hint("merge"), "id"), "ids")
    used = materialise(texts.of(ids), "used")
    right = could.join(used.select(F.col("id").alias("b"), F.col("b").alias("y")).hint("merge"), "b")
    both = right.join(used.select(F.col("id").alias("a"), F.col("b").alias("x")).hint("merge"), "a").select("a", "b", "x", "y")
    links = materialise(both.mapInArrow(run, "a long, b long"), "links")
    discard(pairs, could, ids, used)
    return links


def close_fingerprints(classes: DataFrame, budget: int) -> DataFrame:
    """(a, b): ids of equal fingerprints, and a spanning forest of those whose fingerprints are within the budget."""
    by_fp = materialise(classes.groupBy("fp").agg(F.min("id").alias("rep")), "by-fp")
    equal = join_counted(classes, by_fp, ["fp"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = near_links(by_fp.select("fp"), budget, stars=False).withColumnsRenamed({"a": "x", "b": "y"})
    links = links.join(by_fp.select(F.col("fp").alias("x"), F.col("rep").alias("a")), "x").join(by_fp.select(F.col("fp").alias("y"), F.col("rep").alias("b")), "y")
    return equal.union(links.select("a", "b")).distinct()


def similar_links(texts: Texts, similarity: float, width: int, budget: int) -> DataFrame:
    """(node, label) over ids: the components of all pairs of the similarity or more."""
    links = similar(close_fingerprints(texts.classes.select("id", "fp"), budget), texts, similarity, width)
    labels = connected_components(links)
    discard(links)
    ids = texts.classes.select("id", "row")
    n = texts.classes.agg(F.sum("n").alias("n")).first().n or 0
    frequent = materialise(frequent_shingles(texts.of(ids), width, min(16, (n // COUNTED).bit_length())), "frequent")
    every = materialise(prefixes(texts.of(ids), order_levels(frequent), similarity, width), "prefixes")
    often = materialise(every.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "often")
    some = materialise(every.join(often.hint("merge"), "h", "left_semi"), "prefixes")
    many = materialise(some.groupBy("id").agg(F.count(F.lit(1)).alias("many")), "many")
    shared = materialise(join_written(some, many, ["id"]), "prefixes")
    discard(frequent, every, often, some, many)
    for r in range(STAR_ROUNDS + 1):
        marked = join_written(shared.drop("label"), labels.withColumnRenamed("node", "id"), ["id"], "left")
        marked = materialise(marked.withColumn("label", F.coalesce("label", "id")), "prefixes")
        several = materialise(marked.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h"), "several")
        open_ = materialise(marked.join(several.hint("merge"), "h", "left_semi"), "prefixes")
        discard(shared, marked, several)
        shared = open_
        if r < STAR_ROUNDS:
            # a text that has most of its first shingles in common with others is the likeliest to be what they were made from
            rank = [-F.col("many")] if r % 2 == 0 else []
            other = open_.groupBy("h").agg(F.min(F.struct(*rank, F.xxhash64("id", F.lit(r)), "id", "n", "at", "label")).alias("c"))
            other = materialise(other.select("h", F.col("c").alias("rank2"), *(F.col(f"c.{x}").alias(f"{x}2") for x in ("id", "n", "at", "label"))), "centres")
        else:
            other = open_.select("h", *(F.col(x).alias(f"{x}2") for x in ("id", "n", "at", "label")))
        # at the first shingle that two texts share, all that they have in common is still to come
        possible = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) * (1 + similarity) >= similarity * (F.col("n") + F.col("n2")) - 1e-6
        pairs = open_.join(other.hint("merge"), "h").where((F.col("label") != F.col("label2")) & possible)
        if r < STAR_ROUNDS:  # the first of the centres that a text meets, so that a round has a pair for each text at most
            pairs = pairs.groupBy("id").agg(F.min("rank2").alias("c")).select("id", F.col("c.id").alias("id2"))
        else:
            pairs = pairs.where("id < id2")
        links = similar(pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), texts, similarity, width)
        before, labels = labels, connected_components(links.union(labels.select("label", "node")))
        discard(before, links, *([other] if r < STAR_ROUNDS else []))
    discard(shared)
    return labels


def similar_parts(rows: DataFrame, similarity: float, width: int, budget: int) -> DataFrame:
    """(row, key, part) of (row, key, text) rows, which are read several times."""
    marked = materialise(marks(rows, width), "marked")
    classes = marked.groupBy("id").agg(F.min("row").alias("row"))
    classes = materialise(join_counted(marked.drop("key"), classes, ["id", "row"], "left_semi"), "classes")
    keys = materialise(marked.select("row", "key", "id"), "keys")
    discard(marked)
    labels = similar_links(Texts(rows.select("row", utf8("text").alias("b")), classes), similarity, width, budget)
    parts = join_written(classes.select("id"), labels.withColumnRenamed("node", "id"), ["id"], "left")
    parts = materialise(parts.select("id", F.coalesce("label", "id").alias("part")), "parts")
    discard(classes, labels)
    return keys.join(parts.hint("merge"), "id").select("row", "key", "part")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, budget: int = MAX_BITS) -> DataFrame:
    """key and component_id, the smallest key reachable over links, for every row.

    Rows are linked whose sets of ``width``-word shingles (words between ASCII
    blanks, A-Z as a-z) have a Jaccard similarity of ``similarity`` or more, and
    rows of the same words. Texts without words, null or not, are linked with each
    other. Words and shingles are told apart by 64-bit hashes. A row with a null
    key gets a component; the id is null only where all keys in it are null.
    Repeated rows stay. An empty table gives an empty result.
    """
    rows = numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    parts = materialise(similar_parts(rows.select("row", "doc.key", "doc.text"), similarity, width, budget), "parts")
    discard(rows)
    ids = materialise(parts.groupBy("part").agg(F.min("key").alias("component_id")), "components")
    return parts.join(ids.hint("merge"), "part").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, budget: int = MAX_BITS) -> DataFrame:
    """One row of each component of similar_components, with all its columns, whatever their names.

    It is the row of the smallest key; where rows of a component share that key,
    one of them. A null key comes after all others. Components that do not hang
    together each keep a row, of equal keys too.
    """
    rows = numbered(docs)
    texts = rows.select("row", F.col(f"doc.`{key}`").alias("key"), F.col(f"doc.`{text}`").alias("text"))
    return least_rows(rows, similar_parts(texts, similarity, width, budget))
