"""Near-duplicates by 64-bit SimHash: fingerprints, trie self-joins, components.

Of budget + 1 blocks of bits, two fingerprints within the error budget agree in
one. So there is one binary trie for each block, over fingerprints turned so that
the block comes first, and each fingerprint goes to each trie once. A trie is cut
into subtries by its top bits; a job walks the node pairs of one subtrie together,
along equal nodes inside the leading block and with the differing bits so far below
it, and stops as soon as they exceed the budget. A job gives back only the edges of
a spanning forest of the links it found, so a group of k near copies costs at most
k edges for each trie. A subtrie that holds far more than the mean is cut deeper,
and its jobs are the pairs of such nodes that the budget allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import connected_components, discard, join_counted, least_rows, materialise, numbered, row_count, small_batches, utf8

SHINGLE_WORDS = 3
MAX_BITS = 3
#: Fingerprints in a subtrie, about.
SUBTRIE = 1 << 14
#: Bits by which a hot subtrie is cut deeper, at most: 1351 copies of a fingerprint for a budget of 3.
DEEPER = 20
_A_TO_Z = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(body: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's UTF-8 bytes: shingles of ``width`` words hashed by XXH64 with seed 42, as unsigned."""
    from xxhash import xxh64_intdigest

    words = (body or b"").translate(_A_TO_Z).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(flat, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: 1 - width or None].tolist()
    hashes = np.array([xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        set_bits += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], text: str, width: int = SHINGLE_WORDS) -> DataFrame:
    """The columns to ``keep`` of every row, and fp, its text's fingerprint as a signed long."""
    kept = small_batches(docs).select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, width) for x in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], [*kept.names, "fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp long"])
    return docs.select(*keep, utf8(text).alias("_b")).mapInArrow(run, schema)


def walk_pairs(a: np.ndarray, b: np.ndarray, depth: int, budget: int, exact: int = 0, leaf: int = 24, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i], b[j] within ``budget`` bits, walking two sorted subtries together.

    a and b: ascending unsigned fingerprints, each of one subtrie of ``depth``
    top bits. Pairs that differ in the first ``exact`` bits may be left out. A frontier of node pairs is kept as index ranges with the bits that
    differ so far; a pair splits into its children's pairs one bit further down,
    and is dropped when its differences exceed the budget. Ranges of at most
    ``leaf`` fingerprints are compared outright. At most ``block`` node pairs are
    split at a time, depth first, so memory stays bounded.
    """
    differ = int((int(a[0]) ^ int(b[0])) >> (64 - depth)).bit_count() if depth and len(a) and len(b) else 0
    if not len(a) or not len(b) or differ > budget:
        return
    stack = [(depth, np.array([[0, len(a), 0, len(b), differ]], np.int64))]
    while stack:
        level, pairs = stack.pop()
        small = (pairs[:, 1] - pairs[:, 0] <= leaf) & (pairs[:, 3] - pairs[:, 2] <= leaf) if level < 64 else np.ones(len(pairs), bool)
        if small.any():
            yield from _compare(a, b, pairs[small], budget)
            pairs = pairs[~small]
        if len(pairs) > block:
            stack += [(level, pairs[i : i + block]) for i in range(0, len(pairs), block)]
            continue
        if not len(pairs):
            continue
        cut_a, cut_b = _cut(a, pairs[:, 0], pairs[:, 1], level), _cut(b, pairs[:, 2], pairs[:, 3], level)
        halves_a = ((pairs[:, 0], cut_a), (cut_a, pairs[:, 1]))
        halves_b = ((pairs[:, 2], cut_b), (cut_b, pairs[:, 3]))
        children = np.concatenate([np.stack([*halves_a[x], *halves_b[y], pairs[:, 4] + (x != y)], axis=1) for x in (0, 1) for y in (0, 1)])
        children = children[(children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= (budget if level >= exact else 0))]
        if len(children):
            stack.append((level + 1, children))


def _cut(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where the bit at ``level`` turns from 0 to 1 in each range, which shares all bits above."""
    one = np.uint64(1) << np.uint64(63 - level)
    middle = (v[lo] >> np.uint64(63 - level) << np.uint64(63 - level)) | one
    return np.clip(np.searchsorted(v, middle), lo, hi)


def _compare(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows, cols = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    for chunk in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(np.cumsum(rows * cols) >> 20)) + 1):
        n = rows[chunk] * cols[chunk]
        which = np.repeat(chunk, n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = pairs[which, 0] + k // cols[which], pairs[which, 2] + k % cols[which]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        yield i[near], j[near]


def spanning_forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest member of each of n nodes' components, and the links of a forest that spans them."""
    root, used = np.arange(n), [(np.zeros(0, np.int64),) * 2]
    for i, j in links:
        while len(i):
            ri, rj = root[i], root[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            high, low = np.maximum(ri, rj), np.minimum(ri, rj)
            np.minimum.at(root, high, low)
            joins = np.flatnonzero(root[high] == low)  # one link for each root that was joined to another
            joins = joins[np.unique(high[joins], return_index=True)[1]]
            used.append((i[joins], j[joins]))
            while (root != root[root]).any():
                root = root[root]
    return root, *(np.concatenate(x) for x in zip(*used))


def turned(fps: np.ndarray, by: int) -> np.ndarray:
    """Unsigned 64-bit numbers rotated left."""
    return (fps << np.uint64(by)) | (fps >> np.uint64(64 - by)) if by % 64 else fps


def flips(block: int, bits: int, deeper: int, budget: int) -> list[int]:
    """Numbers of ``deeper`` bits that stand below ``bits`` others: at most ``budget`` set, and none inside the leading block."""
    free = [1 << deeper - 1 - i for i in range(deeper) if bits + i >= block]
    return [sum(c) for k in range(budget + 1) for c in combinations(free, k)]


def near_links(fps: DataFrame, budget: int = MAX_BITS, subtrie: int = SUBTRIE, stars: bool = True) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp``: with the same components as all links within ``budget`` bits.

    stars: edges lead from each component that a job sees to its members; else
    they are links themselves.
    """
    spark, n, block = fps.sparkSession, row_count(fps), 64 // (budget + 1)
    # depth of the cut: mean subtrie size
    bits = min(block, max(6, (max(n, 1) // subtrie).bit_length()))
    turns = F.array([F.struct(F.lit(r).alias("r"), F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", 64 - r)).alias("v")) for r in range(0, block * (budget + 1), block)])
    rows = fps.select(F.explode(turns).alias("x")).select("x.r", "x.v", F.shiftrightunsigned("x.v", 64 - bits).alias("p"))
    # A subtrie of over four times the mean is cut by t further bits; a job has one or two of its nodes.
    # One row for each trie and prefix, (budget + 1) * 2^16 at most, and one for each depth.
    most = max(64, 4 * n >> bits)
    cuts = spark.createDataFrame([(t, flips(block, bits, t, budget)) for t in range(DEEPER + 1)], "t int, flips array<int>")
    deeper = F.least(F.lit(DEEPER), F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / most)))).cast("int")
    parts = rows.groupBy("r", "p").agg(deeper.alias("t")).join(F.broadcast(cuts), "t")
    own = rows.join(F.broadcast(parts), ["r", "p"])
    own = own.withColumn("q", F.expr(f"cast(shiftrightunsigned(shiftleft(v, {bits}), 64 - t) as int)")).withColumn("q", F.when(F.col("t") > 0, F.col("q")).otherwise(0))
    jobs = own.withColumn("o", F.explode(F.transform("flips", lambda m: m.bitwiseXOR(F.col("q")))))
    jobs = jobs.select("r", "p", "t", F.least("q", "o").alias("lq"), F.greatest("q", "o").alias("hq"), (F.col("q") <= F.col("o")).alias("left"), "v")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        by, is_left, depth = int(pdf["r"].iloc[0]), pdf["left"].to_numpy(bool), bits + int(pdf["t"].iloc[0])
        v = pdf["v"].to_numpy(np.int64).view(np.uint64)
        a, b = np.sort(v[is_left]), np.sort(v[~is_left])
        if pdf["lq"].iloc[0] == pdf["hq"].iloc[0]:
            found, nodes = spanning_forest(len(a), walk_pairs(a, a, depth, budget, block)), a
        else:
            links = ((i, j + len(a)) for i, j in walk_pairs(a, b, depth, budget, block))
            found, nodes = spanning_forest(len(a) + len(b), links), np.concatenate([a, b])
        root, i, j = found
        if stars:
            j = np.flatnonzero(root != np.arange(len(root)))
            i = root[j]
        nodes = turned(nodes, 64 - by)
        return pd.DataFrame({"a": nodes[i].view(np.int64), "b": nodes[j].view(np.int64)})

    return jobs.groupBy("r", "p", "t", "lq", "hq").applyInPandas(walk, "a long, b long")


def _classes(marked: DataFrame, budget: int) -> DataFrame:
    """(fp, part, component_id) of every fingerprint: part names its component, component_id is the component's smallest key."""
    classes = materialise(marked.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    labels = connected_components(near_links(classes.select("fp"), budget))
    labelled = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("part"))
    labelled = materialise(labelled, "classes")
    ids = labelled.groupBy("part").agg(F.min("least").alias("component_id"))
    out = materialise(join_counted(labelled, ids, ["part"]).select("fp", "part", "component_id"), "components")
    discard(classes, labels, labelled)
    return out


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = MAX_BITS, width: int = SHINGLE_WORDS) -> DataFrame:
    """key, fp and component_id, the smallest key reachable over links, for every row.

    Rows with equal fingerprints are linked; so are rows whose fingerprints
    differ in at most ``budget`` bits. Null and empty texts have fingerprint zero
    and are linked like any other. A row with a null key gets a component; the
    id is null only where all keys in it are null. Repeated rows stay. An empty
    table gives an empty result; other columns are not read.
    """
    marked = materialise(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key"], "text", width), "fingerprints")
    return marked.join(_classes(marked, budget), "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = MAX_BITS, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component of near_components, with all its columns, whatever their names.

    It is the row of the smallest key; where rows of a component share that key,
    one of them. A null key comes after all others. Components that do not hang
    together each keep a row, of equal keys too.
    """
    rows = numbered(docs)
    texts = rows.select("row", F.col(f"doc.`{key}`").alias("key"), F.col(f"doc.`{text}`").alias("text"))
    marked = materialise(fingerprints(texts, ["row", "key"], "text", width), "fingerprints")
    return least_rows(rows, marked.join(_classes(marked, budget), "fp").select("row", "key", "part"))


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
