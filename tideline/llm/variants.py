"""Spelling variants: words one edit apart, by tries that a word's edit automaton is walked through.

The vocabulary is cut into shards by ranges, each a compact trie. Shards are
broadcast some at a time, every word is taken through every shard depth-first, and
what comes back is one row for each word: how many words are near and the best.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from operator import itemgetter
from pickle import dumps, loads
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import BROADCAST_ROWS, discard, materialise, row_count, sliced, utf8

#: Words of one shard, about; bytes of tries that are broadcast at a time; bytes of links that may be.
SHARD_WORDS, ROUND_BYTES, LINK_BYTES = 200_000, 32 << 20, 16 << 20
#: Words that a task takes through the tries of a round.
TASK_WORDS = 20_000
#: Counts that a task gathers before it hands them on.
HELD = 300_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", spelled: Callable[[object, str], str] | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words of all whole texts: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, of which only A-Z are lower-cased.

    spelled(id, run): what a run is to count as. Words of fewer than ``least_length``
    code points and those that occur fewer than ``least_count`` times are left out.
    Null texts have no words; repeated rows count each time. A task hands partial
    sums on, so a frequent word is a few rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for b in sliced(batches):
            for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs = map(itemgetter(0), _RUN.finditer((body or b"").lower().decode("utf-8", "replace")))
                if spelled is None:
                    held.update(w for w in runs if len(w) >= least_length)
                    continue
                for run, n in Counter(runs).items():
                    if len(w := spelled(key, run)) >= least_length:
                        held[w] += n
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    rows = docs.select(F.col(f"`{id_column}`"), utf8(F.col(f"`{text}`")).alias("_b")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """Sorted words in flat arrays: a node's children stand side by side, each edge has the text that all below share.

    first: the nodes' first characters, so one search of a string finds a child.
    n: how often the word that ends at a node occurs, 0 where none does.
    """

    def __init__(self, first: str, labels: str, at: array, child: array, n: array):
        self.first, self.labels, self.at, self.child, self.n = first, labels, at, child, n

    @staticmethod
    def of(words: Sequence[str], counts: Sequence[int]) -> Trie:
        ranges = [(0, len(words), 0, "")]
        child, n = array("I"), array("q")
        for lo, hi, depth, _ in ranges:  # grows while it is read: level by level
            n.append(counts[lo] if lo < hi and len(words[lo]) == depth else 0)
            lo += n[-1] > 0
            child.append(len(ranges))
            while lo < hi:
                end = bisect_right(words, words[lo][depth], lo, hi, key=itemgetter(depth))
                a, b, d = words[lo], words[end - 1], depth + 1
                while d < len(a) and d < len(b) and a[d] == b[d]:
                    d += 1
                ranges.append((lo, end, d, a[depth:d]))
                lo = end
        child.append(len(ranges))
        at = array("I", [0])
        for *_, label in ranges:
            at.append(at[-1] + len(label))
        return Trie("".join(x[-1][:1] or " " for x in ranges), "".join(x[-1] for x in ranges), at, child, n)

    def pack(self) -> bytes:
        return dumps((self.first, self.labels, self.at.tobytes(), self.child.tobytes(), self.n.tobytes()))

    @staticmethod
    def unpack(raw: bytes) -> Trie:
        first, labels, at, child, n = loads(raw)
        return Trie(first, labels, array("I", at), array("I", child), array("q", n))

    def _count(self, node: int, k: int, word: str, i: int) -> int:
        """How often the word occurs whose rest, from k characters into the node's label, is word[i:]."""
        first, labels, at, child = self.first, self.labels, self.at, self.child
        while True:
            a, b = at[node] + k, at[node + 1]
            if a < b:
                if not word.startswith(labels[a:b], i):
                    return 0
                i += b - a
            if i == len(word):
                return self.n[node]
            node, k = first.find(word[i], child[node], child[node + 1]), 0
            if node < 0:
                return 0

    def near(self, word: str) -> dict[str, int]:
        """The words at one edit from ``word`` and how often they occur.

        The automaton's states without an edit are the places along the word itself;
        from each, all edits lead to states in which the rest must follow as it is.
        """
        first, labels, at, child, count = self.first, self.labels, self.at, self.child, self._count
        out: dict[str, int] = {}
        node = k = 0
        for i in range(len(word) + 1):
            inside = at[node] + k < at[node + 1]
            if inside:
                nexts = [(labels[at[node] + k], node, k + 1)]
            else:
                nexts = [(first[c], c, 1) for c in range(child[node], child[node + 1])]
            more = i < len(word)
            if more and (n := count(node, k, word, i + 1)):
                out[word[:i] + word[i + 1 :]] = n
            for c, at_node, at_k in nexts:
                if n := count(at_node, at_k, word, i):
                    out[word[:i] + c + word[i:]] = n
                if more and c != word[i] and (n := count(at_node, at_k, word, i + 1)):
                    out[word[:i] + c + word[i + 1 :]] = n
            if not more:
                break
            if inside:
                if labels[at[node] + k] != word[i]:
                    break
                k += 1
            else:
                node, k = first.find(word[i], child[node], child[node + 1]), 1
                if node < 0:
                    break
        return out


def trie_shards(words: DataFrame) -> DataFrame:
    """(word, n), no word twice -> a written row for each shard: its number, the size of its trie, and the trie."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("word", pa.string()), ("n", pa.int64())]))
        for start in range(0, table.num_rows, 2 * SHARD_WORDS):
            part = table.slice(start, 2 * SHARD_WORDS)
            packed = Trie.of(part.column(0).to_pylist(), part.column(1).to_pylist()).pack()
            yield pa.RecordBatch.from_arrays([pa.array([len(packed)], pa.int64()), pa.array([packed], pa.binary())], ["size", "trie"])

    dealt = words.select("word", "n").repartitionByRange(row_count(words) // SHARD_WORDS + 1, "word").sortWithinPartitions("word")
    return materialise(dealt.mapInArrow(build, "size long, trie binary").withColumn("shard", F.monotonically_increasing_id()), "tries")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n), a written table -> (word, n_near, best, best_n) of the words that have near ones.

    Near is one inserted, deleted or replaced code point. best: the near word that
    occurs most often, of equal ones the least in code-point order. Tries of
    ROUND_BYTES at most are broadcast at a time (one that is larger goes alone); all
    words are taken through all of them.
    """
    spark = words.sparkSession
    shards = trie_shards(words)
    looked_up = words.select("word").repartition(row_count(words) // TASK_WORDS + 1)
    rounds: list[list[int]] = [[]]
    held = 0
    for shard, size in sorted((r["shard"], r["size"]) for r in shards.select("shard", "size").collect()):  # one for each SHARD_WORDS words
        if rounds[-1] and held + size > ROUND_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    parts = []
    for ids in rounds:
        sent = spark.sparkContext.broadcast([bytes(r["trie"]) for r in shards.where(F.col("shard").isin(ids)).select("trie").collect()])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tries = [Trie.unpack(raw) for raw in sent.value]
            for b in batches:
                rows = []
                for word in b.column(0).to_pylist():
                    near: dict[str, int] = {}
                    for trie in tries:
                        near |= trie.near(word)
                    if near:
                        best = min(near, key=lambda w: (-near[w], w))
                        rows.append((word, len(near), best, near[best]))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "best", "best_n"])

        parts.append(materialise(looked_up.mapInArrow(search, "word string, n_near long, best string, best_n long"), "near"))
        sent.destroy()
    discard(shards)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    least = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("_least")).select("word", "n_near", F.col("_least.best").alias("best"), (-F.col("_least.n")).alias("best_n"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root), each word's form -> the last of its forms, by doubling; a written table.

    Forms are at least twice as frequent as what they are forms of, so chains are
    short and end. A form of very many words is a hot key: links that are counted
    and measured small are broadcast, others are merged.
    """
    while True:
        next_ = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        size = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word") + F.octet_length("root")).alias("b")).first()
        small = size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= LINK_BYTES
        step = links.join(F.broadcast(next_) if small else next_.hint("merge"), "root", "left")
        step = materialise(step.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "links")
        discard(links)
        if not step.where("_moved").limit(1).count():
            return step.drop("_moved")
        links = step.drop("_moved")
        links.written = step.written


def group_variants(words: DataFrame, factor: float = 2.0) -> DataFrame:
    """(word, n), no word twice -> word, n, n_near, form, form_n, root.

    n_near: how many words are one insertion, deletion or replacement of a code
    point away. form: of these the one of the largest n (ties: the least in
    code-point order), if it has at least ``factor`` times the word's n; else null.
    root: the last of the forms that follow from a word, itself if it has none.
    The result is lazy and reads written tables. An empty table gives an empty one.
    """
    words = materialise(words.select("word", "n"), "words")
    form = F.when(F.col("best_n") >= F.lit(factor) * F.col("n"), F.col("best"))
    found = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    found = materialise(found, "variants")
    roots = _roots(materialise(found.where("form is not null").select("word", F.col("form").alias("root")), "links"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def misspelled(key: object, run: str, every: int = 97) -> str:
    """A run less one code point where ``every`` divides the crc32 of ``key:run``, else the run; a null key is empty."""
    h = crc32(f"{'' if key is None else key}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_variants(count_words(docs, spelled=misspelled)).select("word", "form", "root", "n", "n_near", "form_n")
