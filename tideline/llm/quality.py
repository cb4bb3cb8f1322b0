"""Quality rules: text statistics, base limits, and a decision list learned from labels.

The list is learned by sequential covering: a rule is a conjunction of threshold
tests that is grown on one part of the labelled rows until it covers few good
documents and pruned on the other part; the rows it covers are then removed and
the next rule is sought. Rules come out in order and are applied as one Spark
conditional expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import small_batches, utf8

#: Labelled rows used for learning, at most; rows of smallest hash are taken, so
#: the sample does not depend on partitioning.
MAX_LABELLED = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_letters long, n_upper long, n_punct long, n_distinct_words long, n_lines long"
_NAMES = [x.split()[0] for x in STATS.split(", ")]

#: What rules may test: ratios, so that a rule means the same for short and long texts.
FEATURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeat_words_per_word": ("n_repeat_words", "n_words"),
    "upper_per_letter": ("n_upper", "n_letters"),
    "punct_per_char": ("n_punct", "word_chars"),
    "distinct_words_per_word": ("n_distinct_words", "n_words"),
}


_ASCII_UPPER = bytes(range(65, 91))
_ASCII_LOWER = bytes(range(97, 123))
_ASCII_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def text_stats(body: bytes | None) -> tuple[int, ...]:
    """The statistics of one whole text, as UTF-8 bytes; null counts as empty."""
    body = body or b""
    words = body.split()
    n = len(words)
    joined = b"".join(words)
    extra = 0 if joined.isascii() else len(joined) - len(joined.decode("utf-8", "replace"))
    chars = len(joined) - extra
    # ASCII letters are counted on bytes; other letters only where there are any
    upper = len(joined) - len(joined.translate(None, _ASCII_UPPER))
    letters = upper + len(joined) - len(joined.translate(None, _ASCII_LOWER))
    if extra:
        other = joined.translate(None, bytes(range(128))).decode("utf-8", "replace")
        letters += sum(map(str.isalpha, other))
        upper += sum(map(str.isupper, other))
    lines = [x for x in body.split(b"\n") if x.split()]
    repeated = 0
    if n > 2:
        grams = list(zip(words, words[1:], words[2:]))
        if len(seen := Counter(grams)) < len(grams):
            hit = np.zeros(n, bool)
            at = np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))
            hit[:-2] |= at
            hit[1:-1] |= at
            hit[2:] |= at
            repeated = int(hit.sum())
    return (
        n,
        chars,
        len(body) - len(body.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        letters,
        upper,
        len(joined) - len(joined.translate(None, _ASCII_PUNCT)),
        len(set(words)),
        len(lines),
    )


def with_stats(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row and the statistics of its whole text."""
    kept = small_batches(df).select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), STATS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(b) for b in batch.column(batch.num_columns - 1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(c, pa.int64()) for c in cols], [*kept.names, *_NAMES])

    return df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), utf8(text).alias("body")).mapInArrow(count, schema)


def features() -> dict[str, Column]:
    return {k: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for k, (a, b) in FEATURES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self, cols: dict[str, Column]) -> Column:
        c = cols[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all tests. bad and good: labelled rows it covered when learned."""

    tests: tuple[Test, ...]
    bad: int
    good: int

    def __str__(self) -> str:
        tests = " and ".join(f"{t.feature} {'>' if t.above else '<='} {t.threshold:.6g}" for t in self.tests)
        return f"reject if {tests}  [{self.bad} bad, {self.good} good]"


def _cover(tests: Sequence[Test], x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in tests:
        hit &= t.holds(x, names)
    return hit


def _best_test(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> tuple[float, Test | None]:
    """The test with the largest information gain for the rows given (all covered so far)."""
    p0, n0 = bad.sum(), len(bad) - bad.sum()
    start = np.log2(p0 / (p0 + n0)) if p0 else 0.0
    best: tuple[float, Test | None] = (1e-9, None)
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, y = x[order, k], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # a threshold lies between cut and cut + 1
        if not len(cut):
            continue
        below = np.cumsum(y)[cut]
        for above in (False, True):
            p = (p0 - below) if above else below
            total = (len(y) - cut - 1) if above else cut + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / total) - start), -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), Test(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def learn_rules(x: np.ndarray, bad: np.ndarray, names: Sequence[str], max_rules: int = 12, max_tests: int = 4, min_bad: int = 4, max_good_share: float = 0.02, seed: int = 7) -> list[Rule]:
    """Sequential covering. x: rows by features; bad: what the rules are to find.

    Two thirds of the rows grow a rule, one third prunes it: the last tests are
    dropped as long as (bad - good) / (bad + good) on that third does not fall.
    A rule is kept if at most ``max_good_share`` of what it covers is good on
    either part, and it covers ``min_bad`` bad rows; learning ends at the first
    rule that is not kept. No bad rows or no rows give no rules.
    """
    rng = np.random.default_rng(seed)
    grow = rng.random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        g = left & grow
        if not (bad & g).any():
            break
        tests: list[Test] = []
        rows = np.flatnonzero(g)
        while len(tests) < max_tests and not bad[rows].all():
            _, test = _best_test(x[rows], bad[rows], names)
            if test is None:
                break
            tests.append(test)
            rows = rows[test.holds(x[rows], names)]

        def worth(t: Sequence[Test]) -> float:
            hit = _cover(t, x, names) & left & ~grow
            p = (bad & hit).sum()
            return (2 * p - hit.sum()) / hit.sum() if hit.sum() else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        hit = _cover(tests, x, names) & left
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        if not tests or p < min_bad or n > max_good_share * (p + n):
            break
        rules.append(Rule(tuple(tests), p, n))
        left &= ~hit
    return rules


def rejected_by(rules: Sequence[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    cols, out = features(), None
    for i, rule in enumerate(rules, 1):
        test = None
        for t in rule.tests:
            test = t.column(cols) if test is None else test & t.column(cols)
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return (F.lit(None) if out is None else out).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features and labels of at most ``max_labelled`` documents, brought to the driver: 8 doubles each.

    The labels of smallest hash are taken, so the sample is the same however the
    tables are partitioned; being bounded, their keys are broadcast, and only those
    documents' statistics are made. Null keys and null labels are left out, and so
    are documents that fail the base limits, which no rule has to judge.
    """
    names, cols = list(FEATURES), features()
    chosen = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).select(F.col(key).alias("_key"), (F.col("quality") == 0).alias("_bad")).distinct()
    chosen = chosen.withColumn("_h", F.xxhash64("_key")).orderBy("_h", "_key", "_bad").limit(max_labelled)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = with_stats(texts, ["_h", "_key", "_bad"], "_text").where(~base_failed())
    rows = rows.orderBy("_h", "_key", "_bad", *_NAMES).limit(max_labelled).select(*[cols[n].alias(n) for n in names], "_bad").toPandas()
    return rows[names].to_numpy(float), rows["_bad"].to_numpy(bool), names


def judge(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the rule that rejects, null: none) and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[Rule]]:
    """The key, statistics and verdict of every row of ``docs``, and the rules that were learned.

    A null or empty text has no words and fails the base limits; a null key is
    judged like any other but takes no part in learning; repeated rows each get
    the same verdict; without labels only the base limits hold; an empty table
    gives an empty result. Other columns are not read.
    """
    rules = learn_rules(*labelled_sample(docs, labels, key, text, max_labelled))
    return judge(with_stats(docs, [key], text), rules), rules


def filter_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with all their columns as they are."""
    rules = learn_rules(*labelled_sample(docs, labels, key, text, max_labelled))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return judge(with_stats(rows, ["_row"], f"_row.`{text}`"), rules).where("kept").select("_row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, _ = quality_rules(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
