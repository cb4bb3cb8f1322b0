import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add to their results.
CLASHING = ["fp", "row", "shard", "slot", "size", "_site", "_b", "id", "kept", "n_copies", "copy", "rule", "n_words", "piece", "sequence_id", "_source", "_row", "spans", "component_id", "body", "runs", "start", "t", "doc", "score", "labels", "_cdf", "_u", "_bad", "_kept", "_key", "_body", "_name", "_doc", "_start", "_range", "_k", "_scores", "_order", "_n", "key", "part", "at", "tie", "place", "from", "hash", "crc", "site", "bad", "n", "kept_text", "first", "d"]


def make_texts(n=40, seed=1):
    """Texts with exact and near copies, shared passages, repeated lines and odd cases."""
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "té", "vo", "za") for b in ("n", "sel", "tor", "mu", "Vik")]
    line = lambda: " ".join(r.choices(vocab, k=r.randint(3, 14)))
    passage = " ".join(r.choices(vocab, k=60))
    out = ["\n".join(line() for _ in range(r.randint(1, 9))) for _ in range(n)]
    out += [out[0], out[0], out[3] + " end", f"{out[4]} {passage} {out[5]}", f"{passage}\n{out[6]}", passage, f"{passage} {passage}"]
    out += [None, None, "", "", "  \t\n ", "one", "two words", "a b c", "same " * 500, "ka " * 19, "ka " * 20, "ka " * 21, "x\x00y ♞♞  z w", "<|endoftext|> here"]
    out += ["\n".join(["menu home about", line(), "menu home about"]) for _ in range(12)]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls, repeats, ties and very long texts."""
    texts = make_texts()
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts += [" ".join(r.choices(words, k=30_000))]
    rows = [(i, t, "en", ["big", "big", "big", "small", None][i % 5], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, "some text of no one", None, "big", None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows and columns of strings whose names operators use themselves."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sorted_rows():
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
