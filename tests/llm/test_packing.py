"""Packing: pieces against the tokenizer, sequences by their rules, little waste."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def pieces(ids, size=2048):
    ids = [*ids, 0]
    first = len(ids) % size or size
    cuts = [0, *range(first, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
    return [(i, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check(rows, size=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_fast_encoder_is_exact(tokenizer):
    encode = packing.public_encoder()
    r = random.Random(0)
    alphabet = [*map(chr, range(32, 0x250)), "\n", "\t", "\r", "  ", "’", "“", "€", "♞", "字", "й", " ", " ", "don't", " I'LL ", "123456"]
    for _ in range(400):
        text = "".join(r.choices(alphabet, k=r.randint(0, 60)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    for text in ("<|endoftext|>", "x <|endoftext|> y", "end<|endoftext|><|endoftext|>\n", "<|endoftext", "字 <|endoftext|>"):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert encode("x <|endoftext|> y").count(50256) == 1


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 4097, 10_000])
def test_cut(n):
    ids = list(range(1, n))
    assert packing.cut(ids) == pieces(ids)


def test_odd_rows(odd, odd_rows, clashing, none, tokenizer):
    for df in (odd, clashing):
        rows = packing.pack_documents(df).collect()
        want = sorted((r[0], *p) for r in odd_rows if r[0] is not None for p in pieces(tokenizer.encode(r[1] or "", add_special_tokens=False).ids))
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None) == want
        assert sum(r.doc_id is None for r in rows) == 2
        check(rows)
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("items_per_task", [50, 100_000])
def test_rounds(spark, items_per_task):
    r = random.Random(1)
    rows = [(i, min(64, int(r.expovariate(1 / 12)) + 1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "row long, length long").repartition(9)
    placed = packing.pack(df, size=64, items_per_task=items_per_task).join(df, "row").collect()
    assert sorted(r.row for r in placed) == [i for i, _ in rows]
    least = -(-sum(n for _, n in rows) // 64)
    assert check(placed, 64) <= 1.02 * least + 2


def test_lengths_are_checked(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0)], "row long, length long"), size=4)


def test_best_fit():
    assert packing.best_fit(np.array([6, 5, 4, 3, 2]), 10).tolist() == [0, 1, 0, 1, 1]
    assert packing.best_fit(np.array([], int), 10).tolist() == []


def test_query(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = packing.op7_best_fit_packing(spark, sf_dir).collect()
    want = sorted((r.doc_id, *p) for r in docs for p in pieces(tokenizer.encode(r.text or "", add_special_tokens=False).ids))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check(rows) <= 1.02 * sum(r.length for r in rows) / 2048 + 2
