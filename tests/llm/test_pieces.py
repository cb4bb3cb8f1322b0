"""Ids and texts against the sentencepiece library."""

import random
from hashlib import sha256

import pytest

from tideline.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def ours():
    return pieces.Pieces(pieces.read_model(MODEL))


def test_model(library):
    model = pieces.read_model(MODEL)
    assert [p for p, _, _ in model.pieces] == [library.id_to_piece(i) for i in range(len(library))]
    assert [s for _, s, _ in model.pieces] == [library.get_score(i) for i in range(len(library))]
    assert (model.byte_fallback, model.dummy_prefix, model.squeeze) == (True, True, False)


PARTS = ["a", "b", "the", " ", "  ", "▁", "\n", "\r", "\t", "é", "ß", "日", "本", "👩", "​", "\0", "<s>", "<0x0A>", "1", "23", ".", "();", "́", "ﬁ", "İ", "�", "х", "о", "\U0010ffff", "Z", "://", "can't", "e.g.", ");\r"]


def test_fuzz(library, ours):
    r = random.Random(3)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 30))) for _ in range(4000)]
    ids = [ours.encode(t) for t in texts]
    assert ids == library.encode(texts)
    assert [ours.decode(i) for i in ids] == library.decode(ids)


def test_any_ids(library, ours):
    """Bytes that are no UTF-8, control ids and the word mark in any place."""
    r = random.Random(4)
    pick = lambda: r.choice([r.randrange(32000), r.randrange(259), 1, 2, 13, 259, 28705])
    ids = [[pick() for _ in range(r.randint(0, 12))] for _ in range(4000)]
    assert [ours.decode(i) for i in ids] == library.decode(ids)


def test_long_texts(library, ours):
    for text in ("a" * 60_000, "ab1 " * 20_000, "x" * 5 + " " * 50_000 + "y", "日" * 20_000, "the " * 50_000, "aAbB/" * 10_000):
        assert ours.encode(text) == library.encode(text)


def test_agenda_of_few_and_many():
    """The same pairs whether the agenda is a list or a heap; of equal ranks the leftmost."""
    ranks = {"aa": 0, "ab": 0, "ba": 1, "aab": 1, "bb": 2, "abab": 2}
    r = random.Random(5)

    def plain(symbols):
        parts = list(symbols)
        while (best := min(((ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in ranks), default=None)) is not None:
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    for _ in range(300):
        text = "".join(r.choices("abc", k=r.randint(1, 60)))
        assert pieces.merge(text, ranks) == plain(text)
    assert pieces.merge("ab" * 500, ranks) == plain("ab" * 500)


def test_refused(tmp_path):
    other = tmp_path / "other.model"
    other.write_bytes(b"\x12\x02\x18\x01")  # a model of single pieces, not of merges
    with pytest.raises(ValueError, match="merges"):
        pieces.read_model(str(other))


def test_memo_is_bounded(ours):
    small = pieces.Pieces(pieces.read_model(MODEL), memo=3)
    text = "one two three four five six seven one two " + "x" * 200
    assert small.encode(text) == ours.encode(text)
    assert len(small.stretch.__self__) <= 3


def test_rows(spark, odd, clashing, none, library, sorted_rows):
    rows = pieces.encode(odd, MODEL, decoded="read", check="both")
    got = rows.collect()
    assert all(r["agrees"] for r in got)
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert sorted(((r["doc_id"], r["ids"], r["read"]) for r in got), key=repr) == sorted(((k, ids, library.decode(ids)) for k, t in texts for ids in [library.encode(t)]), key=repr)
    assert sorted_rows(pieces.decode(rows.drop("read", "agrees"), MODEL)) == sorted_rows(rows.select("doc_id", "ids", "read"))
    assert sorted_rows(pieces.encode(clashing, MODEL)) == sorted_rows(pieces.encode(odd, MODEL))
    assert all(r["agrees"] for r in pieces.encode(odd, MODEL, check="ids").collect())
    assert pieces.agreeing(library, ["a b", "a b"], [library.encode("a b"), [5]], None) == [True, False]
    assert pieces.agreeing(library, ["a b"], [library.encode("a b")], ["a c"]) == [False]
    assert pieces.decode(pieces.encode(none, MODEL), MODEL).collect() == []
    some = spark.createDataFrame([([15043, 2787],), (None,), ([],)], "ids array<int>")
    assert sorted_rows(pieces.decode(some, MODEL), "text") == sorted([(library.decode([15043, 2787]),), (None,), ("",)], key=repr)


def test_query(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in pieces.op11_sentencepiece(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        expected = (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == expected
