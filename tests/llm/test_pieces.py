import public_tokenizers
import pytest
import sentencepiece

from agentcorpus.llm import pieces
from agentcorpus.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "  a  b ﬁ\tx\n é ", "aaaa aaaaa xxxxxx", "\U0001f600 日本語 ☃ \x00", "a" * 700, "!!!! ???? ....",
    "int main() {\n    return 0;\n}", "1234567890 12 3", "x▁y", "ııİ ßẞ", "ab" * 300 + " " + "ba" * 300,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(spark, sf, library):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    parts = pieces.Encoder(pieces.Vocabulary(PATH)).encode(texts)
    assert [one.tolist() for part in parts for one in part] == library.encode(texts)


def test_transitions_equal_merging(library):
    """The arcs against merging itself, over short strings of a small alphabet."""
    made = pieces.Vocabulary(PATH)
    words = ["▁" + a + b + c + d for a in "aehn" for b in "enrst" for c in "aeint" for d in "ens"]
    assert made.encode_equal(words) == [
        b"".join(i.to_bytes(4, "little") for i in library.encode(w[1:])) for w in words
    ]


def test_words_of_many_lengths_advance_together(library):
    """Words with their padding, and answers that are asked again: only equal lengths were taken."""
    made = pieces.Vocabulary(PATH)
    words = ["▁" + w for w in ["the", "a", "internationalisation", "☃x", "xx", "the", "aaaaaaa", "日本", "don't"]]
    for _ in range(2):
        assert made.encode_equal(words) == [
            b"".join(i.to_bytes(4, "little") for i in library.encode(w[1:])) for w in words
        ]
    assert (made.asked >= 0).any()


def test_round_trip_on_whole_table(spark, sf):
    rows = QUERIES["op3_sentencepiece"](spark, sf).collect()
    assert rows and all(r["round_trip"] for r in rows)


def test_odd_rows(spark, odd, empty):
    found = pieces.decode(pieces.encode(odd, PATH), PATH)
    assert found.columns == [*odd.columns, "ids", "decoded"]
    same = pieces.encode(odd, PATH, decoded="decoded").select("doc_id", "text", "ids", "decoded")
    assert sorted(map(repr, same.collect())) == sorted(
        map(repr, found.select("doc_id", "text", "ids", "decoded").collect())
    )
    for r in found.collect():
        assert r["decoded"] == r["text"]
        assert (r["ids"] is None) == (r["text"] is None)
    assert pieces.encode(empty, PATH).collect() == []
    broken = spark.createDataFrame([([259 + 3, 3 + 0xC3],)], "ids array<int>")
    assert pieces.decode(broken, PATH).first()["decoded"].endswith("�")
