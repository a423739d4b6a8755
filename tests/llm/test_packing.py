import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from agentcorpus.llm import packing
from agentcorpus.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def placed_well(rows, width=packing.WIDTH):
    """Sequences are gapless from 0 and no longer than the width."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return len(by_sequence)


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    return made


def test_both_encoders_agree(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["a  b", " x ", "\n\n d", "it's 'tis ' s", "<|endoftext|> x", "日本 語 \U0001f600", "\x1c a\x85b", "a" * 3000]
    ranks, plain = packing.Encoder.at(RANKS), packing.Encoder.at(JSON)
    assert [ranks.encode(t) for t in texts] == [plain.encode(t) for t in texts]


def test_query_on_whole_table(spark, sf, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    total = 0
    for doc_id, text in docs.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        pieces = sorted(found[doc_id], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // 2048)
        start = 0
        for p in pieces:
            assert p["start"] == start
            part = ids[start : start + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            start += p["length"]
        assert start == len(ids) and all(p["length"] == 2048 for p in pieces[1:])
    assert placed_well(rows) <= -(-total // 2048) * 1.01 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    lengths = np.minimum(draw.lognormal(4 + seed, 1, 5000).astype(int) + 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    chosen = packing.plan(counts)
    used = np.zeros(2049, int)
    for content, times in chosen:
        assert sum(v * n for v, n in content.items()) <= 2048
        for v, n in content.items():
            used[v] += n * times
    assert (used == counts).all()
    sequences = sum(times for _, times in chosen)
    assert sequences <= sum(times for _, times in packing.best_fit(counts)) * 1.005 + 1


def test_best_fit_equals_the_piecewise_one():
    draw = np.random.default_rng(9)
    lengths = sorted(draw.integers(1, 65, 400).tolist(), reverse=True)
    rooms = []
    for length in lengths:
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(64 - length)
    counts = np.bincount(lengths, minlength=65)
    assert sum(times for _, times in packing.best_fit(counts, 64)) == len(rooms)


def test_odd_rows_and_small_width(odd, empty):
    pieces = packing.token_pieces(odd, RANKS, width=64, ids=True)
    rows = packing.pack(pieces, 64).collect()
    assert placed_well(rows, 64)
    lone = [r for r in rows if r["doc_id"] in (2, 3)]
    assert [(r["piece"], r["length"], bytes(r["ids"])) for r in lone] == [(0, 1, b"\0\0\0\0")] * 2
    assert len([r for r in rows if r["doc_id"] == 1 and r["start"] == 0]) == 3
    full = packing.sequences(packing.pack(pieces, 64)).collect()
    assert sum(len(r["ids"]) for r in full) == 4 * sum(r["length"] for r in rows)
    assert packing.pack_documents(empty, RANKS).collect() == []


def test_hot_length(spark):
    frame = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 1500L, 1 + id % 700) as length")
    rows = packing.pack(frame).collect()
    assert len(rows) == 5000
    placed_well(rows)


def test_added_token_is_one_id():
    plain = Tokenizer.from_file(JSON)
    for text in ["a b<|endoftext|> c", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "<|ENDOFTEXT|>"]:
        want = plain.encode(text, add_special_tokens=False).ids
        for path in (RANKS, JSON):
            assert np.frombuffer(packing.Encoder.at(path).encode(text), "<u4").tolist() == want
    assert 50256 in plain.encode("a b<|endoftext|> c", add_special_tokens=False).ids
