import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentcorpus.llm import ordermin
from agentcorpus.llm.words import word_hashes


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[-1] + 1))
        before = now
    return before[-1]


def near(a, b):
    return edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def text(draw, words):
    return [draw.choice("abcdefghij") + str(draw.randrange(300)) for _ in range(words)]


def altered(draw, words, count):
    words = list(words)
    for _ in range(count):
        if not words:
            break
        at, kind = draw.randrange(len(words)), draw.randrange(3)
        if kind == 0:
            words[at] = "new" + str(draw.randrange(10**6))
        elif kind == 1:
            words.insert(at, "more" + str(draw.randrange(10**6)))
        else:
            del words[at]
    return words


def test_banded_alignment():
    draw = random.Random(2)
    pairs, want = [], []
    for _ in range(300):
        a = [draw.randrange(25) for _ in range(draw.randrange(80))]
        b = altered(draw, a, draw.randrange(20)) if a else [1]
        b = [hash(x) % 1000 for x in b]
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
        want.append(near(a, b))
    assert ordermin.similar(pairs).tolist() == want


def test_words_are_those_of_split():
    texts = ["a bb  ccc\n\tdd", "", "   ", "x", "é ü"]
    hashes, counts = word_hashes([t.encode() for t in texts])
    assert counts.tolist() == [len(t.split()) for t in texts]
    words = [w for t in texts for w in t.split()]
    by_hash = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_hash.setdefault(h, w) == w


def test_order_matters_and_occurrences_count():
    def keys(words):
        hashes, counts = word_hashes([" ".join(words).encode()])
        return ordermin.sketch(*ordermin.labelled_runs(hashes, counts))[0]

    draw = random.Random(3)
    words = text(draw, 400)
    same = (keys(words) == keys(words[200:] + words[:200])).mean()
    assert same < 0.8 and (keys(words) == keys(list(words))).all()
    assert (keys(words + words) != keys(words)).any()


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(4)
    shared = text(draw, 60)  # a passage in very many documents
    docs, group = [], {}
    for k in range(30):  # groups of near copies, some in chains
        base = text(draw, draw.choice([30, 120, 700]))
        for copy in range(draw.choice([1, 2, 5])):
            words = altered(draw, base, copy * len(base) // 60)
            docs.append(words)
            group[len(docs) - 1] = k
    for _ in range(300):
        body = text(draw, 120)
        at = draw.randrange(120)
        docs.append(body[:at] + shared + body[at:])
    rows = [(k, " ".join(words)) for k, words in enumerate(docs)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # a large group of exact copies
    return docs, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


def test_planted_copies(planted):
    docs, rows, frame = planted
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            if abs(len(docs[i]) - len(docs[j])) <= 0.2 * max(len(docs[i]), len(docs[j])):
                if len(set(docs[i]) & set(docs[j])) > 20 and i < 200 and near(docs[i], docs[j]):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    found = ordermin.near_duplicates(frame).collect()
    want = {k: root(k) for k in range(len(docs))} | {1000 + k: root(0) for k in range(200)}
    assert {r["doc_id"]: r["class_id"] for r in found} == want
    assert sorted(r["doc_id"] for r in found if r["stays"]) == sorted(set(want.values()))


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(205, 200), (205, 203)]
    found = ordermin.components(spark.createDataFrame(edges, "id long, to long")).collect()
    assert {r["id"]: r["class"] for r in found} == (
        {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 203: 200, 205: 200}
    )


def test_odd_rows(odd, empty):
    found = ordermin.near_duplicates(odd)
    assert found.columns == [*odd.columns, "class_id", "class_key", "stays"]
    rows = found.collect()
    assert len(rows) == odd.count()
    kept = [r["class_key"] for r in rows if r["stays"]]
    assert None not in kept and len(kept) == len(set(kept)) == len({r["class_key"] for r in rows})
    for r in rows:
        if r["text"] is None:
            assert r["stays"] and r["class_id"] == r["doc_id"]
        elif r["text"].startswith("The quick"):
            assert r["class_id"] is None and r["stays"] == (r["doc_id"] is None)
        elif r["doc_id"] == 7:
            assert r["class_id"] == 6 and not r["stays"]
        else:
            assert r["stays"] and r["class_id"] == r["doc_id"]
    assert ordermin.near_duplicates(empty).collect() == []


def test_rows_that_repeat_are_one_class(spark):
    """Null ids and repeated rows: exactly one row of a class stays."""
    draw = random.Random(12)
    one, two = " ".join(text(draw, 40)), " ".join(text(draw, 40))
    rows = [(None, one)] * 300 + [(None, two)] * 3 + [(4, one), (4, one), (5, two), (5, "a b")] + [(6, "c d")] * 4
    found = ordermin.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ).collect()
    assert len(found) == len(rows)
    by_text = {t: {r["class_key"] for r in found if r["text"] == t} for _, t in rows}
    assert sorted(map(len, by_text.values())) == [1, 1, 1, 1]
    assert sorted(r["text"] for r in found if r["stays"]) == sorted(by_text)
    assert all(r["doc_id"] is None for r in found if r["stays"] and r["text"] in (one, two))


@pytest.mark.parametrize("words", [40, 200, 1000])
@pytest.mark.parametrize("share,least", [(0.2, 0.9), (0.15, 0.97), (0.1, 0.995)])
def test_recall_over_edit_similarity(words, share, least):
    """Of pairs whose similarity is 1 - share, replaced words scattered, how many share a bucket."""
    draw, found, trials = random.Random(13), 0, 300
    for _ in range(trials):
        a = text(draw, words)
        b = list(a)
        for at in draw.sample(range(words), int(share * words)):
            b[at] = f"new{draw.randrange(10**9)}"
        _, keys, _ = ordermin.keys_of([" ".join(a).encode(), " ".join(b).encode()])
        found += bool((keys[0] == keys[1]).any())
    assert found / trials >= least


def test_query_keeps_one_of_each_class(spark, sf):
    from agentcorpus.llm.queries import QUERIES

    found = QUERIES["op2_order_minhash"](spark, sf)
    sizes = found.groupBy("class_id").agg(F.sum(F.col("stays").cast("int")).alias("kept"))
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sizes.where("kept <> 1").isEmpty()


def sharing(draw, shared, other=None, step=0):
    """A passage of 150 words and 50 others, 13 of which, never two in a row, may be another's."""
    own = [f"own{draw.randrange(10**9)}" for _ in range(50)]
    if other:
        own[step + 1 : step + 40 : 3] = other[150:][step + 1 : step + 40 : 3]
    return shared + own


def test_near_pair_amid_a_passage_that_thousands_share(spark):
    draw = random.Random(8)
    shared = text(draw, 150)
    docs = [sharing(draw, shared) for _ in range(3000)]
    docs[1700] = sharing(draw, shared, docs[1200])
    assert near(docs[1200], docs[1700]) and not near(docs[1200], docs[1201])
    rows = [(k, " ".join(words)) for k, words in enumerate(docs)]
    found = ordermin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in found.where("not stays").collect()] == [1700]


def test_chain_whose_inner_members_link_the_ends(spark):
    draw = random.Random(9)
    shared = text(draw, 150)
    low = sharing(draw, shared)
    inner = sharing(draw, shared, low, 0)
    second = sharing(draw, shared, inner, 1)
    high = sharing(draw, shared, second, 2)
    assert near(low, inner) and near(inner, second) and near(second, high)
    assert not (near(low, second) or near(low, high) or near(inner, high))
    lows = [sharing(draw, shared, inner, 0) for _ in range(20)]
    highs = [sharing(draw, shared, second, 2) for _ in range(20)]
    rows = [(k, " ".join(words)) for k, words in enumerate([*lows, inner, second, *highs])]
    found = ordermin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["class_id"] for r in found.collect()} == {0}
