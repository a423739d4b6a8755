from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentcorpus.llm import filteraudit
from agentcorpus.llm.store import looked_up

BLANKS = " \t\n\x0b\f\r"


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def fails_of(rows, at):
    doc_id, text = rows[at][0], rows[at][1] or ""
    words = words_of(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    copies = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
    return "".join(
        letter
        for letter, failed in {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * capitals > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and min(copies) < doc_id,
        }.items()
        if failed
    )


def brute(rows, labels):
    judged = []
    for at, row in enumerate(rows):
        marks = [m for m in labels if m[0] is not None and m[0] == row[0]]
        good, toxic = any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)
        judged.append((row[2] or "", fails_of(rows, at), good, toxic))
    out, shapley = {}, {}
    for part in {j[0] for j in judged}:
        for order in map("".join, permutations("ABCDE")):
            left = [j for j in judged if j[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [j for j in left if letter in j[1]]
                left = [j for j in left if letter not in j[1]]
                out[part, order, step] = (
                    len(left),
                    len(removed),
                    sum(letter in j[1] for j in gone),
                    sum(j[0] == part and j[1] == letter for j in judged),
                    sum(j[2] for j in removed),
                    sum(j[3] for j in removed),
                )
                gone += removed
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, quality int, toxic int, word int")


def run(docs, labels):
    found = filteraudit.interactions(docs, labels)
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley",
    ]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


LABELS = [(1, 1, None), (1, 0, 1), (2, 1, 1), (4, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1), (99, 1, 1)]


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    rows_of_many = (77, "again " * 70_000, None)  # a count of more than 16 bits
    odd = odd.unionByName(
        spark.createDataFrame([rows_of_many], "doc_id long, text string, lang string"), True
    )
    rows.append(rows_of_many)
    assert run(odd, labels_of(spark, LABELS)) == brute(rows, LABELS)


def test_separators_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "ENTRIES", 40)  # shards of a few documents
    hundred = " ".join(f"w{i}" for i in range(100))
    eighty = " ".join(f"w{i % 80}" for i in range(100))
    texts = [
        hundred, hundred[:-4], eighty, eighty.replace("w79", "w78"), hundred.replace(" ", "\x0b\t"),
        hundred.replace(" ", " "), hundred + "\x1c\x85 x", "Abcdefghij" * 3, "ABbcdefghij" * 3,
        "ÄÖÜ" * 40, "\U0001f600A" * 5, "a|b", None, "", " ", hundred, hundred, eighty,
    ]
    rows = [(i if i % 7 else None, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert run(docs, labels_of(spark, LABELS)) == brute(rows, LABELS)


def test_labels_are_not_broadcast(spark, odd):
    """Labels are repeated once per way, which Spark's estimates of their size leave out."""
    found = filteraudit.interactions(odd, labels_of(spark, LABELS))
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    found = looked_up(
        spark.range(100).withColumn("key", F.col("id") % 3),
        spark.createDataFrame([(0, "a"), (1, "b"), (7, "c"), (None, "d")], "key long, name string"),
        ["key"], F.xxhash64("id"),
    )
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    got = {(r["id"], r["key"], r["name"]) for r in found.collect()}
    assert got == {(i, i % 3, {0: "a", 1: "b"}.get(i % 3)) for i in range(100)}


def test_empty(spark, empty):
    assert run(empty, labels_of(spark, [])) == set()


def test_matrix_is_that_of_the_texts(odd):
    matrix, dictionary = filteraudit.document_terms(odd)
    words = {r["term"]: bytes(r["word"]) for r in dictionary.collect()}
    assert sorted(words) == list(range(len(words)))
    assert len(set(words.values())) == len(words)
    want = sorted(sorted(words_of(r["text"] or "")) for r in odd.collect())
    got = []
    for row in matrix.collect():
        ends, terms = np.frombuffer(row["ends"], np.int32), np.frombuffer(row["terms"], np.int64)
        counts = filteraudit.counted(row["counts"], len(terms))
        for a, b in zip(ends, ends[1:]):
            assert list(terms[a:b]) == sorted(set(terms[a:b]))
            got.append(sorted(w for t, n in zip(terms[a:b], counts[a:b]) for w in [words[t].decode()] * n))
    assert sorted(got) == want


@pytest.fixture(scope="module")
def labelled(duck, sf):
    duck.sql(f"create or replace view labels as select * from '{sf}/labels.parquet'")


def test_query(labelled, matches):
    matches("op11_filter_audit")
