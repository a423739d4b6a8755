import hashlib

from pyspark.sql import functions as F

from agentcorpus.llm import simhash
from agentcorpus.llm.queries import QUERIES


def bits(fingerprint):
    return int(fingerprint, 16)


def likeness(a, b):
    return 1 - bin(bits(a) ^ bits(b)).count("1") / 128


def test_query_on_whole_table(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in QUERIES["op6_simhash"](spark, sf).collect()}
    assert len(rows) == len(docs)
    by_text, better = {}, 0
    for at, (doc_id, text) in enumerate(docs):
        next_id, following = docs[(at + 1) % len(docs)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_next"] - likeness(r["fingerprint"], rows[next_id]["fingerprint"])) < 1e-12
        assert abs(r["near_edited"] - likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-12
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        better += r["near_edited"] > r["near_next"]
        if doc_id % 100 == 0:
            close = [o for o in rows.values() if likeness(r["fingerprint"], o["fingerprint"]) >= 1 - 3 / 128]
            assert r["near_docs"] == len(close) - 1
        else:
            assert r["near_docs"] is None
    assert better > 0.95 * len(docs)


def test_votes_against_plain_counting(spark):
    text = "the cat sat on the mat and the cat sat on the hat again " * 3
    words = text.split()
    runs = [words[i : i + 3] for i in range(len(words) - 2)]
    frame = spark.createDataFrame([tuple(r) for r in runs], "a string, b string, c string")
    hashed = frame.select(F.xxhash64("a", "b", "c").alias("h")).select("h", F.xxhash64("h").alias("g")).collect()
    mark = simhash.fingerprint(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    for name, half in (("h", mark["a"]), ("g", mark["b"])):
        for bit in range(64):
            votes = sum(1 if r[name] >> bit & 1 else -1 for r in hashed)
            assert (half >> bit & 1) == (votes > 0)


def test_all_pairs_within_the_radius(spark):
    base = [(1234567890123456789, -987654321), (5, -(1 << 63)), (-1, 0)]
    marks = []
    for a, b in base:
        for flips in ((), (0,), (63,), (64, 127), (3, 70, 100), (1, 2, 3, 4), (30, 64, 90, 127, 5)):
            x = (a & (2**64 - 1)) | (b & (2**64 - 1)) << 64
            for bit in flips:
                x ^= 1 << bit
            low, high = x & (2**64 - 1), x >> 64
            marks.append(tuple(v - (1 << 64) if v >> 63 else v for v in (low, high)))
    frame = spark.createDataFrame(marks, "a long, b long")
    found = {tuple(r) for r in simhash.within_radius(frame, frame).collect()}
    whole = [(a & (2**64 - 1)) | (b & (2**64 - 1)) << 64 for a, b in marks]
    want = {
        (*marks[i], *marks[j], bin(x ^ y).count("1"))
        for i, x in enumerate(whole)
        for j, y in enumerate(whole)
        if bin(x ^ y).count("1") <= simhash.RADIUS
    }
    assert found == want


def test_odd_rows(spark, odd, empty):
    found = simhash.fingerprint_edits(odd).collect()
    assert len(found) == odd.count()
    wordless = {(r["a"], r["b"]) for r in found if r["n_chars"] == 0}
    assert len(wordless) == 1
    twice = [r for r in found if r["doc_id"] == 1]
    assert len(twice) == 3
    copies = {(r["a"], r["b"]) for r in found if r["n_chars"] == 70 or r["doc_id"] is None and r["n_chars"]}
    assert len(copies) == 1
    assert simhash.count_near(simhash.fingerprint_edits(empty), F.lit(True)).collect() == []
    alone = simhash.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string"))
    assert alone.first()["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_no_python_in_the_plan(odd):
    plan = simhash.fingerprint_edits(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
