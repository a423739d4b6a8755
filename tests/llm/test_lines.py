import random

from agentcorpus.llm import lines
from pyspark.sql import functions as F


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[-1] + 1))
        before = now
    return before[-1]


def brute(docs):
    """{doc_id: text}, comparing every line with every earlier one."""
    seen, out = [], {}
    for doc_id, text in docs:
        kept, alive = [], False
        for line in text.split("\n"):
            norm = " ".join(line.lower().split())
            if not norm:
                kept.append(line)
                continue
            near = any(
                norm == other
                or (min(len(norm), len(other)) >= lines.LEAST and abs(len(norm) - len(other)) < 2 and edits(norm, other) <= 1)
                for other in seen
            )
            seen.append(norm)
            if not near:
                kept.append(line)
                alive = True
        out[doc_id] = "\n".join(kept) if alive else ""
    return out


def changed(draw, line):
    at = draw.randrange(len(line) + 1)
    kind = draw.randrange(3)
    return line[:at] + ("" if kind == 0 else draw.choice("abcxyz")) + line[at + (kind != 1) :]


def test_against_brute_force(spark):
    draw = random.Random(5)
    stock = ["".join(draw.choice("abc ") for _ in range(draw.choice([3, 15, 16, 17, 40, 63, 64, 65, 90]))) for _ in range(25)]
    docs = []
    for doc_id in range(40):
        text = [draw.choice(stock) for _ in range(4)]
        text = [changed(draw, line) if draw.random() < 0.6 else line for line in text]
        text = [changed(draw, line) if draw.random() < 0.2 else line for line in text]
        docs.append((doc_id, "\n".join(text)))
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == brute(docs)


def test_long_lines_in_many_parts(spark):
    draw = random.Random(6)
    base = "".join(draw.choice("abcdefgh") for _ in range(3000))
    docs = [(0, base)]
    docs += [(k, changed(draw, base)) for k in range(1, 6)]
    docs += [(9, base[:1500] + "zz" + base[1500:])]
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == brute(docs)


def test_repeated_characters_and_links_to_the_earliest(spark):
    one = "a" * 30
    docs = [(3, one), (2, one + "a"), (1, one + "aa"), (4, "b" + one[1:]), (5, one[:-1] + "b")]
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == brute(sorted(docs))


def test_odd_rows(odd, empty):
    found = lines.dedup_lines(odd)
    assert found.columns == [*odd.columns, "lines_in", "lines_kept"]
    rows = found.collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    first = "The quick brown fox jumps over the lazy dog near the river bank today."
    assert {r["text"] for r in by_id[None]} == {first, None}  # null ids come first
    second = "Another text that has the same id as the one before it does have."
    assert sorted(r["text"] for r in by_id[1]) == ["", "", second]
    assert [r["text"] for r in by_id[2]] == [None]
    assert [r["text"] for r in by_id[3] + by_id[4]] == ["", ""]
    assert by_id[6][0]["lines_kept"] == 1 and by_id[7][0]["text"] == ""
    assert {r["rn"] for r in rows} == {"rn"}
    assert lines.dedup_lines(empty).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "one line\nanother")], "doc_id long, text string")
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_hot_line(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("the same heading on all pages\nown line "), "id").alias("text")
    )
    found = lines.dedup_lines(docs)
    kept = found.agg(F.sum("lines_kept").alias("n")).first()["n"]
    texts = [f"own line {k}" for k in range(3000)]
    own = brute([(0, "the same heading on all pages")] + [(k + 1, t) for k, t in enumerate(texts)])
    assert kept == sum(1 for t in own.values() if t)


def test_query(matches):
    matches("op1_line_dedup")


def test_normal_with_every_kind_of_white_space(spark):
    """Lines without a tab or the like pass the translation by; all kinds still become single blanks."""
    texts = ["A b", "a\tB", "a \t b", "\r a\fb\v", "\v", "", "É  x", "a" * 20 + "\n", " \t\n\r\f\v ", "a  b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", lines.normal(F.col("t")).alias("n")).collect():
        assert r["n"] == " ".join(r["t"].lower().split())
    passed = rows.select(lines.normal(F.col("t")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN (((" in passed.split("translate(")[0]
