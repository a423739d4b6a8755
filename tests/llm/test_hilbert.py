import zlib
from itertools import product

from pyspark.sql import functions as F

from agentcorpus.llm import hilbert
from agentcorpus.llm.queries import QUERIES


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = list(product(range(1 << bits), repeat=dims))
        names = [f"c{k}" for k in range(dims)]
        frame = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
        index = hilbert.hilbert_index([F.col(n) for n in names], bits)
        rows = sorted(frame.select(index.alias("i"), *names).collect())
        assert [r["i"] for r in rows] == list(range(1 << bits * dims))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1


def lawful(rows, shards=24):
    sizes = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for shard in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in rows} <= {"rows"} and all(r["grown_shard"] is None for r in rows)


def test_query_on_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_hilbert_shards"](spark, sf).collect()
    lawful(rows)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = {}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        shards.setdefault(docs[r["doc_id"]], set()).add(r["shard"])
    assert max(map(len, shards.values())) <= 2  # copies lie together but for a cut


def test_filters_skip_files(spark):
    """Least and greatest values of the shards: a filter on any dimension reads a small share of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = hilbert.assign_shards(docs, 64).select("doc_id", "shard", "size")
    found = docs.join(placed, "doc_id").select("shard", "lang", "source", "size").collect()
    shares = {}
    for name, at in (("lang", 1), ("source", 2), ("size", 3)):
        spans = {}
        for row in found:
            low, high = spans.get(row[0], (row[at], row[at]))
            spans[row[0]] = min(low, row[at]), max(high, row[at])
        values = sorted(row[at] for row in found)  # as often as they occur
        read = [sum(low <= v <= high for low, high in spans.values()) / len(spans) for v in values]
        shares[name] = sum(read) / len(read)
    assert max(shares.values()) < 0.5, shares


def test_cells_follow_the_values(spark):
    rows = [(f"v{k:04}",) for k in range(1000)] + [("v0500",)] * 900 + [("",)]
    df = spark.createDataFrame(rows, "v string")
    cells = {r["v"]: r["c"] for r in df.select("v", hilbert.rank_cell(df, "v").alias("c")).collect()}
    in_order = [cells[v] for v in sorted(cells)]
    assert in_order == sorted(in_order) and set(in_order) == set(range(32))
    few = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "v string")
    got = few.select("v", hilbert.rank_cell(few, "v").alias("c")).distinct().collect()
    assert len({r["c"] for r in got}) == 3
    assert few.limit(0).select(hilbert.rank_cell(few.limit(0), "v")).collect() == []


def test_odd_rows(spark, odd, empty):
    rows = hilbert.assign_shards(odd, 5).collect()
    lawful(rows, 5)
    assert [r["size"] for r in rows if r["doc_id"] in (2, 3)] == [8, 8]
    assert hilbert.assign_shards(empty).collect() == []


def test_hot_group(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
        F.lit("en").alias("lang"),
        F.lit("a").alias("source"),
    )
    lawful(hilbert.assign_shards(docs).collect())


def test_written_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = f"file://{tmp_path}/shards"
    hilbert.write_shards(docs, hilbert.assign_shards(docs, 6), path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count()
    assert {r["count"] for r in back.groupBy("shard").count().collect()} <= {33, 34}
