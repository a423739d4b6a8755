import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agentcorpus.sources import arrow_shards, checksums, paths, progress

SCHEMA = "id bigint, name string"


def stream(rows, batch=3, opened=pa.ipc.new_stream, dictionary=False):
    kind = pa.dictionary(pa.int8(), pa.string()) if dictionary else pa.string()
    sink = pa.BufferOutputStream()
    with opened(sink, pa.schema([("id", pa.int64()), ("name", kind), ("more", pa.string())])) as writer:
        for start in range(0, len(rows), batch):
            part = rows[start : start + batch]
            names = pa.array([f"n{i}" for i in part])
            writer.write_batch(
                pa.record_batch(
                    {
                        "id": pa.array(part, pa.int64()),
                        "name": names.dictionary_encode().cast(kind) if dictionary else names,
                        "more": pa.array(["x" * 500] * len(part)),
                    }
                )
            )
    return sink.getvalue().to_pybytes()


@pytest.fixture
def scan(spark, tmp_path):
    def run(contents, split=4000):
        listed = []
        for name, data in contents.items():
            (tmp_path / name).write_bytes(data)
            listed.append((str(tmp_path / name), 1))
        files = spark.createDataFrame(listed, "path string, more int")
        plan = arrow_shards.plan_arrow(files, split)
        found = arrow_shards.scan_arrow(spark, files, ["id", "name"], SCHEMA, 2, True, plan)
        rows = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "*").collect()
        good = {}
        for r in rows:
            if r["reason"] is None:
                assert r["name"] == f"n{r['id']}"
                good.setdefault(r["file"], []).append((r["row_index"], r["id"]))
        bad = sorted((r["file"], r["row_index"], r["reason"]) for r in rows if r["reason"])
        assert all([at for at, _ in sorted(v)] == list(range(len(v))) for v in good.values())
        plain = arrow_shards.scan_arrow(spark, files, ["id", "name"], SCHEMA)
        assert plain.columns == ["id", "name"] and plain.count() == sum(map(len, good.values()))
        return {k: [i for _, i in sorted(v)] for k, v in good.items()}, bad, plan

    return run


def test_shards_are_split_by_batches(scan):
    rows = list(range(100))
    contents = {
        "stream": stream(rows), "file": stream(rows, opened=pa.ipc.new_file), "one": stream([7]),
        "many values": stream(rows, dictionary=True), "none": stream([]),
    }
    good, bad, plan = scan(contents)
    assert bad == []
    assert good == {"stream": rows, "file": rows, "many values": rows, "one": [7]}
    splits = plan.groupBy("path").count().collect()
    assert max(r["count"] for r in splits) > 5
    assert plan.where("row_count > 12").count() == 0


def test_broken_shards_are_rejected(scan):
    rows = list(range(20))
    whole, as_file = stream(rows), stream(rows, opened=pa.ipc.new_file)
    ends = [at for at in range(len(whole)) if whole[at : at + 4] == b"\xff\xff\xff\xff"]
    other = pa.BufferOutputStream()
    with pa.ipc.new_stream(other, pa.schema([("id", pa.string())])) as writer:
        writer.write_batch(pa.record_batch({"id": ["a", "b"]}))
    broken = bytearray(whole)
    at = whole.index(b"n9n10n11")
    broken[at - 24 : at - 8] = b"\xff" * 16  # offsets of the names of the fourth batch
    contents = {
        "cut": whole[: ends[3] + 50], "file": as_file[:-3], "empty": b"", "text": b"not an arrow shard",
        "short": whole[:6], "other": other.getvalue().to_pybytes(), "good": whole, "body": bytes(broken),
    }
    good, bad, _ = scan(contents, 1 << 20)
    assert good["good"] == rows and good["cut"] == rows[:6] and good["file"] == rows
    assert [b for b in bad if b[0] != "body"] == [
        ("cut", 6, "cut_off"), ("empty", 0, "empty"), ("file", 20, "cut_off"), ("other", 0, "columns"),
        ("short", 0, "cut_off"), ("text", 0, "not_arrow"),
    ]
    missing = scan({"gone": b""})[1]
    assert missing == [("gone", 0, "empty")]


def test_shard_of_another_schema_is_rejected_once(scan):
    other = pa.BufferOutputStream()
    with pa.ipc.new_stream(other, pa.schema([("name", pa.string())])) as writer:
        for _ in range(9):
            writer.write_batch(pa.record_batch({"name": ["x" * 900]}))
    good, bad, plan = scan({"other": other.getvalue().to_pybytes(), "good": stream([1, 2])}, 1000)
    assert plan.count() > 5
    assert bad == [("other", 0, "columns")] and good == {"good": [1, 2]}


def test_tables_in_folders_are_one_file(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"12")
    for part in ("p0", "p1", "k=1/p0"):
        (tmp_path / "b.parquet" / part).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "b.parquet" / part).write_bytes(b"123")
    specs = spark.createDataFrame(
        [("s", "^[ab][.]parquet$", 2, "r1"), ("none", "^c", 1, "r1")],
        "id string, file_pattern string, expected_files int, source_revision string",
    )
    listed, wrong = checksums.source_file_inventory(spark, str(tmp_path), specs)
    assert sorted((r["file"], r["size"]) for r in listed.collect()) == [("a.parquet", 2), ("b.parquet", 9)]
    assert [(r["id"], r["files"]) for r in wrong.collect()] == [("none", 0)]


def test_missing_shard(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / "nowhere"),)], "path string")
    rows = arrow_shards.scan_arrow(spark, files, ["id", "name"], SCHEMA, rejects=True).collect()
    assert [r["reason"] for r in rows] == ["unreadable"]


ODD = ["a b/x.log", "a%20b/x.log", "a+b/x.log", "50% of ü/x.log", "c/x.log"]


def test_names_beneath_an_odd_folder(spark, tmp_path):
    root = tmp_path / "my logs 5%25 + more"
    line = '{"event":"complete","stage":"benchmark_a","completed":%d,"timestamp_utc":"2024"}\n'
    for i, name in enumerate(ODD):
        (root / name).parent.mkdir(parents=True)
        (root / name).write_text(line % i)
    got = {r["log"]: r["completed"] for r in progress.read_progress_log(spark, str(root)).collect()}
    assert got == {name: i for i, name in enumerate(ODD)}
    files = checksums.content_checksums(spark, str(root)).collect()
    assert {r["file"] for r in files} == set(ODD)
    one = spark.read.text(str(root / ODD[0])).select(
        paths.relative(spark, str(root / ODD[0]), F.col("_metadata.file_path")).alias("f")
    )
    assert one.first()["f"] == "x.log"


def test_patterns_and_files_elsewhere(spark, tmp_path):
    for name in ("a 1", "a 2", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text("x\n")
    found = spark.read.text(f"{tmp_path}/a*/*.txt")
    named = found.select(paths.relative(spark, f"{tmp_path}/a*/*.txt", F.col("_metadata.file_path")).alias("f"))
    assert {r["f"] for r in named.collect()} == {"a 1/x.txt", "a 2/x.txt"}
    elsewhere = found.select(paths.relative(spark, f"{tmp_path}/b", F.col("_metadata.file_path")).alias("f"))
    with pytest.raises(Exception, match="is not beneath"):
        elsewhere.collect()
