import csv
import os

import pytest
from pyspark.sql import functions as F

from raterlake.operators import release
from raterlake.sources import publish, readers
from raterlake.streaming import ingest

SCHEMA = "patch_id string, engine string, D1 string, raw_response string"


def write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["patch_id", "engine", "D1", "raw_response"])
        w.writerows(rows)


def test_shards(spark, tmp_path):
    write(f"{tmp_path}/a-1/shard_1.csv", [["p1", "e", "late", '{"a":\n"x""}']])
    write(f"{tmp_path}/a/shard_1.csv", [["p1", "e", "first", 'say ""hi""\nthere'], ["", "e", "blank", ""], ["p2", "e", "", "x"]])
    write(f"{tmp_path}/a/other.csv", [["p9", "e", "no", ""]])
    rows = {r["patch_id"]: r for r in readers.read_shards(spark, str(tmp_path), SCHEMA).collect()}
    assert set(rows) == {"p1", "p2"} and rows["p1"]["D1"] == "first" and rows["p2"]["D1"] == "" and "\n" in rows["p1"]["raw_response"]
    assert readers.read_shards(spark, str(tmp_path), SCHEMA, keep_blank=True).count() == 3


def test_shards_with_headers_of_their_own(spark, tmp_path):
    """Columns in another order, more or fewer of them, a file without the required one, and a byte order mark."""
    for name, text in {"shard_1": "patch_id,engine,D1,raw_response\np1,e,a,x\n", "shard_2": "\ufeffD1,extra,patch_id,engine\nb,9,p2,e\n", "shard_3": "patch_id,engine\np3,e\n", "sub/shard_4": "patch_id,engine,D1,raw_response\np1,e,late,x\np4,f,d,y\n"}.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}.csv", "w", encoding="utf-8") as f:
            f.write(text)
    rows = {r["patch_id"]: tuple(r) for r in readers.read_shards(spark, str(tmp_path), SCHEMA).collect()}
    assert rows == {"p1": ("p1", "e", "a", "x"), "p2": ("p2", "e", "b", ""), "p4": ("p4", "f", "d", "y")}
    assert readers.read_shards(spark, str(tmp_path), SCHEMA, recursive=False).count() == 2
    assert readers.read_shards(spark, str(tmp_path), SCHEMA, dedup=False).count() == 4
    with pytest.raises(ValueError):
        readers.read_shards(spark, str(tmp_path), "patch_id string, engine string")


def test_lists_and_checksums(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert sorted(r["id"] for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    for k, text in enumerate(("sha256\tpath\nAB\tx\n", "file\tsha256\nx\tAB\n")):
        (tmp_path / f"c{k}.tsv").write_text(text)
        assert [tuple(r) for r in readers.read_checksums(spark, str(tmp_path / f"c{k}.tsv")).collect()] == [("x", "ab")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 1), ("a", "y", 2)], "id string, split string, n int")
    readers.write_csv(df, f"{tmp_path}/csv", ["id", "n", "gone"])
    assert {tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/csv").collect()} == {("b", "1", ""), ("a", "2", "")}
    readers.write_buckets(df.withColumnRenamed("split", "bucket"), f"{tmp_path}/buckets")
    assert spark.read.parquet(f"{tmp_path}/buckets").where("bucket = 'x'").count() == 1
    readers.write_id_lists(df, f"{tmp_path}/ids", "id", "split")
    assert {d for d in os.listdir(f"{tmp_path}/ids") if d.startswith("split=")} == {"split=x", "split=y"}
    files = readers.read_files(spark, f"{tmp_path}/csv", "*.csv", content=True)
    assert files.count() >= 1 and files.where("length(sha256) = 64").count() == files.count()
    readers.write_checksums(files, f"{tmp_path}/sums")
    assert readers.read_checksums(spark, f"{tmp_path}/sums").count() == files.count()
    readers.write_json_lines(df, f"{tmp_path}/json")
    assert readers.read_json_lines(spark, f"{tmp_path}/json", "id string, n int").count() == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    assert readers.write_report(df, f"{tmp_path}/r.json") == 2 and '"n": 2' in (tmp_path / "r.json").read_text()
    assert readers.markdown(df, "T").splitlines()[2:] == ["| name | n |", "|-|-|", "| a\\|b | 1 |", "|  | 2 |"]
    with pytest.raises(ValueError):
        readers.write_report(df, f"{tmp_path}/r.json", limit=1)
    with pytest.raises(ValueError):
        readers.write_csv(df, f"{tmp_path}/strict", ["name"], strict=True)
    assert readers.read_config('a: "x y"\n  b: "no"\nc: \'z\'\nd: plain\n') == {"a": "x y", "c": "z"}


def test_release_is_built_and_verified(spark, tmp_path):
    votes = spark.createDataFrame([("p1", "a", "train"), ("p2", "b", "val")], "patch_id string, D4 string, split string")
    rated = spark.createDataFrame([("p1", "x", "完好"), ("p1", "y", "完好"), ("p2", "x", "中度损伤"), ("p2", "y", "完好")], "patch_id string, engine string, D4 string")
    files = publish.build_release(str(tmp_path / "r"), votes, rated, ["D4"])
    assert files.count() > 5 and sorted(r["id"] for s in ("train", "val") for r in readers.read_ids(spark, f"{tmp_path}/r/splits/split={s}").collect()) == ["p1", "p2"]
    assert {r["status"]: r["n"] for r in publish.verify(spark, f"{tmp_path}/r").collect()} == {"ok": files.count()}
    assert spark.read.json(f"{tmp_path}/r/taxonomy").count() == 5
    (tmp_path / "s.json").write_text('{"done": [1, 2]}')
    (tmp_path / "empty.json").write_text("")
    assert readers.read_state(spark, f"{tmp_path}/s.json").first()["done"] == [1, 2] and readers.read_state(spark, f"{tmp_path}/empty.json") is None


def test_pool(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], "k string, n int"), spark.createDataFrame([("x", 2), ("z", 2)], "k string, n int")
    assert {tuple(r) for r in readers.coalesced_pool([a, b], "k", 3).collect()} == {("x", 1), ("y", 1), ("z", 2)}
    assert {tuple(r) for r in readers.coalesced_pool([a, b], "k", 2).collect()} == {("x", 1), ("y", 1)}


def test_ingest_resumes(spark, tmp_path):
    schema = "patch_id string, engine string, ts timestamp"
    folder, table, state = (f"{tmp_path}/{x}" for x in ("in", "table", "state"))
    first = spark.createDataFrame([("p1", "e", "2026-01-01 00:00:00"), ("p1", "e", "2026-01-01 00:00:05")], "patch_id string, engine string, ts string").withColumn("ts", F.to_timestamp("ts"))
    first.coalesce(1).write.parquet(f"{folder}/a")
    read = lambda: ingest.first_answers(ingest.read_arriving(spark, f"{folder}/*", schema), ["patch_id", "engine"], "ts")
    ingest.append_once(read(), table, state)
    ingest.append_once(read(), table, state)
    assert spark.read.parquet(table).count() == 1
    first.withColumn("patch_id", F.lit("p2")).coalesce(1).write.parquet(f"{folder}/b")
    ingest.append_once(read(), table, state)
    assert sorted(r[0] for r in spark.read.parquet(table).select("patch_id").collect()) == ["p1", "p2"]


def test_breaker_and_windows(spark, tmp_path):
    rows = [("a", f"2026-01-01 00:00:{i:02d}", f) for i, f in enumerate([True] * 4 + [False] + [True] * 5)]
    spark.createDataFrame(rows, "rater string, ts string, failed boolean").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.read_arriving(spark, f"{tmp_path}/in", "rater string, ts timestamp, failed boolean")
    q = ingest.breaker_stream(stream).writeStream.format("memory").queryName("trips").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination()
    assert [(r["rater"], r["run_length"]) for r in spark.table("trips").collect()] == [("a", 5)]
    q = ingest.windowed_counts(stream, "ts", "rater").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination()
    assert spark.table("windows").first()["n"] == 10


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_quarantine(spark, tmp_path):
    """Rows in = rows kept + rows set aside, with reasons; files that can't be read or lack a column are named."""
    import gzip

    head = "patch_id,engine,D1,n\n"
    put(f"{tmp_path}/a/shard_1.csv", head + 'p1,e,x,1\np2,e\np3,e,x,2,9\n"p4","e","a\nb",\n ,e,x,1\np5,e,x,two\n')
    put(f"{tmp_path}/a/shard_2.csv", '"n","D1","engine","patch_id"\n7,"y, z",e,p6\n')
    put(f"{tmp_path}/b/shard_3.csv", "patch_id,engine\np7,e\n")
    put(f"{tmp_path}/b/shard_4.csv", head)
    rows, aside = readers.read_quarantined(spark, str(tmp_path), "patch_id string, engine string, D1 string, n int")
    got = {r["patch_id"]: (r["D1"], r["n"]) for r in rows.collect()}
    assert got == {"p1": ("x", 1), "p4": ("a\nb", None), "p6": ("y, z", 7)}
    told = [(os.path.basename(r["file"]), r["reason"]) for r in aside.collect()]
    assert sorted(told) == sorted([("shard_1.csv", "cells don't fit the header")] * 2 + [("shard_1.csv", "patch_id is blank"), ("shard_1.csv", "n is no int"), ("shard_3.csv", "no column D1")])
    assert any(r["record"] == "p2,e" for r in aside.collect())
    whole = gzip.compress((head + "p8,e,x,1\n" * 50_000).encode())
    put(f"{tmp_path}/c/shard_5.csv.gz", whole[: len(whole) // 2])
    os.rename(f"{tmp_path}/c/shard_5.csv.gz", f"{tmp_path}/c/shard_5.csv")  # bytes that are no text
    with pytest.raises(ValueError):
        readers.read_quarantined(spark, str(tmp_path), "patch_id string")


def test_broken_shards_are_an_error(spark, tmp_path):
    """A compressed shard that ends too soon: an error, or, where asked for, what could be read of the others."""
    import gzip

    head = "patch_id,engine,D1,raw_response\n"
    put(f"{tmp_path}/shard_1.csv", head + "p1,e,x,r\n")
    os.makedirs(f"{tmp_path}/sub")
    whole = gzip.compress((head + "".join(f"q{i},e,x,{i * 7919}\n" for i in range(20_000))).encode())
    put(f"{tmp_path}/sub/shard_2.csv", head + "p2,e,x,r\n")
    assert readers.read_shards(spark, str(tmp_path), SCHEMA).count() == 2
    put(f"{tmp_path}/gz/part.csv.gz", whole[: len(whole) // 2])
    with pytest.raises(Exception):  # noqa: B017
        readers.read_csv(spark, f"{tmp_path}/gz").count()
    assert readers.read_csv(spark, f"{tmp_path}/gz", skip_bad=True).count() < 20_000


def test_first_header(spark, tmp_path):
    put(f"{tmp_path}/shard_1.csv", "patch_id,engine,D1\np1,e,x\n")
    put(f"{tmp_path}/shard_2.csv", "patch_id,engine,D1,raw_response\np2,e,x,r\n")
    rows = {r["patch_id"]: r["raw_response"] for r in readers.read_shards(spark, str(tmp_path), SCHEMA, first_header=True).collect()}
    assert rows == {"p1": "", "p2": ""}
    assert {r["patch_id"]: r["raw_response"] for r in readers.read_shards(spark, str(tmp_path), SCHEMA).collect()} == {"p1": "", "p2": "r"}


def test_large_buckets_are_dealt(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', null) bucket")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = readers.write_buckets(df, f"{tmp_path}/b", rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r[0]: r["n"] for r in sizes.collect()} == {"hot": 900, None: 100}
    assert len([f for f in os.listdir(f"{tmp_path}/b/bucket=hot") if f.startswith("part-")]) > 1
    assert spark.read.parquet(f"{tmp_path}/b").count() == 1000 and spark.read.json(f"{tmp_path}/b_manifest").count() == 2
