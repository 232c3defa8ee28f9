"""Incremental consensus, call events with timers, releases put in place as a whole."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from raterlake.operators import panel
from raterlake.sources import atomic, hashing, publish, readers
from raterlake.streaming import calls, ingest
from raterlake.streaming.consensus import ConsensusTable

ANSWERS = "unit string, rater string, D1 string, D2 string, k long"


def answers(rng, n, start):
    return [(rng.choice([*(f"u{i}" for i in range(40)), "", None]), rng.choice("abcd"), rng.choice(["x", "y", "", None]), rng.choice(["p", "q"]), start + i) for i in range(n)]


def table(spark, path):
    return ConsensusTable(spark, str(path), ANSWERS, "unit", "rater", ["D1", "D2"], ["k"], buckets=8)


def batch_votes(spark, rows):
    df = spark.createDataFrame(rows, ANSWERS).where("trim(coalesce(unit, '')) <> ''")
    return panel.consensus(panel.dedup(df, ["unit", "rater"], ["k"]), "unit", ["D1", "D2"], ["k"])


def test_consensus_equals_the_batch_vote(spark, tmp_path):
    """After every batch, after a replay, and when later batches bring earlier rows."""
    rng, t, seen = random.Random(3), table(spark, tmp_path / "t"), []
    assert t.votes().collect() == [] and t.rows().collect() == []
    for batch, start in enumerate((500, 1000, 0, 1500)):
        new = answers(rng, 60, start)
        seen += new
        df = spark.createDataFrame(new, ANSWERS).withColumn("other", F.lit(1))
        assert t.merge(df, batch)
        want = sorted(map(tuple, batch_votes(spark, seen).collect()))
        assert sorted(map(tuple, t.votes().collect())) == want and want
        assert t.merge(df, batch) == []  # again
        assert sorted(map(tuple, t.votes().collect())) == want
    assert len(os.listdir(tmp_path / "t" / "commits")) <= 2 * 2  # with checksum files


def test_consensus_touches_its_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(spark.createDataFrame(answers(random.Random(4), 200, 0), ANSWERS), 0)
    touched = t.merge(spark.createDataFrame([("u1", "a", "x", "p", 9999), ("u1", "e", "x", "p", 9999)], ANSWERS), 1)
    assert len(touched) == 1 and set(os.listdir(tmp_path / "t/rows/batch=1")) - {"_SUCCESS", "._SUCCESS.crc"} == {f"bucket={touched[0]}"}
    assert t.merge(spark.createDataFrame([], ANSWERS), 2) == []


def test_consensus_files_are_of_tasks(spark, tmp_path, monkeypatch):
    """A task writes one bucket, however many tasks there are; a table that was dealt by another hash is dealt anew."""
    monkeypatch.setattr(panel, "TASK_ROWS", 20, raising=False)
    rows, more = answers(random.Random(6), 400, 0), answers(random.Random(7), 300, 400)
    t = table(spark, tmp_path / "t")
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        t.merge(spark.createDataFrame(rows, ANSWERS), 0)
    finally:
        spark.conf.set(joined, "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for what in ("rows", "votes"):
        assert 8 <= len(list((tmp_path / "t" / what).glob("batch=0/bucket=*/*.parquet"))) <= 24  # at most 400 rows in 20s, to a multiple of 8
    old = tmp_path / "old"
    monkeypatch.setattr(ConsensusTable, "_bucket", lambda self: F.pmod(F.xxhash64(self.unit), F.lit(self.buckets)).cast("int").alias("bucket"))
    t = table(spark, old)
    t.merge(spark.createDataFrame(rows, ANSWERS), 0)
    monkeypatch.undo()
    commit = next((old / "commits").glob("*0.json"))
    commit.write_text(commit.read_text().replace(', "dealt": "hash"', ""))
    for crc in (old / "commits").glob(".*.crc"):
        crc.unlink()
    t.merge(spark.createDataFrame(more[:5], ANSWERS), 1)
    t.merge(spark.createDataFrame(more[5:], ANSWERS), 2)
    assert sorted(map(tuple, t.votes().collect())) == sorted(map(tuple, batch_votes(spark, rows + more).collect()))


def test_consensus_survives_a_crash(spark, tmp_path, monkeypatch):
    """A batch that dies before its commit leaves the votes as they were, and is taken in when it comes again."""
    rng, t = random.Random(5), table(spark, tmp_path / "t")
    first, second = answers(rng, 80, 0), answers(rng, 80, 100)
    t.merge(spark.createDataFrame(first, ANSWERS), 0)
    before = sorted(map(tuple, t.votes().collect()))
    write = atomic.write_text

    def die(*args):
        raise OSError("lost")

    monkeypatch.setattr(atomic, "write_text", die)
    with pytest.raises(OSError):
        t.merge(spark.createDataFrame(second, ANSWERS), 1)
    assert sorted(map(tuple, t.votes().collect())) == before
    monkeypatch.setattr(atomic, "write_text", write)
    t.merge(spark.createDataFrame(second, ANSWERS), 1)
    assert sorted(map(tuple, t.votes().collect())) == sorted(map(tuple, batch_votes(spark, first + second).collect()))


def test_consensus_follows_a_stream(spark, tmp_path):
    rng, seen, t = random.Random(6), [], table(spark, tmp_path / "t")
    for i in range(3):
        new = answers(rng, 50, 100 * i)
        seen += new
        spark.createDataFrame(new, ANSWERS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        t.follow(ingest.read_arriving(spark, f"{tmp_path}/in/*", ANSWERS, files_per_batch=1), f"{tmp_path}/state")
        assert sorted(map(tuple, t.votes().collect())) == sorted(map(tuple, batch_votes(spark, seen).collect()))


CALLS = "rater string, ts timestamp, item string, failed boolean, status int"


def at(minute, second=0):
    return f"2026-01-01 00:{minute:02d}:{second:02d}"


def write_calls(spark, folder, rows):
    df = spark.createDataFrame(rows, "rater string, ts string, item string, failed boolean, status int")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(folder)


def run_calls(spark, tmp_path, **more):
    calls.rocksdb(spark)
    stream = ingest.read_arriving(spark, f"{tmp_path}/in/*", CALLS, files_per_batch=1)
    q = calls.call_events(stream, **more).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r["rater"], str(r["at"]), r["event"], r["item"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), q


def test_calls_out_of_order_late_and_forgotten(spark, tmp_path):
    """Runs are counted by event time across batches; late calls don't count; state goes after its time."""
    write_calls(spark, f"{tmp_path}/in/0", [("a", at(1, 3), "i3", True, 500), ("a", at(1, 1), "i1", True, 500), ("b", at(1), "x", True, 401), ("b", at(1, 1), "x", True, 500), (None, at(1), "x", True, 1), ("a", None, "x", True, 1)])
    write_calls(spark, f"{tmp_path}/in/1", [("a", at(1, 2), "i2", True, 500), ("a", at(1, 4), "i1", False, 200), ("a", at(1, 5), "i2", True, 500), ("c", at(20), "z", False, 200)])
    write_calls(spark, f"{tmp_path}/in/2", [("a", at(1, 6), "i9", True, 500), ("c", at(21), "z", False, 200)])  # later than the watermark: dropped
    write_calls(spark, f"{tmp_path}/in/3", [("c", at(50), "z", False, 200)])
    write_calls(spark, f"{tmp_path}/in/4", [("c", at(51), "z", False, 200)])
    got, query = run_calls(spark, tmp_path, limit=3, attempts=2, lateness="2 minutes", ttl_s=600)
    a = [g for g in got if g[0] == "a"]
    assert [(g[2], g[1][14:], g[3], g[4]) for g in a if g[2] != "forgotten"] == [("tripped", "01:03", "i3", 3), ("gave_up", "01:05", "i2", 2)]
    assert [(g[2], g[4]) for g in got if g[0] == "b" and g[2] != "forgotten"] == [("stopped", 401)]
    assert {g[0]: g[4] for g in got if g[2] == "forgotten"} == {"a": 5, "b": 2, "c": 2}  # c before its pause
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) > rows[-1] and rows[-1] <= 8


def build(spark, folder, label="完好", **more):
    votes = spark.createDataFrame([("p1", label, "train"), ("p2", "b", "val")], "patch_id string, D4 string, split string")
    rated = spark.createDataFrame([("p1", "x", "完好"), ("p1", "y", "完好"), ("p2", "x", "中度损伤"), ("p2", "y", "完好")], "patch_id string, engine string, D4 string")
    return publish.build_release(folder, votes, rated, ["D4"], **more)


def test_release_moves_with_its_checksums(spark, tmp_path):
    sums = build(spark, str(tmp_path / "r"), names={"D4": "state"}, texts={"LICENSE": "free"})
    paths = {r["path"] for r in sums.collect()}
    assert not any(p.startswith(("/", "file:")) for p in paths) and {p.split("/")[0] for p in paths} == {"annotations", "splits", "statistics", "taxonomy", "codebook", "LICENSE"}
    shutil.move(tmp_path / "r", tmp_path / "elsewhere")
    assert {r["status"]: r["n"] for r in publish.verify(spark, str(tmp_path / "elsewhere")).collect()} == {"ok": len(paths)}
    book = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/elsewhere/codebook").collect())
    assert "## D4 — state" in book and "| 完好 | 0 |" in book
    assert spark.read.json(f"{tmp_path}/elsewhere/statistics/agreement").count() == 1
    victim = next((tmp_path / "elsewhere/taxonomy").glob("part-*"))
    os.remove(victim.parent / f".{victim.name}.crc")
    victim.write_text("changed")
    assert {r["status"] for r in publish.verify(spark, str(tmp_path / "elsewhere")).collect()} == {"ok", "mismatch"}


@pytest.mark.parametrize("part", ["write_csv", "write_id_lists", "write_checksums"])
def test_release_that_dies_leaves_the_old_one(spark, tmp_path, monkeypatch, part):
    folder = str(tmp_path / "r")
    build(spark, folder)

    def die(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(readers, part, die)
        with pytest.raises(OSError):
            build(spark, folder, "轻微损伤")
    assert os.listdir(tmp_path) == ["r"] and {r["status"] for r in publish.verify(spark, folder).collect()} == {"ok"}
    assert readers.read_csv(spark, f"{folder}/annotations/consensus").where("D4 = '完好'").count() == 1
    build(spark, folder, "轻微损伤")
    assert readers.read_csv(spark, f"{folder}/annotations/consensus").where("D4 = '轻微损伤'").count() == 1 and os.listdir(tmp_path) == ["r"]


def test_release_between_the_renames(spark, tmp_path):
    """A driver that dies after the old release stepped aside."""
    folder = str(tmp_path / "r")
    build(spark, folder)
    os.rename(folder, folder + ".aside")
    os.makedirs(tmp_path / "r.staged-1")
    assert publish.recover(spark, folder) == "restored" and {r["status"] for r in publish.verify(spark, folder).collect()} == {"ok"}
    shutil.copytree(folder, folder + ".aside")
    assert publish.recover(spark, folder) == "clean" and os.listdir(tmp_path) == ["r"]


def test_hashes_of_large_files(spark, tmp_path):
    """In chunks and by Spark, the same sums; nothing of a file comes as a row."""
    import hashlib

    os.makedirs(tmp_path / "d/é b")
    contents = {"a.bin": b"x" * 100, "é b/large one.bin": os.urandom(9_000_000), "b": b"y"}
    for name, data in contents.items():
        (tmp_path / "d" / name).write_bytes(data)
    want = {name: hashlib.sha256(data).hexdigest() for name, data in contents.items()}
    for whole in (50, 1 << 30):
        got = hashing.file_hashes(spark, str(tmp_path / "d"), whole=whole)
        assert {r["path"]: r["sha256"] for r in got.collect()} == want


def test_hashes_of_empty_files(spark, tmp_path):
    """An empty part file is listed, so that what is written into it is a mismatch and not unlisted."""
    (tmp_path / "d").mkdir()
    for name, text in (("a", "x"), ("part-0", ""), ("_SUCCESS", ""), (".part-0.crc", "")):
        (tmp_path / "d" / name).write_text(text)
    assert {r["path"]: r["length"] for r in hashing.file_hashes(spark, str(tmp_path / "d")).collect()} == {"a": 1, "part-0": 0}


def test_text_is_replaced(spark, tmp_path):
    path = str(tmp_path / "s/state.json")
    assert atomic.read_text(spark, path) is None
    for text in ('{"a": 1}', "é\nzwei"):
        atomic.write_text(spark, path, text)
        assert atomic.read_text(spark, path) == text
    assert [n for n in os.listdir(tmp_path / "s") if n.endswith(".tmp")] == []


def test_progress_from_the_writing_pass(spark, tmp_path):
    from raterlake.sources.progress import ProgressLog

    now = iter(range(0, 1000, 60))
    log = ProgressLog(spark, str(tmp_path / "p"), 250, clock=lambda: float(next(now)))
    runs = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            runs.add(1)
            yield r

    df = spark.createDataFrame(spark.range(100).rdd.mapPartitions(counted), "id long").selectExpr("id", "id % 10 = 0 f", "'500' ms")
    first = log.write(df, lambda d: d.write.parquet(f"{tmp_path}/a"), F.col("f"), "ms")
    assert runs.value == 100 and spark.read.parquet(f"{tmp_path}/a").count() == 100
    assert (first["completed"], first["failed"], first["latency_s"], first["percent"], first["rate_per_min"], first["eta_remaining_s"]) == (100, 10, 50.0, 40.0, 100.0, 90.0)
    with pytest.raises(Exception):  # noqa: B017
        log.write(df, lambda d: d.write.parquet(f"{tmp_path}/a"))
    log.write(df, lambda d: d.write.parquet(f"{tmp_path}/b"))
    assert [r["completed"] for r in log.entries().collect()] == [100, 200] and log.summary()["completed"] == 200
    again = ProgressLog(spark, str(tmp_path / "p"), 250, clock=lambda: 0.0)
    assert again.add(50)["completed"] == 250


def test_progress_of_a_stream(spark, tmp_path):
    import time

    from raterlake.sources.progress import ProgressLog, watched

    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    log = ProgressLog(spark, str(tmp_path / "p"), 60)
    listener = log.listener("told")
    spark.streams.addListener(listener)
    try:
        stream = watched(ingest.read_arriving(spark, f"{tmp_path}/in/*", "id long", files_per_batch=1), F.col("id") == 0)
        stream.writeStream.queryName("told").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if (log.summary() or {}).get("completed") == 60:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert log.summary()["completed"] == 60 and log.summary()["failed"] == 3 and log.entries().count() == 3


def test_run_record_and_frozen_files(spark, tmp_path):
    import hashlib
    import json

    from raterlake.operators import calls as batch

    (tmp_path / "conf").mkdir()
    (tmp_path / "conf/prompt.yaml").write_text("a: 1")
    want = hashlib.sha256(b"a: 1").hexdigest()
    assert [tuple(r) for r in publish.freeze_files(spark, str(tmp_path / "conf")).collect()] == [("prompt.yaml", 4, want[:16])]
    runs = spark.createDataFrame([("r1", False, 0), ("r1", True, 60), (None, True, 5)], "run string, failed boolean, s long").withColumn("ts", F.timestamp_seconds("s"))
    inputs = {"prompt": (str(tmp_path / "conf"), "prompt.yaml"), "gone": (str(tmp_path / "conf"), "none.yaml")}
    record = publish.run_record(spark, str(tmp_path / "m/_manifest.json"), batch.run_manifest(runs, "run", "failed", "ts"), inputs, {"version": "2"})
    assert record["inputs_sha256"] == {"prompt": want, "gone": "n/a"} and record["version"] == "2"
    assert {r["run"]: (r["completed"], r["failed"], r["elapsed_s"]) for r in record["runs"]} == {"r1": (2, 1, 60.0), None: (1, 1, 0.0)}
    assert json.loads((tmp_path / "m/_manifest.json").read_text())["version"] == "2"


def test_breaker_order_within_a_batch_and_ttl():
    """Frames of a batch in any order; a state that has timed out is removed."""
    import pandas as pd

    class State:
        exists, hasTimedOut, value, ttl = False, False, None, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

        def getCurrentWatermarkMs(self):
            return 3000

        def setTimeoutTimestamp(self, ms):
            self.ttl = ms

        def remove(self):
            self.exists = False

    state, step = State(), ingest.breaker_state(3, 1000)
    at = lambda *seconds: pd.to_datetime(pd.Series(seconds), unit="s")
    frames = [pd.DataFrame({"ts": at(4, 1), "failed": [True, False], "rater": ["a", "a"]}), pd.DataFrame({"ts": at(3, 2), "failed": [True, True], "rater": ["a", "a"]})]
    (out,) = step(("a",), iter(frames), state)
    assert out.values.tolist() == [["a", pd.Timestamp(4, unit="s"), 3]] and state.value == (3,) and state.ttl == 5000
    state.hasTimedOut = True
    (out,) = step(("a",), iter(()), state)
    assert len(out) == 0 and not state.exists


def test_readers_beside_a_writer(spark, tmp_path):
    """A reader that asks all the time finds one of the texts, whole."""
    import threading

    path, stop, seen = str(tmp_path / "s.json"), threading.Event(), set()
    atomic.write_text(spark, path, "x" * 1000)

    def read():
        while not stop.is_set():
            seen.add(atomic.read_text(spark, path))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(100):
        atomic.write_text(spark, path, "xyz"[i % 3] * (1000 + i % 3))
    stop.set()
    reader.join()
    assert seen <= {"x" * 1000, "y" * 1001, "z" * 1002} and len(seen) > 1
