import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raterlake.functions import vocabulary as V
from raterlake.operators import agreement, calls, gate, panel, quality, ranks, release, sampling, tiling


def votes(spark, rows, dims=("D1",)):
    return spark.createDataFrame(rows, "unit string, rater int, ord int, " + ", ".join(f"{d} string" for d in dims))


def tiers(spark, answers):
    rows = [("u", i, i, a) for i, a in enumerate(answers)]
    got = panel.consensus(votes(spark, rows), "unit", ["D1"], ["ord"]).collect()
    return (got[0]["consensus"], got[0]["consensus_level"], got[0]["D1"], got[0]["D1_agreement"], got[0]["D1_total"], got[0]["any_tie_flag"]) if got else None


@pytest.mark.parametrize(
    ("answers", "expected"),
    [
        (["a"] * 4, ("high", "high", "a", 4, 4, False)),
        (["a", "a", "b", "a"], ("medium", "medium", "a", 3, 4, False)),
        (["b", "a", "a", "b"], ("review", "medium", "b", 2, 4, True)),
        (["d", "c", "b", "a"], ("review", "low", "d", 1, 4, True)),
        (["a", "a", "a"], ("medium", "medium", "a", 3, 3, False)),
        (["a", "a", "a", ""], ("high", "medium", "a", 3, 3, False)),
        (["a", "a"], ("medium", "medium", "a", 2, 2, False)),
        (["a"], None),
        ([None, "", None, ""], ("review", "low", "", 0, 0, False)),
    ],
)
def test_consensus(spark, answers, expected):
    assert tiers(spark, answers) == expected


def test_dedup(spark):
    df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 1, 1, ""), ("", 1, 3, "y"), ("", 1, 4, "z")], "unit string, rater int, ord int, v string")
    pick = lambda keep, **k: {(r["unit"], r["v"]) for r in panel.dedup(df, ["unit", "rater"], ["ord"], keep, **k).collect()}
    assert pick("first") == {("a", ""), ("", "y")}
    assert pick("last") == {("a", "x"), ("", "z")}
    assert pick("valid", valid=F.col("v") != "") == {("a", "x"), ("", "y")}


def brute_alpha(units, standard=False):
    units = [[v for v in u if v] for u in units]
    pairs = [(a, b) for u in units for i, a in enumerate(u) for b in u[i + 1 :]]
    if not pairs:
        return None
    used = [v for u in units for v in u if not standard or len(u) > 1]
    n = len(used)
    expected = sum(a != b for i, a in enumerate(used) for j, b in enumerate(used) if i != j) / (n * (n - 1))
    if standard:
        observed = sum(sum(a != b for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / (len(u) - 1) for u in units if len(u) > 1) / n
    else:
        observed = sum(a != b for a, b in pairs) / len(pairs)
    return 1 - observed / expected if expected > 0 else 1.0


def test_alpha(spark):
    rng = random.Random(5)
    for units in ([[rng.choice(["a", "b", "c", ""]) for _ in range(rng.randint(1, 5))] for _ in range(40)], [["a", "a"], ["a"]]):
        rows = [(str(u), r, r, v) for u, vs in enumerate(units) for r, v in enumerate(vs)]
        for variant, standard in (("pairwise", False), ("standard", True)):
            got = agreement.alpha(votes(spark, rows), "unit", ["D1"], variant).first()["alpha"]
            assert got == pytest.approx(brute_alpha(units, standard))
    assert agreement.alpha(votes(spark, [("1", 1, 1, "a"), ("2", 1, 1, "b")]), "unit", ["D1"]).first()["alpha"] is None
    empty = votes(spark, [("1", 1, 1, "")])
    assert agreement.alpha(empty, "unit", ["D1"]).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), min_size=2, max_size=6), st.randoms())
def test_vote_is_order_free_without_ties(spark, answers, rng):
    top = max(answers.count(x) for x in answers)
    if sum(answers.count(x) == top for x in set(answers)) > 1:
        return
    mixed = list(answers)
    rng.shuffle(mixed)
    assert tiers(spark, answers) == tiers(spark, mixed)


def test_agreement_matrix(spark):
    rows = [("u", 1, 1, "a"), ("u", 2, 1, "a"), ("u", 3, 1, ""), ("v", 1, 1, "a"), ("v", 2, 1, "b")]
    got = {r["pair"]: (r["agree"], r["total"]) for r in agreement.agreement_matrix(votes(spark, rows), "unit", "rater", ["D1"]).collect()}
    assert got == {"1_vs_2": (1, 2)}


def test_latency(spark):
    for n in (1, 2, 4, 20, 21):
        df = spark.createDataFrame([("g", str(float(v))) for v in range(1, n + 1)] + [("g", "x"), ("g", "0"), ("g", "-1")], "g string, v string")
        r = quality.latency_summary(df, ["g"], "v").first()
        ordered = list(range(1, n + 1))
        assert (r["n"], r["median"], r["p95"]) == (n, ordered[n // 2], ordered[int(n * 0.95)])
    assert quality.latency_summary(spark.createDataFrame([("g", "x")], "g string, v string"), ["g"], "v").count() == 0


def test_damage_labels(spark):
    rows = [("起甲", "P1", "中度"), ("裂隙", "P2", "严重"), ("裂隙", None, None), ("裂隙", "", None), ("开裂", "P3", "轻微"), ("剥离", None, None), ("none", None, None), ("NONE", None, None), ("", None, None), (None, None, None), ("虫蛀", None, None), ("霉斑", "P4", "极重")]
    df = spark.createDataFrame(rows, "l string, layer string, s string")
    valid = sorted({x for d in ("P1", "P2", "P3", "P4") for x in V.LABELS[d]} - {"无"})
    out = df.select(gate.resolve_damage(F.col("l"), F.col("layer"), F.col("s"), valid, {"开裂": "裂隙"}, ["剥离"], ["无"], ["裂隙"], list(V.SEVERITY.values())).alias("r")).select("r.*").collect()
    assert [r["resolution"] for r in out] == ["direct", "direct", "direct", "direct", "alias", "review", "rejected", "rejected", "rejected", "rejected", "review", "direct"]
    assert [r["review_required"] for r in out] == [False, False, True, False, False, True, True, True, True, True, True, True]
    assert out[5]["review_reason"] == "unsafe_label" and out[10]["review_reason"] == "unknown_label" and out[11]["severity_valid"] is False


def test_export_gate(spark):
    df = spark.createDataFrame([("a", False), ("b", True), (None, False)], "l string, r boolean")
    keep, queue = gate.export_gate(df, "l", "r", ["a", "b"])
    assert keep.count() == 2 and queue.count() == 1
    keep, queue = gate.export_gate(spark.createDataFrame([("Unknown", False)], "l string, r boolean"), "l", "r", ["Unknown"])
    for part in (keep, queue):
        with pytest.raises(Exception, match="no official label"):
            part.count()


def test_assemble_rows(spark):
    full = {"D1": "神将", "D2": "道冠", "D3": "宝剑", "D4": "完好", "D5": "前景", "confidence": "0.9"}
    df = spark.createDataFrame([("object", full), ("object", {**full, "D1": "天王神将"}), ("array", None), ("object", {"D1": "?"})], "kind string, fields map<string,string>")
    rows = gate.assemble_rows(df).collect()
    assert [r["gate_pass"] for r in rows] == [True, False, False, False]
    assert [r["D1"] for r in rows] == ["神将", "神将", "背景留白", "背景留白"]
    assert rows[0]["review_required"] is False and rows[1]["review_required"] is False and rows[3]["review_required"] is True
    assert rows[2]["raw_errors"].startswith("not_dict")


def test_tiles(spark):
    for width, xs in ((512, [0]), (513, [0, 1]), (870, [0, 358]), (871, [0, 358, 359])):
        got = tiling.tile_grid(tiling.sources(spark, [("s", width, 512, "train")])).orderBy("tx").collect()
        assert [r["x"] for r in got] == xs
    with pytest.raises(Exception, match="smaller than a tile"):
        tiling.tile_grid(tiling.sources(spark, [("s", 100, 512, "train")])).collect()
    counts = {(r["kind"], r["value"]): r["n"] for r in tiling.group_counts(tiling.tile_grid(tiling.sources(spark)), ["split", "source_id"]).collect()}
    assert counts["all", ""] == 7455 and (counts["split", "train"], counts["split", "val"], counts["split", "test"]) == (5082, 1239, 1134)


def test_splits(spark):
    df = tiling.hash_split(spark.range(5000).select(F.col("id").cast("string").alias("k")), "k")
    n = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert abs(n["train"] - 4000) < 150 and abs(n["val"] - 500) < 100
    leaks = tiling.split_leaks(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "g string, s string"), "g", "s").collect()
    assert [(r["g"], r["n_splits"]) for r in leaks] == [("a", 2)]
    parsed = spark.createDataFrame([("a_b_1_2.png",), ("bad.png",)], "n string").select(tiling.parse_tile_name(F.col("n")).alias("p")).collect()
    assert tuple(parsed[0]["p"]) == ("a_b", 1, 2) and tuple(parsed[1]["p"]) == (None, None, None)


def test_sampling(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(20)], "id string, v double")
    picked = sampling.pick_strata(df, "id", [("a", F.col("v") > 5), ("b", F.col("v") > 8)], 3).collect()
    a, b = ([r["id"] for r in picked if r["stratum"] == s] for s in "ab")
    assert a == ["10", "11", "12"] and b == ["13", "14", "15"]
    assert sampling.with_quantiles(df, {"q": ("v", 0.25)}).first()["q"] == pytest.approx(4.75)
    assert sampling.hash_sample(df, "id", 5).count() == 5


def test_breaker_and_shards(spark):
    rows = [("a", i, f) for i, f in enumerate([1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1])] + [("b", i, 1) for i in range(4)]
    got = calls.breaker_trips(spark.createDataFrame(rows, "r string, o int, f int").withColumn("f", F.col("f") == 1), "r", "o", "f", 5).collect()
    assert [(r["r"], r["tripped_at"], r["run_length"]) for r in got] == [("a", 9, 6)]
    plan = calls.shard_plan(spark.range(1239).select(F.lit("val").alias("s")), "s", 200).orderBy("shard_id").collect()
    assert [r["count"] for r in plan] == [200] * 6 + [39] and plan[-1]["end"] == 1239


def test_release(spark):
    docs = release.checksums(spark.createDataFrame([("a", "x"), ("b", "y")], "k string, t string"), "k", "t")
    wrong = docs.withColumn("sha256", F.when(F.col("k") == "a", F.col("sha256")).otherwise(F.lit("0")))
    assert {r["status"]: r["n"] for r in release.verify_checksums(wrong, docs, "k").collect()} == {"ok": 1, "mismatch": 1}
    keys = spark.range(1).select(release.secret_keys(F.lit('{"token": 1, "a": 2}')).alias("k"), release.secret_keys(F.lit("no json")).alias("n")).first()
    assert keys["k"] == ["token"] and keys["n"] == []


def test_antijoin_partitions(spark):
    work, done = spark.range(10).toDF("k"), spark.createDataFrame([(1,), (3,), (3,), (99,)], "k long")
    left = calls.remaining(work, done, ["k"])
    assert left.count() + work.join(done, "k", "left_semi").count() == 10


@pytest.mark.parametrize(("accuracy", "n"), [(100_000, 50), (50, 3000)])
def test_values_at_ranks(spark, monkeypatch, accuracy, n):
    """Whole groups, and groups of which only a narrow range is ordered."""
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = random.Random(n)
    rows = [("a", float(rng.randrange(400))) for _ in range(n)] + [("b", rng.random()) for _ in range(n // 2)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quality.latency_summary(df, ["g"], "v").collect()}
    by = {g: sorted(v for k, v in rows if k == g and v is not None and v > 0) for g in "abc"}
    assert set(got) == set("abc")
    for g, v in by.items():
        assert (got[g]["n"], got[g]["median"], got[g]["p95"]) == (len(v), v[len(v) // 2], v[int(len(v) * 0.95)])
    import numpy as np

    every = [v for _, v in rows if v is not None]
    for r in ranks.quantiles(df, [], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert r["value"] == pytest.approx(np.quantile(every, r["q"]))
    assert ranks.quantiles(df.limit(0), [], "v", [0.5]).collect() == []


@pytest.mark.parametrize("bucket", [7, 1_000_000])
def test_runs_and_windows_over_buckets(spark, monkeypatch, bucket):
    """Breaker, numbers and rate audit against plain loops, with many small buckets and with one."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(calls, "WINDOWS", 1 if bucket == 7 else 60)
    rng = random.Random(5)
    rows = [(g, k, rng.random() < p, 1000 * k + rng.randrange(30_000)) for g, p in (("a", 0.8), ("b", 0.2), ("c", 1.0), ("d", 0.0)) for k in range(120)]
    df = spark.createDataFrame(rows, "g string, o long, f boolean, ms long").withColumn("ts", F.timestamp_millis("ms"))
    want = {}
    for g in "abcd":
        run, first, longest = 0, None, 0
        for _, o, f, _ in sorted(r for r in rows if r[0] == g):
            run = run + 1 if f else 0
            first = o if run == 4 and first is None else first
            longest = max(longest, run)
        if first is not None:
            want[g] = (first, longest)
    assert {r["g"]: (r["tripped_at"], r["run_length"]) for r in calls.breaker_trips(df, "g", "o", "f", 4).collect()} == want
    assert all(r["o"] + 1 == r["done"] for r in calls.progress_marks(df, "g", "o", 1).collect())
    assert calls.progress_marks(df, "g", "o", 30).count() == 16
    got = {r["g"]: (r["most_in_window"], r["least_gap_s"]) for r in calls.rate_audit(df, "g", "ts", 5).collect()}
    for g in "abcd":
        t = sorted(r[3] for r in rows if r[0] == g)
        assert got[g] == (max(sum(x - 5000 <= y <= x for y in t) for x in t), min(b - a for a, b in zip(t, t[1:], strict=False)) / 1000)


def test_smoke_and_pilot(spark):
    good = [("a", "true", "true", "")] * 9 + [("a", "false", "true", "")]
    semantic = spark.createDataFrame(good, "engine string, raw_schema_ok string, gate_pass string, cross_dim_warnings string")
    damage = semantic.drop("cross_dim_warnings")
    assert quality.go_no_go(quality.smoke_checks(semantic, damage)).first()["verdict"] == "GO"
    bad = damage.unionByName(spark.createDataFrame([("b", "true", "false")], damage.schema))
    checks = {r["check"]: r["status"] for r in quality.smoke_checks(semantic, bad).collect()}
    assert checks["engine_b_gate_pass"] == "FAIL" and checks["engine_a_gate_pass"] == "PASS"
    assert quality.go_no_go(quality.smoke_checks(semantic, bad)).first()["verdict"] == "NO-GO"
    pilot = spark.createDataFrame([(True, True)] * 9 + [(False, True)], "x boolean, y boolean")
    assert quality.pilot_exit(pilot, "x", "y").first()["exit_ok"] and not quality.pilot_exit(pilot, "x", "y", 0.95).first()["exit_ok"]


def test_check_rater_without_rows_or_columns(spark):
    df = spark.createDataFrame([("p", "a")], "patch_id string, D1 string")
    got = {r["check"]: r["status"] for r in quality.check_rater(df, 1, {"D1": ["a"], "D2": ["b"]}, required=["patch_id", "D2"]).collect()}
    assert got["schema"] == "FAIL" and got["coverage"] == "PASS" and "latency" not in got
    assert [tuple(r) for r in quality.check_rater(df.limit(0), 1, {"D1": ["a"]}).select("check", "status").collect()] == [("coverage", "INFO")]


def test_rank_split_sizes(spark):
    df = tiling.rank_split(spark.range(1237).select(F.col("id").alias("k")), "k")
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 989, "val": 123, "test": 125}


def test_ranks_null_groups_and_orders(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 3)
    rows = [(g, o, i) for g in ("a", None) for i, o in enumerate([None, 5, 9, 10**18, 7, 5, 1, None, 3])]
    df = spark.createDataFrame(rows, "g string, o long, i int")
    got = ranks.numbered(df, ["g"], "o", "k").collect()
    for g in ("a", None):
        mine = sorted((r["k"], r["o"]) for r in got if r["g"] == g)
        assert [k for k, _ in mine] == list(range(1, 10))
        assert [o for _, o in mine] == [None, None, 1, 3, 5, 5, 7, 9, 10**18]
    assert sorted(r["k"] for r in ranks.numbered(df, [], "o", "k").collect()) == list(range(1, 19))
    assert {(r["g"], r["done"]) for r in calls.progress_marks(df, "g", "o", 4).collect()} == {(g, k) for g in ("a", None) for k in (4, 8)}
    assert {(r["g"], r["o"]) for r in calls.shard_rows(df, "g", "o", 4, 3).collect()} == {("a", 10**18), (None, 10**18)}
    trips = calls.breaker_trips(spark.createDataFrame([(None, i, i != 3) for i in range(9)], "g string, o long, f boolean"), "g", "o", "f", 4).collect()
    assert [tuple(r) for r in trips] == [(None, 7, 5)]


def test_latency_of_null_group(spark, monkeypatch):
    df = spark.createDataFrame([(None, float(i)) for i in range(1, 11)] + [("a", 2.0)] + [("b", float(i)) for i in range(1, 6)], "g string, v double")
    for most in (10_000, 1):  # by a broadcast of all groups, and of the largest one only
        monkeypatch.setattr(ranks, "BROADCAST_GROUPS", most)
        got = {r["g"]: (r["n"], r["median"], r["p95"]) for r in quality.latency_summary(df, ["g"], "v").collect()}
        assert got == {None: (10, 6.0, 10.0), "a": (1, 2.0, 2.0), "b": (5, 3.0, 5.0)}


def test_outlier_leaves_buckets_even(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 100)
    df = spark.range(1000).selectExpr("if(id = 999, 1000000000000000000, id) o")
    sizes = [r["count"] for r in ranks.bucketed(df, "o").groupBy("_bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 110


@pytest.mark.parametrize("cuts", [[], [3.0], [float(i) for i in range(0, 40, 3)], [float(i) for i in range(17)]])
def test_bucket_of(spark, cuts):
    df = spark.createDataFrame([(None,)] + [(i,) for i in range(-2, 45)], "o long")
    for r in df.withColumn("b", ranks.bucket_of(df["o"], cuts)).collect():
        assert r["b"] == (-1 if r["o"] is None else sum(c <= r["o"] for c in cuts))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_product_and_no_group_in_one_task(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("id", "cast(id % 3 as string) g", "cast(id as double) v", "id % 7 = 0 f")
        for out in (tiling.rank_split(df, "id"), calls.breaker_trips(df, "g", "id", "f"), calls.progress_marks(df, "g", "id", 10), calls.shard_rows(df, "g", "id", 10, 1)):
            assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
        plan = plan_of(quality.latency_summary(df, ["g"], "v"))
        assert "NestedLoop" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sets_in_one_pass(spark):
    """Any number of parts, repeated and null ids, against Python's sets; one exchange on the id."""
    rng = random.Random(12)
    sets = [[rng.choice([None, *range(30)]) for _ in range(rng.choice([0, 5, 25]))] for _ in range(5)]
    parts = [(f"p{i}", spark.createDataFrame([(x,) for x in s], "k long")) for i, s in enumerate(sets)]
    whole = set(range(20)) | {None}
    report = release.set_report(parts, spark.createDataFrame([(x,) for x in whole], "k long"), "k")
    got, held = {r["measure"]: r["n"] for r in report.collect()}, [set(s) for s in sets]
    union = set().union(*held)
    want = {f"size:p{i}": len(s) for i, s in enumerate(held)} | {f"intersect:p{i}&p{j}": len(held[i] & held[j]) for i in range(5) for j in range(i + 1, 5)}
    assert got == want | {"union": len(union), "union_only": len(union - whole), "whole_only": len(whole - union)}
    fresh = release.set_report(parts, spark.createDataFrame([(x,) for x in whole], "k long"), "k")
    assert plan_of(fresh).count("Exchange hashpartitioning(k") == 1


def test_matrix_stats(spark):
    """Against numpy, with nulls, other sizes, empty arrays and matrices of one row."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(7)] + [(7, None), (8, []), (9, [1.0] * 11), (10, [None] + [1.0] * 11), (11, [2.0] * 12), (12, [float(x) for x in range(12)])]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    for shape in ((3, 4), (4, 3), (1, 12), (12, 1)):
        for r in sampling.matrix_stats(df.repartition(2), "i", "v", *shape).collect():
            v = dict(rows)[r["i"]]
            if not v or len(v) != 12 or None in v:
                assert r["mean"] is r["std"] is r["edge_var"] is None
                continue
            x = np.array(v).reshape(shape)
            across, down = (np.diff(x, axis=a).var() if x.shape[a] > 1 else 0.0 for a in (1, 0))
            assert [r[c] for c in ("mean", "std", "edge_var", "var_across", "var_down")] == pytest.approx([x.mean(), x.std(), (across + down) / 2, across, down])
