"""Typed answers against Python's own parser and printing."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from raterlake.functions import labels, typed
from raterlake.functions import vocabulary as V
from raterlake.operators import gate


@pytest.fixture(scope="module", autouse=True)
def last_key(spark):
    typed.last_of_equal_keys(spark)


def wanted(text):
    """The value of an answer, or None."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?(.*?)```", text, re.DOTALL)
    body = (fenced[1] if fenced else text).strip()
    braces = re.search(r"\{.*\}", body, re.DOTALL)
    for candidate in (body, braces and braces[0]):
        try:
            return json.loads(candidate or "")
        except ValueError:
            pass
    return None


ANSWERS = [
    '{"D1": ["神将", "帝君"], "D2": null, "D4": 1}', '{"a": 1} trailing', '{"a": 1}]', "{'a': 1}", '{"a": 1, "a": 2}', "[1, 2]", "3", "null", '"x"', '{"a": 01}', '{"a": "x\ny"}', '{"a":\t1}', '{"a": 1,}', "", None,
    "```json\n{\"a\": [true, null]}\n``` and {}", "```\n[1, 2\n```", "So: {\"a\": {\"b\": [1.5]}} it is", '{"a": 1} and {"a": 2}', "```json {\"a\": 1}", "```json```", "``````", "{}", "[]", ' 　{"a": 1} ', '{"a": 1}, {"b": 2}', '{"a": 1},0],[{"a": 1}',
]


def test_answers(spark):
    df = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, t string")
    for r in df.select("i", typed.kind(typed.typed_json(F.col("t"))).alias("kind"), F.to_json(typed.typed_json(F.col("t"))).alias("j")).collect():
        want = wanted(ANSWERS[r["i"]])
        assert r["kind"] == ("none" if want is None else "object" if isinstance(want, dict) else "array" if isinstance(want, list) else "scalar"), ANSWERS[r["i"]]
        assert want is None or json.loads(r["j"]) == want


def anything(rng, depth=0):
    kinds = ["text", "whole", "float", "word"] + (["list", "dict"] if depth < 3 else [])
    kind = rng.choice(kinds)
    if kind == "text":
        return "".join(rng.choice(["a", "神", "'", '"', "\\", "\n", "\t", " ", ",", ":", "{", "]", "é", "1"]) for _ in range(rng.randint(0, 6)))
    if kind == "whole":
        return rng.choice([0, 7, -3, 10**17, 10**25, rng.randrange(100)])
    if kind == "float":
        return rng.choice([1.5, -0.25, 1e20, 1.25e-7, 12345678.5, 0.0001, 99999999999.75, 1e16])
    if kind == "word":
        return rng.choice([True, False, None])
    if kind == "list":
        return [anything(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: anything(rng, depth + 1) for k in sorted(rng.sample(["a", "b", "c'"], rng.randint(0, 2)))}


def test_printed_like_python(spark):
    rng = random.Random(11)
    values = [anything(rng) for _ in range(600)] + [1.0, 250.0, "it's", 'say "x"', "both ' and \"", [], {}, "", 0, False]
    df = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(values)], "i int, t string")
    v = typed.field(typed.strict_json(F.col("t")), "v")
    for r in df.select("i", typed.printed(v).alias("p"), typed.text_of(v).alias("t"), typed.answered(v).alias("a"), typed.shown(v).alias("s")).collect():
        want = values[r["i"]]
        first = (want[0] if want else "") if isinstance(want, list) else want
        assert r["p"] == repr(want)
        assert r["t"] == (None if want is None else str(want))
        assert r["a"] == ("" if first is None else str(first))
        assert r["s"] == str(want or "")


def brute_row(text):
    """Labels, reasons and errors of an answer by plain rules over Python values."""
    data = wanted(text)
    ok = isinstance(data, dict) and bool(data)
    errors = ["no_data"] if not ok else [f"{d}={data.get(d, '')!r}" for d in ("D1", "D2", "D3", "D4", "D5") if data.get(d, "") not in V.LABELS[d]]
    missing = ["not_dict"] if not ok else [k for k in ("D1", "D2", "D3", "D4", "D5", "confidence") if k not in data]
    return ok, data, "; ".join(missing + errors)


def test_typed_gate(spark):
    d1, d4 = V.LABELS["D1"], V.LABELS["D4"]
    texts = [
        json.dumps({"D1": ["神将", "帝君"], "D2": None, "D4": 1}, ensure_ascii=False),
        json.dumps({"D1": d1[0], "D2": "N/A", "D3": "N/A", "D4": d4[0], "D5": V.LABELS["D5"][0], "confidence": 0.5}, ensure_ascii=False),
        json.dumps({"D1": 4, "D2": [], "D3": [["x"]], "D4": 0, "D5": True, "confidence": None}),
        json.dumps({"D1": "it's", "D2": 1.5, "D3": {"a": 1}, "D4": "1", "D5": ""}),
        "{}", "[1]", "no answer", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("fields", typed.typed_json(F.col("t"))).withColumn("kind", typed.kind(F.col("fields")))
    got = {r["i"]: r for r in gate.assemble_rows(df).drop("fields").collect()}
    for i, text in enumerate(texts):
        ok, data, errors = brute_row(text)
        assert got[i]["raw_errors"] == errors
        assert got[i]["raw_schema_ok"] == (ok and "confidence" in data and "D3" in data)
    assert got[0]["D1"] == "神将" and got[0]["D2"] == V.DEFAULTS["D2"] and got[0]["D4"] == "轻微损伤"
    assert got[2]["D1"] == "神将" and got[2]["D4"] == "完好" and got[2]["D2"] == V.DEFAULTS["D2"]
    assert "fallback: raw='1.5' not in vocab" in got[3]["fallback_reason"] and "fallback: raw='{'a': 1}'" in got[3]["fallback_reason"]
    assert got[1]["gate_pass"] and not got[0]["gate_pass"]


def test_typed_damage_gate(spark):
    text = json.dumps({"P1": [V.LABELS["P1"][0]], "P2": V.LABELS["P2"][0], "P3": None, "P4": "?", "severity": 2, "area": 10, "confidence": 0.5}, ensure_ascii=False)
    df = spark.createDataFrame([(text,)], "t string").select(typed.typed_json(F.col("t")).alias("fields"), F.lit("object").alias("kind"))
    (r,) = gate.assemble_damage_rows(df).drop("fields").collect()
    assert r["P1"] == V.LABELS["P1"][0] and r["area"] == "10" and r["confidence"] == "0.5" and r["severity"] == "2"
    assert r["raw_errors"] == f"P1={[V.LABELS['P1'][0]]!r}; P3=None; P4='?'; severity=2"


def test_typed_plan_has_no_python(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(typed.typed_json(F.col("t")).alias("fields"), F.lit("object").alias("kind"))
    plan = gate.assemble_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_reason_shows_the_list(spark):
    df = spark.createDataFrame([('{"D1": ["神将", "帝君"]}',)], "t string")
    v = typed.field(typed.typed_json(F.col("t")), "D1")
    (r,) = labels.with_labels(df, {"D1": typed.answered(v)}, shown={"D1": typed.shown(v)}).collect()
    assert r["D1"] == "神将" and r["D1_reason"] == "mapped: '['神将', '帝君']'→'神将'"
