import os
import random
import re
import sys

import duckdb
import pytest

import corpus_pipeline
from raterlake.llm import queries
from raterlake.llm.tokenizer import encoder

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_pairs import brute_repeats, least_reachable, shingle_set

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(12)
    docs = {k: words(rng, 150) + "." for k in range(300)}
    passage, item = words(rng, 70), words(rng, 30)
    docs[301] = docs[5]
    docs[302] = docs[6].replace(" ", "  ")
    docs[303] = " ".join(docs[7].split()[:-2] + ["changed", "end."])
    docs[310], docs[311] = (words(rng, 60) + " " + passage + " " + words(rng, 60) for _ in range(2))
    docs[320] = words(rng, 80) + " " + item.upper() + " " + words(rng, 80)
    bad = {k: " ".join(w.upper() + "!!" for w in words(rng, 120).split()) for k in range(400, 500)}
    rows = [(k, t, "en", "s", len(t)) for k, t in {**docs, **bad}.items()] + [(600, None, None, None, None), (None, words(rng, 100) + ".", "en", "s", 1), (601, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 300)] + [(k, 0, 0) for k in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, bad, passage


def test_stages(spark, tables):
    sf, docs, bad, passage = tables
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = df.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == columns
        seen[name] = {r["doc_id"]: r for r in df.collect()}
    kept = {k for k in seen["quality"] if k is not None and k < 600}
    assert not kept & set(bad) and kept == set(docs)
    assert set(docs) - set(seen["near_dedup"]) == {301, 302, 303} and None in seen["near_dedup"]
    assert spark.read.parquet(f"{sf}/documents.parquet").columns == columns
    cut = seen["repeated_passages"]
    assert passage in cut[310]["text"] and passage not in cut[311]["text"] and cut[311]["n_chars"] == len(cut[311]["text"])
    assert all(cut[k]["text"] == docs[k] for k in range(300))
    assert set(cut) - set(seen["decontamination"]) == {320}
    # each stage against brute force on its own input
    full = lambda part: {k: r["text"] or "" for k, r in part.items() if k is not None}
    texts = full(seen["quality"]) | {10**6: r["text"] for k, r in seen["quality"].items() if k is None}
    sets = {k: shingle_set(t, 5) for k, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = least_reachable(texts, links)
    assert {10**6 if k is None else k for k in seen["near_dedup"]} == {k for k in texts if least[k] == k}
    left = {k: texts[k] for k in texts if least[k] == k}
    gone = {k: v[3].decode() for k, v in brute_repeats(list(left.items()), 50, "words").items()}
    assert full(cut) == {k: t for k, t in gone.items() if k != 10**6 and (t.split() or t == left[k])}
    item = set(shingle_set(spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"], 5))
    plain = {k: shingle_set(re.sub("[^a-z0-9]+", " ", t.lower()), 5) for k, t in full(cut).items()}
    assert full(seen["decontamination"]).keys() == {k for k, s in plain.items() if 100 * len(item & s) < 80 * len(item)}
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf).toPandas()
    encode = encoder()
    assert {r.doc_id: r.doc_tokens for r in packed.itertuples() if r.doc_id == r.doc_id} == {k: len(encode(t or "")) + 1 for k, t in full(seen["decontamination"]).items()}
    assert set(packed.doc_id.dropna().astype(int)) == {k for k in seen["decontamination"] if k is not None}


def test_rows_without_an_id_of_their_own(spark, tables):
    """Rows that share an id or have none are judged by their contents: copies and leaks go, different texts stay, columns of any kind stand beside."""
    sf, docs, _, passage = tables
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rng = random.Random(14)
    a, b, c = (words(rng, 90) for _ in range(3))
    rows = [(1, a), (2, b), (2, c), (2, c), (None, a), (None, words(rng, 60) + " " + item), (None, words(rng, 40)), (None, words(rng, 60) + " " + passage), (3, words(rng, 60) + " " + passage), (None, None)]
    df = spark.createDataFrame([(i, t, {"k": t or ""}, len(t or "")) for i, t in rows], "doc_id long, text string, key map<string,string>, n_chars long")
    near = corpus_pipeline.near_dedup(spark, df, sf)
    assert near.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert sorted(i or 0 for i, _ in left) == [0, 0, 0, 0, 1, 2, 2, 3] and (None, a) not in left and {(2, b), (2, c)} < set(left)
    cut = {(r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_passages(spark, near, sf).collect()}
    assert sum(passage in (t or "") for _, t in cut) == 1 and any(i == 3 and passage in t for i, t in cut)
    clean = corpus_pipeline.decontamination(spark, near, sf).collect()
    assert len(clean) == 7 and not any(item in (r["text"] or "") for r in clean)


def test_empty_table(spark, tables):
    df = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, tables[0]).collect() == []


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 250


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_registered(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    """The queries give the rows that their SQL gives."""
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = c.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == columns and rows(got) == rows(want)
