"""Near duplicates, repeated passages, vectors, components: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlake.llm import covertree, repeats
from raterlake.llm.components import connected_components
from raterlake.llm.covertree import linked_vectors
from raterlake.llm.neardup import near_duplicates
from raterlake.llm.repeats import remove_repeats


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def text(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def corpus(seed=3):
    """Copies, near copies around a base, chains, short and odd texts."""
    rng, out = random.Random(seed), []
    base = text(rng, 120)
    for _ in range(40):  # near copies of one text, the text itself in their midst
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    out.insert(17, " ".join(base))
    chain = text(rng, 80)
    for _ in range(12):  # each like the one before
        chain = list(chain)
        chain[rng.randrange(80)] = f"y{rng.randrange(10**6)}"
        chain[rng.randrange(80)] = f"y{rng.randrange(10**6)}"
        out.append(" ".join(chain))
    out += [" ".join(base).upper(), "\t".join(base), "", None, "   ", "one", "ONE", "one two", "é", "é", " ".join(["a"] * 5000)] + [" ".join(text(rng, rng.randint(3, 200))) for _ in range(60)]
    out += [out[-1]] * 9
    rng.shuffle(out)
    return list(enumerate(out, start=5))


def shingle_set(t, n):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rows = corpus()
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: r for r in near_duplicates(df, shingle=n).collect()}
    sets = {i: shingle_set(t, n) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = least_reachable(ids, links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Many blocks a bucket; groups of over three rows joined by a broadcast; a large component with strangers, and a family of texts that are all unlinked."""
    monkeypatch.setattr("raterlake.llm.neardup.BLOCK", 7)
    monkeypatch.setattr("raterlake.llm.neardup.SKETCHES", 5)
    monkeypatch.setattr("raterlake.llm.store.HEAVY_ROWS", 3)
    rng = random.Random(41)
    base = text(rng, 150)
    rows = corpus(5)
    for k in range(80):  # 15 to 20 words changed: unlike each other, some like the base
        own = list(base)
        for _ in range(rng.randint(1, 20)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(own)))
    sets = {i: shingle_set(t, 2) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == least_reachable(ids, links)


def test_near_duplicates_odd_rows(spark):
    """Rows without an id link with nothing and are kept; rows that repeat an id each stand; other columns don't matter."""
    t = " ".join(text(random.Random(2), 50))
    rows = [(None, t, 1), (None, t, 1), (3, t, 1), (3, t, 2), (5, t, 1), (6, None, 1), (7, "", 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id int, text string, kept int")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False), (6, 6, True), (7, 7, True)]


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_shingles"], r["kept"]) for r in near_duplicates(only).collect()} == {(1, 0, True), (2, 0, True)}


def brute_repeats(rows, length, unit):
    seen, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        if unit == "bytes":
            tokens, places = list(raw), [(k, k + 1) for k in range(len(raw))]
        else:
            tokens, places, at = [], [], 0
            for w in raw.split():
                at = raw.index(w, at)
                tokens.append(w)
                places.append((at, at + len(w)))
                at += len(w)
        gone = [False] * len(tokens)
        for s in range(len(tokens) - length + 1):
            if seen.setdefault(tuple(tokens[s : s + length]), i) < i:
                gone[s : s + length] = [True] * length
        keep, spans, k = bytearray(b"\1" * len(raw)), [], 0
        while k < len(tokens):
            if gone[k]:
                e = k
                while e + 1 < len(tokens) and gone[e + 1]:
                    e += 1
                spans.append((places[k][0], places[e][1]))
                keep[spans[-1][0] : spans[-1][1]] = bytes(spans[-1][1] - spans[-1][0])
                k = e
            k += 1
        out[i] = (len(raw), len(raw) - sum(keep), len(spans), bytes(b for b, m in zip(raw, keep, strict=True) if m))
    return out


@pytest.mark.parametrize(("length", "unit"), [(50, "bytes"), (51, "bytes"), (17, "words")])
def test_repeats(spark, length, unit, monkeypatch):
    rng = random.Random(length)
    shared = " ".join(text(rng, 60))
    rows = corpus(9) + [(1000 + k, " ".join(text(rng, rng.randint(0, 40))) + " " + shared[rng.randint(0, 80) :] + " " + " ".join(text(rng, 30))) for k in range(25)]
    rows += [(2000, "a" * 400), (2001, "b" + "a" * 300), (2002, shared * 3), (2003, "é" * 60), (2004, "x" + "é" * 40)]
    df = spark.createDataFrame([(t, "k", i) for i, t in rows], "text string, spans string, doc_id long")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in remove_repeats(df, length, unit).collect()}
    assert got == brute_repeats(rows, length, unit)


@pytest.mark.parametrize(("length", "unit", "runs"), [(50, "bytes", 1), (50, "bytes", 12), (20, "words", 1)])
def test_repeats_with_hot_anchors(spark, length, unit, runs, monkeypatch):
    """All anchors hot, or those of some runs: the same result, and no group of an anchor in one task."""
    for name, value in (("SAMPLE", 1), ("HOT_SHARE", 10**9), ("HOT_RUNS", runs)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(77)
    shared = " ".join(text(rng, 60))
    rows = corpus(9) + [(1000 + k, " ".join(text(rng, rng.randint(0, 40))) + " " + shared[rng.randint(0, 80) :] + " " + " ".join(text(rng, 30))) for k in range(25)]
    common = "a very common anchor here "
    rows += [(3000 + k, " ".join(text(rng, 9)) + " " + rng.choice(["left side of it ", "another side it has ", ""]) + common + rng.choice(["with words that follow ", "", "and more of the same kind "]) + " ".join(text(rng, 9))) for k in range(60)]
    rows += [(2000, "a" * 400), (2001, "b" + "a" * 300), (2002, shared * 3)]
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    hot = repeats.hot_anchors(df.select(F.col("doc_id").alias("id"), "text").where("text is not null"), length, unit)
    assert len(hot) > (100 if runs == 1 else 3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in remove_repeats(df, length, unit).collect()}
    assert got == brute_repeats(rows, length, unit)


def test_repeats_streams_groups_over_batches(spark):
    """The carried state: the same rows in batches of any size."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 400
    cols = [np.sort(rng.integers(0, 40, n)), rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, 6, n), np.arange(n) << 16 | 60]
    cols[4][::17] = ~cols[4][::17]
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    names = ["anchor", "span", "marks", "id", "at"]

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[s : s + size]) for c in cols], names=names) for s in range(0, n, size)]
        out = pa.Table.from_batches(list(repeats._owners(iter(batches)))).to_pylist()
        return {(r["id"], r["at"]) for r in out if not r["open"]}, {(r["id"], r["at"]) for r in out if r["open"]}

    whole = run(n)
    for size in (1, 2, 7, 50):
        removed, opened = run(size)
        assert removed == whole[0] and opened >= whole[1]


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_repeats_with_colliding_digits(unit, monkeypatch):
    """With four bits of the first hash and six of the second, few texts and no Spark: no false repeat, none missed."""
    from itertools import islice

    import pyarrow as pa
    from raterlake.llm import kernels as K

    whole = K.span_hash
    rng = random.Random(31)
    length = 20
    shared = [" ".join(text(rng, 30)) for _ in range(3)]
    rows = [(k, " ".join(text(rng, rng.randint(0, 40)) + [rng.choice(shared)] * (k % 3 > 0) + text(rng, rng.randint(0, 40)))) for k in range(40)]
    rows += [(100 + k, "q" * 30 + "".join(rng.choice("ab") for _ in range(40))) for k in range(60)]
    want = brute_repeats(rows, length, unit)

    def removed():
        def batches(data, names):
            it = iter(data)
            while part := list(islice(it, 37)):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part]) for c in range(len(names))], names=names)

        def ordered(out, keys):
            t = pa.Table.from_batches(out)
            t = t.sort_by([(k, "ascending") for k in keys])
            return iter(t.to_batches(max_chunksize=23))

        runs = list(repeats._run_rows(length, unit)(batches(rows, ["id", "text"])))
        found = pa.Table.from_batches(list(repeats._owners(ordered(runs, ["anchor", "span", "marks", "id"])))).to_pylist()
        open_ = {}
        for r in found:
            if r["open"]:
                open_.setdefault(r["id"], []).append(r["at"])
        texts = dict(rows)
        deeper = pa.RecordBatch.from_arrays([pa.array(list(open_)), pa.array([texts[i] for i in open_]), pa.array(list(open_.values()), pa.list_(pa.int64()))], names=["id", "text", "runs"])
        windows = list(repeats._window_rows(length, unit)(iter([deeper]))) if open_ else []
        last = pa.Table.from_batches(list(repeats._later_windows(length)(ordered(windows, ["window", "check", "id"])))).to_pylist() if windows else []
        lists = {}
        for r in [r for r in found if not r["open"]] + last:
            lists.setdefault(r["id"], []).append(r["at"])
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), pa.array([lists.get(i) for i, _ in rows], pa.list_(pa.int64()))], names=["t", "runs"])
        cut = pa.Table.from_batches(list(repeats._cut(length, unit, 0)(iter([batch])))).to_pylist()
        return {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_bytes"]) for (i, _), r in zip(rows, cut, strict=True)}

    assert removed() == want
    if unit == "words":  # the words themselves are told apart by that hash
        return
    few = lambda total, a, b, second=False: whole(total, a, b, second) if second else whole(total, a, b) & np.uint64(0xF << 60)
    monkeypatch.setattr(K, "span_hash", few)
    assert removed() == want


def test_repeats_odd_rows(spark):
    df = spark.createDataFrame([(None, "z" * 80), (1, "z" * 80), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(df, 50, "bytes").collect()}
    assert got == {None: 0, 1: 0, 2: 0}
    assert remove_repeats(df.limit(0), 50, "bytes").collect() == []
    twice = spark.createDataFrame([(1, "z" * 80), (2, "z" * 80), (2, "y" * 80), (3, "z" * 80), (3, "z" * 80), (4, "z" * 30), (5, "z" * 30)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"][0], r["n_removed"]) for r in remove_repeats(twice, 50, "bytes").collect())
    assert [g for g in got if g[0] != 2] == [(1, "z", 0), (3, "z", 80), (3, "z", 80), (4, "z", 0), (5, "z", 0)]
    with pytest.raises(ValueError):
        remove_repeats(df, 5, "bytes")


def brute_links(ids, x, cosine):
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    u = np.where(ok[:, None], x / np.where(ok, norm, 1)[:, None], 0)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    linked = (g >= cosine) & ok[:, None] & ok[None, :]
    return linked.sum(1), least_reachable(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)])


@pytest.mark.parametrize(("dim", "block"), [(2, 60), (5, 4096), (24, 40)])
def test_vectors(spark, monkeypatch, dim, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(25, dim))
    x = np.concatenate([c + rng.normal(size=(8, dim)) * s for c, s in zip(centres, rng.choice([0.003, 0.03, 0.2], 25), strict=True)])
    x = np.concatenate([x, x[:30], np.zeros((2, dim)), x[:5] * 1e-3])
    ids = list(range(3, 3 + len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in linked_vectors(df).collect()}
    n, least = brute_links(ids, x, 0.95)
    assert [got[i]["n_links"] for i in ids] == n.tolist()
    assert {i: r["component_id"] for i, r in got.items()} == least


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0]), (9, [1.0]), (10, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in linked_vectors(df).collect()}
    for i in (1, 2, 9, 10):
        assert got[i] == (3, 1, i == 1)
    for i in (3, 4, 5, 6, 7, 8):
        assert got[i] == (0, i, True)
    more = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.1], 1), (6, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, n_links int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in linked_vectors(more).collect())
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (4, 1, 4, True), (4, 1, 4, True), (6, 0, 6, True)]
    assert linked_vectors(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 130 + k) for k in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == least_reachable(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("few", [100_000, 70])
def test_components_of_few_links_and_of_more(spark, monkeypatch, few):
    """Few links take two jobs or so (over twenty in rounds); beyond ``FEW`` they go in rounds, with the same result."""
    from raterlake.llm import components

    monkeypatch.setattr(components, "FEW", few, raising=False)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    context = spark.sparkContext
    context.setJobGroup(f"few{few}", "links")
    try:
        got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    finally:
        jobs = len(context.statusTracker().getJobIdsForGroup(f"few{few}"))
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == least_reachable({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert jobs <= 6 if few > 100 else jobs > 10


def test_digest(spark):
    df = spark.createDataFrame([(1, "q" * 70), (2, "q" * 70 + "r")], "doc_id long, text string")
    out = remove_repeats(df, 50, "bytes").select("doc_id", F.sha2("kept_bytes", 256).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in out} == {1: hashlib.sha256(b"q" * 70).hexdigest(), 2: hashlib.sha256(b"r").hexdigest()}


@pytest.mark.parametrize(("length", "unit"), [(50, "bytes"), (50, "words"), (17, "bytes")])
def test_repeats_runs_of_one_short_text(length, unit):
    """A short text may be alone in its batch, whatever its size."""
    import pyarrow as pa

    for n in range(61):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["q" * n if unit == "bytes" else "w " * n])], names=["id", "text"])
        assert sum(b.num_rows for b in repeats._run_rows(length, unit)(iter([batch]))) == (n >= length)


def test_anchors_of_too_few_values():
    from raterlake.llm import kernels as K

    for n in range(60):
        first, last, anchor = K.anchors(np.arange(n, dtype=np.uint64) << np.uint64(32), np.ones(n, bool), 35)
        assert first.tolist() == list(range(max(0, n - 34))) and (first == last).all() and (first == anchor).all()


def test_repeats_tell_many_runs_of_one_anchor_apart():
    """As many different runs around one frequent phrase as make 32-bit digits collide."""
    import pyarrow as pa
    from raterlake.llm import kernels as K

    rng, n = np.random.default_rng(5), 300_000
    tries = rng.integers(97, 123, 16 * 200_000, dtype=np.uint8)
    at = np.arange(0, len(tries), 16)
    least = at[np.argmin(K.span_hash(K.prefix(tries), at, at + 16))]
    texts = np.concatenate([rng.integers(97, 123, (n, 17), dtype=np.uint8), np.tile(tries[least : least + 16], (n, 1)), rng.integers(97, 123, (n, 17), dtype=np.uint8)], axis=1)
    column = pa.array([t.tobytes().decode() for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), column], names=["id", "text"])
    rows = pa.Table.from_batches(list(repeats._run_rows(50, "bytes")(iter([batch])))).to_pandas()
    group = rows[rows.anchor == rows.anchor.mode()[0]]
    assert len(group) > 0.9 * n and group.span.nunique() == len(group)
    ordered = pa.RecordBatch.from_pandas(group.sort_values(["anchor", "span", "marks", "id"]), preserve_index=False)
    assert not any(not o for b in repeats._owners(iter([ordered])) for o in b.column(2).to_pylist())


def test_blocks_by_bytes(spark, monkeypatch):
    """A few bytes a block: as many blocks as texts, and the same result."""
    from raterlake.llm import neardup

    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = sorted(map(tuple, near_duplicates(docs, shingle=2, percent=80).collect()))
    seen, across = [], neardup.across

    def counted(*args):
        out = across(*args)
        seen.append((args[1], out.agg(F.max("j")).first()[0]))
        return out

    monkeypatch.setattr(neardup, "across", counted)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 600)
    assert sorted(map(tuple, near_duplicates(docs, shingle=2, percent=80).collect())) == want
    assert all(most is None or most > 0 for group, most in seen if group == ["family"])


def test_groups_keep_all_batches():
    """Rows of a group that come in many batches, with texts, come out as one batch with 64-bit offsets."""
    import pyarrow as pa

    from raterlake.llm.neardup import grouped

    rows = [(k, f"text {i}" * 50) for k in (1, 2, 2, 3) for i in range(700)]
    batches = [pa.RecordBatch.from_pydict({"k": [k for k, _ in rows[i : i + 300]], "text": [t for _, t in rows[i : i + 300]]}) for i in range(0, len(rows), 300)]
    got = list(grouped(iter(batches), 1))
    assert [b.num_rows for b in got] == [700, 1400, 700] and all(b.schema.field("text").type == pa.large_string() for b in got)
    assert [t for b in got for t in b.column("text").to_pylist()] == [t for _, t in rows]
