"""Fingerprints, Merkle manifests and collocations: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlake.llm import fingerprints as fp
from raterlake.llm import merkle, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# fingerprints


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def prints(spark, rows, more=""):
    return fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_fingerprints_next_and_edits(spark, monkeypatch):
    """Next documents over many ranges, nulls, ties and repeated rows, by a plain sort."""
    monkeypatch.setattr(fp, "LEAST_ROWS", 5)
    rng = random.Random(1)
    rows = [(i * 7 - 50, words(rng, rng.choice([0, 1, 3, 4, 5, 6, 40, 700]))) for i in range(60)]
    rows += [(None, "no id"), (None, None), (3, "tie b"), (3, "tie a"), (rows[9]), (rows[9]), (8, "é" * 9 + "日本語"), (10**15, None), (11, "abc")]
    got = prints(spark, rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        want.append((i, len(t), sha(edited)))
        near = next(r for r in got if (r["doc_id"], r["n_chars"], r["edited_sha256"]) == want[-1])
        assert abs(near["near_edited"] - jaccard(shingle_set(t), shingle_set(edited))) < 0.15
    key = lambda r: (r[0] is not None, r)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert key


def test_fingerprints_small_tables(spark):
    assert prints(spark, []) == []
    (one,) = prints(spark, [(5, "a b c d e f g h")])
    assert one["near_next"] == 1.0 and one["edited_sha256"] == sha("a b c d e f a b")[:0] + sha("a b c d e f" + "a b c d e f g h"[:0])[:0] + sha("a b c d e f g h"[:12] + "a b")
    (none,) = prints(spark, [(None, None)])
    assert none["fingerprint"] == fp.NOTHING and none["near_edited"] == none["near_next"] == 1.0 and none["n_chars"] == 0


def test_fingerprints_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "y", 2)], "doc_id long, text string, fingerprint string, _range int")
    assert sorted(r["doc_id"] for r in fp.fingerprints(df).collect()) == [1, 2]


def reference_print(hashes):
    """The same method in plain loops, from the shingle hashes."""
    rest, full = fp._REST, {}
    for h in hashes:
        b = (h >> rest) + fp.BINS // 2
        full[b] = min(full.get(b, h), h)
    return full


def test_minima_and_densification(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(-(2**63), 2**63) for _ in range(n)],) for n in (1, 2, 40, 300, 3000)]
    df = spark.createDataFrame(rows, "h array<long>")
    low = (1 << fp._REST) - 1
    for r in df.select("h", fp.bin_minima(F.col("h")).alias("m"), fp.densified(fp.bin_minima(F.col("h"))).alias("d")).collect():
        full = reference_print(r["h"])
        assert len(r["m"]) == len(r["d"]) == fp.BINS
        for b, (m, d) in enumerate(zip(r["m"], r["d"], strict=True)):
            assert m == full.get(b, (b - fp.BINS // 2) << fp._REST | low)
            assert d == m if b in full else d in full.values()
        if len(full) > 20:  # empty bins draw on their own
            borrowed = [d for b, d in enumerate(r["d"]) if b not in full]
            assert len(set(borrowed)) >= min(len(full), len(borrowed)) // 2


def test_likeness_unbiased(spark):
    """Pairs of known similarity: the mean error is small at every similarity, also with few shingles."""
    rng = random.Random(3)
    for size in (4, 30, 400):
        rows = []
        for _ in range(150):
            shared = rng.randint(0, size)
            pool = [rng.randrange(-(2**63), 2**63) for _ in range(2 * size - shared)]
            rows.append((pool[:size], pool[size - shared :], shared / (2 * size - shared)))
        df = spark.createDataFrame(rows, "a array<long>, b array<long>, j double")
        of = lambda c: fp.packed(fp.densified(fp.bin_minima(F.col(c))))
        err = np.array([r["e"] for r in df.select((fp.likeness(of("a"), of("b")) - F.col("j")).alias("e")).collect()])
        assert abs(err.mean()) < 0.015 and err.std() < (0.12 if size == 4 else 0.05)


def test_fingerprint_of_equal_texts(spark):
    df = spark.createDataFrame([("A b  c d e f",), ("a b c d e f",), ("a b c d e g",), ("one",), ("two",), (" ",), (None,)], "t string")
    a, b, c, one, two, blank, null = (r[0] for r in df.select(fp.fingerprint(F.col("t"))).collect())
    assert a == b != c and blank == null == fp.NOTHING and {len(x) for x in (a, c, one, two, blank)} == {len(fp.NOTHING)}
    pairs = spark.createDataFrame([(one, two), (one, blank), (one, one), (one, None)], "a string, b string")
    got = [r[0] for r in pairs.select(fp.likeness(F.col("a"), F.col("b"))).collect()]
    assert got[0] < 0.1 and got[1:] == [0.0, 1.0, None]


def test_fingerprints_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    plan = fp.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# Merkle manifests


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        start = at - at % 3
        path.append(("".join(level[start:at]), "".join(level[at + 1 : start + 3])))
        at //= 3
    return path


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 28, 80, 81, 82, 200, 243, 244, 729])
@pytest.mark.parametrize("tier", [1, 2, 4])
def test_fractal_traversal(n, tier):
    leaves = [sha(str(i)) for i in range(n)]
    levels = levels_of(leaves)
    assert merkle.top(leaves, merkle.height(n)) == levels[-1][0]
    for at, path in enumerate(merkle.traverse(leaves, merkle.height(n), tier)):
        assert path == path_of(levels, at) and merkle.fold(leaves[at], path) == levels[-1][0]
    assert at == n - 1


def test_traversal_of_a_last_block():
    """A block beside others goes up all levels, in runs of one where it has no more."""
    (path,) = merkle.traverse([sha("x")], merkle.LEVELS)
    assert path == [("", "")] * merkle.LEVELS


def manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: sha(*map(enc, (i, s, lang, n, t)))
    held = lambda r: (r[0], r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1], *r[2:])
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels_of([leaf(*r) for r in by[s]])
    upper = levels_of([trees[s][-1][0] for s in names])
    root, out = upper[-1][0], []
    for k, s in enumerate(names):
        for at, r in enumerate(by[s]):
            path = path_of(trees[s], at) + path_of(upper, k)
            folded = merkle.fold(leaf(*held(r)), path)
            out.append((r[0], leaf(*r), trees[s][-1][0], root, sha(*(x for pair in path for x in pair)), folded, folded == root))
    return out


def proofs(spark, rows, more=None):
    df = spark.createDataFrame(rows, DOCS)
    df = more(df) if more else df
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return [tuple(r) for r in merkle.merkle_manifest(df, held=tampered).collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_manifest(spark):
    """A source of several blocks, small ones, nulls, repeated ids and rows, odd names."""
    rng = random.Random(4)
    rows = [(i, f"line {i}\nnext" if i % 3 else f"plain {i}", "en", "big", i) for i in range(2000)]
    rows += [(2000 + i, rng.choice([None, "", "a\nb", "é\n"]), rng.choice([None, "de"]), rng.choice([None, "", "-", "=", "é", "zz", "one"]), rng.choice([None, 3])) for i in range(60)]
    rows += [(None, "a\nb", None, None, None), (None, None, None, "big", None), (7, "other", "en", "big", 1), (9, "same\n", "en", "big", 1), (9, "same\n", "en", "big", 1), (3000, "lone", "en", "alone", 4)]
    rng.shuffle(rows)
    got = proofs(spark, rows, lambda df: df.withColumns({"g": F.lit(1), "idx": F.lit("x"), "leaf": F.lit(None).cast("string"), "n": F.lit(0)}))
    assert in_order(got) == in_order(manifest(rows))
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_and_none(spark):
    assert proofs(spark, []) == []
    rows = [(4, "t", None, "s", 1)]
    assert proofs(spark, rows) == manifest(rows)
    (only,) = proofs(spark, rows)
    assert only[1] == only[2] == only[3] and only[4] == sha() and only[6]


def test_manifest_of_many_sources(spark):
    """More sources than a block of the upper tree holds."""
    rows = [(i, "t", "en", f"s{i % 800}", i) for i in range(1600)]
    assert in_order(proofs(spark, rows)) == in_order(manifest(rows))


# collocations


def brute_phrases(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {g: c for g, c in f.items() if len(g[1]) > 1 and c >= least}
    out = []
    for (lang, w), a in found.items():
        if any(lang == other and len(v) > len(w) and 100 * c >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (other, v), c in found.items()):
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


def odd_texts(rng):
    gaps = [" ", " ", " ", " ", "  ", "\t", " \t ", ", ", ".", "\n", " ! ", "\r\n", "\x0b", " ; "]
    rows = []
    for _ in range(250):
        text = "".join(rng.choice(["New", "york", "city", "Hall", "the", "of", "a-b", "é", "日本", "É", "x'", "\x00"]) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 2, 5, 30, 60])))
        rows.append((rng.choice(["en", "de", None, "und", "日"]), rng.choice([text, " " + text, text.strip(), "\t" + text])))
    return [*rows, ("en", None), (None, ""), ("fr", "new york " * 3000), ("fr", ". . ,"), *[("de", "New York City Hall")] * 40]


@pytest.mark.parametrize("bits", [16, 8, 3])
def test_collocations(spark, bits):
    """Also with sketches so narrow that they rule out nearly nothing."""
    rows = odd_texts(random.Random(5))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, phrase int, k int").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=8, bits=bits).collect())
    assert got == brute_phrases(rows, 8) and len(got) > 15


def test_collocations_top_and_ties(spark):
    rows = odd_texts(random.Random(6))
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(df, least=5, top=7).collect())
    assert got == brute_phrases(rows, 5, 7)


def test_collocations_least_above_a_cell(spark):
    rows = [("en", "a b c " * 300), ("en", "d e " * 200)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df, least=280).collect()) == brute_phrases(rows, 280)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "one two")], [("en", " .,\n")]])
def test_collocations_of_nothing(spark, rows):
    assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_sketches_lose_nothing(spark):
    """Every n-gram that stands often enough is counted, and only few others get to the exact count."""
    rng = random.Random(7)
    rows = [("en", words(rng, 400, 2000)) for _ in range(60)] + [("en", "alpha beta gamma delta")] * 30
    grams, totals = phrases.frequent_ngrams(spark.createDataFrame(rows, "lang string, text string"), 30)
    want = Counter()
    for _, t in rows:
        w = t.split()
        for k in range(1, 5):
            want.update((k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    assert {(r["k"], r["phrase"]): r["f"] for r in grams.collect()} == {g: c for g, c in want.items() if c >= 30}
    assert [tuple(r) for r in totals.collect()] == [("en", 60 * 400 + 120)]


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    cases = [(a, both) for a in (1, 30, 7 * 10**12, 9 * 10**18 // 2 - 1) for both in (2 * a, 2 * a + 1, 3 * a + 7) if both < 2**63]
    df = spark.createDataFrame(cases, "a long, b long")
    for r in df.select("a", "b", phrases.cohesion(F.col("a"), F.col("b")).alias("s"), phrases.covers(F.col("a"), F.col("b")).alias("c")).collect():
        assert r["s"] == 2000000 * r["a"] // r["b"] and r["c"] == (100 * r["a"] >= 80 * r["b"])
