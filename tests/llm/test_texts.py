"""Decontamination, packing, counts, HTML, and the trained models."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raterlake.llm import edits, html, packing
from raterlake.llm.decontam import leaked_items
from raterlake.llm.edits import TokenTree, apply_edits, redactions, token_trees
from raterlake.llm.html import extract_text, main_text
from raterlake.llm import langid
from raterlake.llm.langid import identify
from raterlake.llm.packing import CapacityTree, pack, plan
from raterlake.llm import pseudolm
from raterlake.llm.pseudolm import BATCH, CELLS, CLASSES, DIGITS, SHAPES, SIDES, WIDTH, WORDS, Network, Vocabulary, contexts, pseudo_likelihood
from raterlake.llm.quality import Machine, score_quality
from raterlake.llm.tokenizer import encoder


def words(rng, n, top=3000):
    return " ".join(f"w{rng.randrange(top)}" for _ in range(n))


def test_leaks(spark):
    rng = random.Random(2)
    items = [(k, words(rng, rng.randint(5, 60))) for k in range(30)] + [(90, "two words"), (91, ""), (92, None), (93, "!!"), (90, "two words"), (94, words(rng, 700))]
    docs = []
    for k in range(60):
        body = words(rng, rng.randint(0, 3000)).split()
        own = items[k % 30][1].split()
        if k % 3 == 0:
            own = [w.upper() + ("," if rng.random() < 0.3 else "") for w in own]
        if k % 5 == 0:
            own[len(own) // 2] = "changed"
        if k % 4:
            at = rng.randint(0, len(body))
            body[at:at] = own
        docs.append((k, " ".join(body)))
    docs += [(200, "some TWO words, here"), (201, None), (202, ""), (203, items[-1][1]), (204, items[3][1])]
    got = {(r["doc_id"], r["item_id"]): (r["n_item_shingles"], r["n_shared"]) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def split(t):
        return re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())

    want = {}
    for i, t in items:
        q = split(t)
        n = min(5, len(q))
        s = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
        for d, x in docs:
            w = split(x)
            both = len(s & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) if n else 0
            if s and 100 * both >= 80 * len(s):
                want[d, i] = (len(s), both)
    assert got == want and len(want) > 30
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), empty).collect() == []


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("raterlake.llm.decontam.BLOCK_SHINGLES", 40)
    rng = random.Random(4)
    items = [(k, words(rng, 20)) for k in range(12)]
    docs = [(k, words(rng, 50) + " " + t + " " + words(rng, 50)) for k, t in items]
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, _ in items}


def test_leaks_of_few_shingles():
    """Items of five and six words, within documents and at their ends, are all found."""
    from types import SimpleNamespace

    import pyarrow as pa
    from raterlake.llm import decontam

    rng = random.Random(17)
    items = [words(rng, 5 + k % 2, 10**6) for k in range(3000)]
    docs = [" ".join([words(rng, 40 * (k % 3), 10**6), t, words(rng, 40, 10**6)]) for k, t in enumerate(items)]
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    index = decontam._Index([r for b in decontam._item_sets(5)(iter([batch(items)])) for r in b.to_pylist()], 5)
    found = {(r["id"], r["item_id"], r["n_shared"]) for b in decontam._search(SimpleNamespace(value=index), 80)(iter([batch(docs)])) for r in b.to_pylist()}
    assert found == {(k, k, 1 + k % 2) for k in range(3000)}


def test_leaks_of_scattered_items():
    """Items in pieces of 25 words, hundreds or thousands of other words between: recall 1."""
    from types import SimpleNamespace

    import pyarrow as pa
    from raterlake.llm import decontam

    rng = random.Random(18)
    items, docs = [], []
    for k in range(120):
        own = words(rng, rng.randint(96, 1200), 10**6).split()
        gap = rng.choice([200, 1000, 5000])
        items.append(" ".join(own))
        docs.append(" ".join(" ".join(own[at : at + 25]) + " " + words(rng, gap, 10**6) for at in range(0, len(own), 25)))
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    index = decontam._Index([r for b in decontam._item_sets(5)(iter([batch(items)])) for r in b.to_pylist()], 5)
    found = {(r["id"], r["item_id"]) for b in decontam._search(SimpleNamespace(value=index), 80)(iter([batch(docs)])) for r in b.to_pylist()}
    want = set()
    for k, t in enumerate(items):
        w, d = t.split(), docs[k].split()
        s, whole = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}, {tuple(d[i : i + 5]) for i in range(len(d) - 4)}
        if 100 * len(s & whole) >= 80 * len(s):
            want.add((k, k))
    assert found == want and len(want) > 100


def test_leaks_odd_rows(spark):
    """Rows without an id, repeated rows, columns with the result's names."""
    t = "one two three four five six seven"
    docs = spark.createDataFrame([(None, t, 1), (None, t, 1), (4, t, 1), (4, t, 2), (5, "x", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, t, "z"), (1, t, "z"), (1, "other words that stand in none at all", "z"), (None, "two three four five six", "z")], "item_id long, text string, containment string")
    got = sorted(((r["doc_id"] or 0, r["item_id"] or 0, r["n_shared"]) for r in leaked_items(docs, items).collect()))
    assert got == [(0, 0, 1), (0, 1, 3), (4, 0, 1), (4, 1, 3)]


def best_fit(lengths, window):
    open_, out = [], 0
    for x in sorted(lengths, reverse=True):
        fits = [c for c in open_ if c >= x]
        if fits:
            open_.remove(min(fits))
            open_.append(min(fits) - x)
        else:
            out += 1
            open_.append(window - x)
    return out, sorted(open_)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(7)
    for window in (10, 64):
        lengths = [rng.randint(1, window) for _ in range(300)]
        rows = plan({x: lengths.count(x) for x in set(lengths)}, window)
        fill = {}
        for length, _, n, first, offset in rows:
            for s in range(first, first + n):
                assert fill.get(s, 0) == offset
                fill[s] = offset + length
        assert (len(fill), sorted(window - f for f in fill.values())) == best_fit(lengths, window)


def test_capacity_tree():
    tree = CapacityTree(20)
    assert tree.tightest(0) is None
    for c in (3, 9, 9, 20):
        tree.add(c, 1)
    assert [tree.tightest(x) for x in (0, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    tree.add(20, -1)
    assert tree.tightest(10) is None


def test_pack(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["", None, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "é " * 50, words(rng, 3000), "x" * 9000, " \n\t "] + [words(rng, rng.randint(1, 900)) for _ in range(40)] + ["same"] * 20
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, rank int")
    got = pack(df, 256).toPandas()
    for k, t in enumerate(texts):
        ids = exact.encode(t or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == k].sort_values("start")
        assert own.start.tolist() == np.concatenate([[0], own.length.cumsum()[:-1]]).tolist() and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    by = got.sort_values("offset").groupby("sequence_id")
    assert (by.length.sum() <= 256).all() and all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    assert set(got.sequence_id) == set(range(got.sequence_id.max() + 1))
    assert got.length.sum() / 256 / got.sequence_id.nunique() > 0.95
    assert pack(df.limit(0), 256).collect() == []
    twice = pack(spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")], "doc_id long, text string"), 256).toPandas()
    assert len(twice) == 4 and twice.groupby("sequence_id").offset.nunique().sum() == 4


def test_ids_are_those_of_the_library():
    """Some thousands of odd strings, the library's settings as they are."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, encode, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder(), random.Random(23)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "é", "e\u0301", "ﬁ", "漢字", "😀", "\x00", "'s", "'ll", "12", "½", "...", "the", " The", "_", "\ufeff", "\u200d", "A"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for t, e in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(t) == e.ids, t


def test_redact_is_edits_applied(spark):
    """One pass gives what trees and a table of edits give; odd rows and columns of any name."""
    rng = random.Random(61)
    parts = ["mail a.b@c.example", "+1 (456) 555-2186", "0123456789abcdef" * 2, "plain words", "<|endoftext|>", "é €"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 300]))) for _ in range(30)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, texts[3], "x", 1)] * 2, "doc_id long, text string, edits string, id int")
    columns = ["text", "n_tokens_before", "n_edits", "n_tokens", "n_chars_encoded"]
    own = sorted(((r["id"], *(r[c] for c in columns)) for r in edits.redact(docs).collect() if r["id"] is not None), key=str)
    table = sorted(((r["id"], *(r[c] for c in columns)) for r in apply_edits(token_trees(docs), redactions(docs)).where("id is not null").collect()), key=str)
    assert own == table and len(own) == 32 and sum(r[3] for r in own) > 100
    encode = encoder()
    assert all(r[4] == len(encode(r[1])) for r in own)
    assert edits.redact(docs).count() == 34 and edits.redact(docs.limit(0)).collect() == []


def test_mail_addresses_of_any_length(spark):
    docs = spark.createDataFrame([(1, "to " + "m" * 500 + "@mail.example now"), (2, "@x.y a@b @"), (3, "x" * 200_000)], "doc_id long, text string")
    assert [(r["id"], r["start"], r["stop"]) for r in redactions(docs).collect()] == [(1, 3, 3 + 500 + 13)]


def test_token_tree():
    encode = encoder()
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice(["foo", " bar", " ", "\n", "baz's", "12", " é", "  ", "!!", " the"]) for _ in range(rng.choice([0, 5, 400, 2000])))
        tree = TokenTree.of(t)
        assert "".join(tree.leaves) == t and tree.tokens[1] == len(encode(t))
        for _ in range(5):
            a = rng.randint(0, len(t) + 3)
            b, r = a + rng.choice([0, 1, 5, 700]), "".join(rng.choice("ab  \n\té's1,.!€") for _ in range(rng.choice([0, 1, 4, 2000])))
            tree.edit(a, b, r)
            a = min(a, len(t))
            t = t[:a] + r + t[max(a, min(b, len(t))) :]
            assert "".join(tree.leaves) == t and tree.tokens[1] == len(encode(t))


ODD = ["foo", " bar", " ", "\n", "baz's", "12", " é", "  ", "!!", " the", "\t", "a1b2", "x@y.zz", "漢字", "。", "、かな", "한글", "'ll", "<|endoftext|>", "<|", "|>", "\u00a0", "\x1c", "½", "_", "'"]


def test_pieces_end_pre_tokens(monkeypatch):
    """Leaves of a few characters, so that every sure place is tried."""
    monkeypatch.setattr(edits, "LEAF", 1)
    encode, rng, cuts = encoder(), random.Random(8), 0
    for _ in range(3000):
        t = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))
        leaves = edits.pieces(t)
        cuts += len(leaves)
        assert "".join(leaves) == t and sum(len(encode(x)) for x in leaves) == len(encode(t)), t
    assert cuts > 40_000


@pytest.mark.parametrize("leaf", [3, 40])
def test_sweeps_are_edits(monkeypatch, leaf):
    """Lists of edits in any order, as single edits and in sweeps."""
    monkeypatch.setattr(edits, "LEAF", leaf)
    encode, rng = encoder(), random.Random(9)
    for _ in range(400):
        t = "".join(rng.choice(ODD) for _ in range(rng.choice([0, 3, 60])))
        places = sorted((rng.randint(-2, len(t) + 3) for _ in range(2 * rng.randint(0, 6))), reverse=rng.random() < 0.8)
        given = [(min(a, b), max(a, b) if rng.random() < 0.9 else a - 1, "".join(rng.choice(ODD) for _ in range(rng.choice([0, 1, 1, 9])))) for a, b in zip(places[::2], places[1::2], strict=True)]
        tree = TokenTree.of(t)
        tree.edit_all(given)
        for a, b, r in given:
            a = max(0, min(a, len(t)))
            t = t[:a] + r + t[max(a, min(b, len(t))) :]
        assert "".join(tree.leaves) == t and tree.tokens[1] == len(encode(t)) and tree.chars[1] == len(t)


@pytest.mark.parametrize("line", ["person{}@mail.example\n", "cell {}\tperson{}@mail.example\t", "编号{}的说明写在这里，联系person{}@mail.example。"])
def test_many_edits_of_a_long_text(line):
    """A text of about a megabyte without single spaces: every edit's surroundings are encoded once."""
    t = "".join(line.format(i, i) for i in range(1_000_000 // len(line)))
    found = edits.masked(t)
    tree = TokenTree.of(t)
    assert len(found) > 10_000 and max(map(len, tree.leaves)) <= 2 * edits.LEAF + 64
    tree.edit_all(found)
    assert tree.encoded < 2 * len(t)
    one = TokenTree.of(t)
    one.edit(*found[100])
    assert 0 < one.encoded < 6 * edits.LEAF


def test_edits_touch_little():
    tree = TokenTree.of(words(random.Random(5), 20000))
    tree.edit(50_000, 50_003, "new")
    assert 0 < tree.encoded < 6 * edits.LEAF


def test_apply_edits(spark):
    encode = encoder()
    docs = spark.createDataFrame([(1, "Mail a.b@c.example now, call +1 (456) 555-2186 ok"), (2, None), (3, "plain"), (None, "x"), (3, "again")], "doc_id long, text string")
    out = apply_edits(token_trees(docs), redactions(docs)).collect()
    one = next(r for r in out if r["id"] == 1)
    assert one["text"] == "Mail <mail> now, call <number> ok" and one["n_edits"] == 2
    assert len(out) == 5 and all(r["n_tokens"] == len(encode(r["text"])) for r in out)
    given = spark.createDataFrame([(3, 1, -5, 2, "AB"), (3, 2, 100, 200, "!"), (3, 3, None, 1, "x"), (9, 1, 0, 0, "x"), (2, 1, 0, 0, None)], "id long, seq long, start long, stop long, replacement string")
    texts = sorted(r["text"] for r in apply_edits(token_trees(docs), given).where("id = 3").collect())
    assert texts == ["ABain!", "ABain!"]
    assert apply_edits(token_trees(docs.limit(0)), given).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><article>x";</script></head><body><header class="site">Top</header>
<nav><ul><li><a href="/a">A</a><li><a>B</a></ul></nav><div class="cookie-notice">We use</div>{body}<aside>side</aside><form><p>Mail</p></form><footer>&copy; f</footer></body>"""


def test_main_text():
    body = '<article><header><h1>Head &amp; &#233;</h1></header><p><b>One\n two<br>three.<p>Fo<i>ur</i></p><ul><li>a<li>b</ul><div class="ad-box">Buy</div><section id="comments"><p>nice</p></section></article>'
    assert main_text(PAGE.format(body=body), "", frozenset()) == "Head & é\nOne two three.\nFour\na\nb"
    assert main_text("", "", frozenset()) == ""
    assert main_text("<p>a < b && c", "", frozenset()) == "a < b && c"
    assert main_text("<article>x<script>y", "", frozenset()) == "x"
    assert main_text("<div>a<!-- b --></div>c", "", frozenset()) == "a\nc"


def test_template_deduction(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(30):
        lines = [words(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 5))]
        want[k] = "\n".join(lines)
        body = '<div class="frame"><div class="box">Read our terms</div><div class="story">' + "".join(f"<p>{x}</p>" for x in lines) + "</div></div>"
        rows.append((k, f"https://h{k % 2}.example/{k}", PAGE.format(body=body)))
    rows += [(100, None, None), (101, "https://h0.example/x", ""), (102, "odd", "<p>only</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(df).collect()}
    assert {k: got[k][0] for k in want} == want and got[100] == ("", 0) and got[101] == ("", 0) and got[102] == ("only", 4)
    assert extract_text(df.limit(0)).collect() == []


def test_template_decides_on_marked_pages(spark):
    rng = random.Random(16)
    rows, want = [], {}
    for k in range(40):  # a host of marked pages, and one with a single marked page
        lines = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        want[k] = "\n".join(lines)
        story = "".join(f"<p>{x}</p>" for x in lines)
        inner = f'<article><div class="box">Read our terms</div>{story}</article>' if k % 2 else f'<div class="box">Read our terms</div><div class="story">{story if k else f"<article>{story}</article>"}</div>'
        rows.append((k, f"https://h{k % 2}.example/{k}", PAGE.format(body=inner)))
    rows += [(100 + k, "https://same.example/", PAGE.format(body="<article><h1>Head</h1><p>One and two</p><p>three</p></article>")) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in want} == want
    assert {got[100 + k] for k in range(4)} == {"Head\nOne and two\nthree"}


def test_template_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html, "BROADCAST_CHARS", -1)
    df = spark.createDataFrame([(k, "https://h.example/", "<article><p>x</p></article>") for k in range(20)], "page_id long, url string, html string")
    assert [r["text"] for r in extract_text(df).collect()] == ["x"] * 20


def test_occurrence_vectors_are_the_brute_force_ones(spark):
    """Tokens have equal vectors if and only if they stand equally often on the same pages, repeated rows counted."""
    rng = random.Random(51)
    rows = []
    for k in range(40):
        parts = [f'<div class="{c}"><p>{words(rng, 3)}</p></div>' * rng.choice([0, 1, 1, 2]) for c in "abcde"]
        rows.append((k, f"https://h{k % 2}.example/{k}", f"<body><section>{''.join(parts)}</section></body>"))
    rows += [rows[3]] * 2 + [rows[4]] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.occurrences(df.select(html.host_of(F.col("url")).alias("host"), F.xxhash64("page_id").alias("key"), "html")).toPandas()
    want = {}
    for n, (_, url, page) in enumerate(rows):
        for path, times in html.parse(page)[1].items():
            want.setdefault((url.split("/")[2], path), {})[n] = times
    assert {(r.host, r.path): r.pages for r in got.itertuples()} == {k: len(v) for k, v in want.items() if len(v) >= html.SUPPORT}
    tokens = list(got.itertuples())
    for a in tokens:
        for b in tokens:
            if a.host == b.host:
                assert (a.vector == b.vector) == (want[a.host, a.path] == want[b.host, b.path])


def _class_table(rows):
    return pd.DataFrame(rows, columns=["path", "pages", "total", "vector", "rank"])


def test_classes_are_once_ordered_and_nested():
    table = _class_table([("/b", 10, 10, "all", 0), ("/b/x", 10, 10, "all", 10), ("/b/y", 10, 10, "all", 15), ("/b/z", 10, 10, "all", 40), ("/b/x/p", 10, 33, "all", 5), ("/b/x/q", 4, 4, "some", 8), ("/b/z/q", 4, 4, "some", 20)])
    named = [[table.path[r] for r in part] for part in html.classes(table)]
    # /b/y changes places with /b/x, /b/x/p is not once a page, and the two q lie in different slots
    assert named == [["/b", "/b/x", "/b/z"], ["/b/x/q"], ["/b/z/q"]]


def test_layouts_have_their_own_slots(spark):
    """Two layouts of a host without marks: each class finds its slot, and tokens taken as one class would not."""
    rng = random.Random(52)
    rows, want = [], {}
    for k in range(40):
        lines = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        want[k] = "\n".join(lines)
        story = "".join(f"<p>{x}</p>" for x in lines)
        inner = f'<div class="story">{story}</div>' if k % 2 else f'<section><div class="long"><div class="text">{story}</div></div></section>'
        rows.append((k, f"https://h.example/{k}", f'<body><div class="top">{words(rng, 2)}</div>{inner}<div class="end">{words(rng, 2)}</div></body>'))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract_text(df).collect()} == want
    tokens = html.occurrences(df.select(html.host_of(F.col("url")).alias("host"), F.xxhash64("page_id").alias("key"), "html")).toPandas()
    own = html._deduced(tokens).content[0].split("\n")
    assert "/body/div.story" in own and "/body/section/div.long/div.text" in own
    same = html._deduced(tokens.assign(vector="0")).content[0].split("\n")
    assert same != own


def test_marks_are_evidence_only(spark):
    """Without article and main the text is the same, on hosts with enough pages."""
    rng = random.Random(53)
    rows = []
    for k in range(60):
        lines = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        rows.append((k, f"https://h{k % 3}.example/{k}", PAGE.format(body=f'<article><h1>{words(rng, 4)}</h1>{"".join(f"<p>{x}</p>" for x in lines)}</article>')))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    bare = df.withColumn("html", F.regexp_replace("html", "<(/?)article", "<$1div"))
    assert {tuple(r) for r in extract_text(df).collect()} == {tuple(r) for r in extract_text(bare).collect()}


def test_names_count_where_the_template_bears_them_out(spark):
    """A notice on every page goes, a paragraph that happens to be called so on one page stays."""
    rng = random.Random(54)
    story = [words(rng, 60) for _ in range(20)]
    rows = [(k, "https://h.example/", f'<article><div class="notice">{words(rng, 5)}</div><p>{t}</p>{"<p class=related>" + words(rng, 4) + "</p>" if k == 7 else ""}</article>') for k, t in enumerate(story)]
    got = {r["page_id"]: r["text"].split("\n") for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == [story[k]] for k in range(20) if k != 7) and len(got[7]) == 2
    whole = "<body><div class=notice><p>" + story[0] + "</p></div></body>"  # all of the text is in the named place
    assert main_text(whole) == story[0]


def test_odd_pages(spark):
    """A very long page, a host of one page, repeated rows, columns with the result's names, formulas."""
    long = "<article>" + "<p>one two</p>" * 100_000 + "</article>"
    rows = [(1, "https://a.example/", long, "x", 1), (2, "https://b.example/", "<nav>n</nav><div class=cookie>c</div><p>only <math><mi>x</mi></math></p>", "x", 1), (2, "https://b.example/", "<p>other</p>", "x", 1), (3, "https://b.example/", None, "x", 1)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = sorted((r["page_id"], r["n_chars"], r["text"][:7]) for r in got.collect())
    assert out == [(1, 799_999, "one two"), (2, 5, "other"), (2, 6, "only x"), (3, 0, "")]


def test_machine_is_the_pair_sum():
    rng = np.random.default_rng(0)
    m = Machine(12, 3)
    m.w, m.v, m.bias = rng.normal(size=12).astype(np.float32), rng.normal(size=(12, 3)).astype(np.float32), 0.3
    index, value = np.array([1, 4, 7, 2]), np.array([0.5, 1.0, 2.0, 3.0], np.float32)
    pairs = sum(m.v[index[a]] @ m.v[index[b]] * value[a] * value[b] for a in range(3) for b in range(a + 1, 3))
    assert m.raw(index, value, np.array([0, 3, 4]))[0] == pytest.approx(0.3 + (m.w[index[:3]] * value[:3]).sum() + pairs, rel=1e-5)


def test_quality(spark):
    rng = random.Random(8)
    good = [words(rng, rng.randint(20, 200)) + "." for _ in range(400)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, rng.randint(20, 200)).split()) for _ in range(200)]
    docs = [(k, t, "x") for k, t in enumerate(good + bad)] + [(9000, None, "x"), (9001, "", "x"), (None, "a", "x"), (9002, "a" * 300_000, "x")]
    marks = [(k, int(k < 400), 0) for k in range(600)] + [(77777, 1, 0), (5, None, 0), (6, 7, 0), (None, 1, 0)]
    out = score_quality(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == (r["doc_id"] < 400) for r in held]) > 0.97
    none = score_quality(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {round(r["score"], 2) for r in none.collect()} <= {0.49, 0.5, 0.51}


def test_language(spark):
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "th", "er", "and"], "fr": ["é", "eau", "le", "ç", "que"], "de": ["sch", "ü", "ung", "ein", "ß"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    docs = [(k, make(lang, rng.randint(5, 300)), lang) for k, lang in enumerate(rng.choice(list(parts)) for _ in range(500))]
    odd = [(9000, None, "en"), (9001, "123 !!", "en"), (9002, "", None), (9003, make("de", 5000), None), (None, make("fr", 50), "fr")]
    out = {r["doc_id"]: r for r in identify(spark.createDataFrame(docs + odd, "doc_id long, text string, lang string")).collect()}
    held = [(k, lang) for k, _, lang in docs if out[k]["held_out"]]
    assert len(held) > 80 and np.mean([out[k]["lang_pred"] == lang for k, lang in held]) > 0.97
    assert [out[k]["lang_pred"] for k in (9000, 9001, 9002, 9003, None)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    bare = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(bare).first()["lang_pred"] == "und" and identify(bare.limit(0)).collect() == []


def test_language_training_texts(spark):
    """At most so many texts a language, repeated rows once, and every window of each."""
    rows = [(k, f"text {k}", "en" if k % 3 else "fr") for k in range(3000)] + [(4, "text 4", "en")] * 500 + [(7001, None, "en"), (None, "x", "en"), (7002, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_texts(df, "doc_id", "text", "lang", 50).toPandas()
    assert got.groupby("lang").size().to_dict() == {"en": 50, "fr": 50} and got.text.nunique() == 100
    assert all(zlib.crc32(t.split()[1].encode()) % 4 != 2 for t in got.text)
    every = langid.training_texts(df, "doc_id", "text", "lang", 5000).toPandas()
    assert len(every) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(3000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr"]), pa.array([5, -6]), pa.array(["é" * 2000, "short"])], names=["lang", "key", "text"])
    out = list(langid._sampled(iter([batch])))[0]
    assert out.column(0).to_pylist().count("en") == -(-4000 // langid.WINDOW) + 2 and out.column(0).to_pylist().count("fr") == 3


def naive_answers(network, x):
    """Filters over the bytes one place at a time, the largest kept."""
    out = []
    for row in x:
        own = []
        for tables, bias in zip(network.tables, network.bias, strict=True):
            for f in range(langid.FILTERS):
                own.append(max(0.0, max(sum(float(tables[j][row[p + j]][f]) for j in range(len(tables))) for p in range(len(row) - len(tables) + 1)) + float(bias[f])))
        out.append(own)
    return np.array(out)


def test_convolution_is_the_naive_one():
    rng = np.random.default_rng(4)
    network = langid.Network(["a", "b", "c"])
    network.bias = [rng.normal(0, 0.5, langid.FILTERS).astype(np.float32) for _ in langid.WIDTHS]
    x = rng.integers(0, 256, (5, 40), dtype=np.uint8)
    want = naive_answers(network, x)
    assert np.allclose(network.pooled(x)[0], want, atol=1e-4)
    logits = want @ network.out + network.out_bias
    assert np.allclose(np.exp(network.log_probabilities(x)), np.exp(logits) / np.exp(logits).sum(1, keepdims=True), atol=1e-4)


def test_convolution_gradient():
    """One small step lowers the loss by the squared length of its gradient."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 256, (32, 60), dtype=np.uint8), rng.integers(0, 3, 32)
    network = langid.Network(["a", "b", "c"])
    loss = lambda n: -n.log_probabilities(x)[np.arange(32), y].mean()
    before, old = loss(network), [v.copy() for v in (*network.tables, *network.bias, network.out, network.out_bias)]
    network.train(x, y, epochs=1, batch=32, rate=1e-3)
    new = [*network.tables, *network.bias, network.out, network.out_bias]
    # Adagrad's first step: rate * g / sqrt(0.01 + g * g), from which g follows
    drop = 0.0
    for o, n in zip(old, new, strict=True):
        step = (o - n).astype(np.float64) / 1e-3
        g = 0.1 * step / np.sqrt(np.maximum(1 - step**2, 1e-9))
        drop += float((g * step).sum()) * 1e-3
    assert float(before - loss(network)) == pytest.approx(drop, rel=0.1)


def test_language_odd_rows(spark):
    """Repeated rows, columns with the result's names, a very long text, the same result whatever the partitions."""
    rows = [(k, ("the and of " if k % 2 else "le la que ") * (k % 40 + 1), "en" if k % 2 else "fr", "x", 1.0) for k in range(200)] + [(3, "the and", "en", "x", 1.0)] * 3 + [(999, "the and " * 100_000, None, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = identify(df).toPandas()
    assert out.columns.tolist() == ["doc_id", "held_out", "lang_pred", "score"] and len(out) == 204
    assert (out[out.doc_id == 3].lang_pred == "en").all() and out[out.doc_id == 999].lang_pred.item() == "en"
    again = identify(df.repartition(7)).toPandas()
    key = ["doc_id", "score"]
    assert np.allclose(out.sort_values(key).score.to_numpy(), again.sort_values(key).score.to_numpy())


def test_contexts():
    around = contexts(np.array([5, 6, 7, 8]), np.array([0, 3, 4]))
    assert around.tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]]


def even_prior():
    return np.full((SHAPES, DIGITS), -np.log(DIGITS), np.float32)


def test_network_learns():
    cells = np.tile(np.array([3, 9, 4, 30, 77, WORDS + 40]), 4000)
    around = contexts(cells, np.array([0, len(cells)]))
    network = Network(even_prior())
    before = network.log_likelihood(around, cells).mean()
    for _ in range(10):
        for at in range(0, len(cells), BATCH):
            network.step(around[at : at + BATCH], cells[at : at + BATCH], 4.0)
    assert before < -3 and network.log_likelihood(around, cells).mean() > -0.5


def naive_log_likelihood(network, around, cells):
    """Word by word and unit by unit."""
    out = []
    for row, cell in zip(around, cells, strict=True):
        h = [np.tanh(sum(float(network.near[c + s * CELLS][k]) for s, c in enumerate(row)) + float(network.lift[k])) for k in range(WIDTH)]
        scores = [sum(h[k] * float(network.out[k][c]) for k in range(WIDTH)) + float(network.bias[c]) for c in range(CLASSES)]
        own = cell if cell <= WORDS else 1 + WORDS + (cell - 1 - WORDS) // DIGITS
        value = scores[own] - np.log(sum(np.exp(scores)))
        if cell > WORDS:
            shape, digit = divmod(cell - 1 - WORDS, DIGITS)
            fine = [sum(h[k] * float(network.fine[k][d]) for k in range(WIDTH)) + float(network.prior[shape][d]) for d in range(DIGITS)]
            value += fine[digit] - np.log(sum(np.exp(fine)))
        out.append(value)
    return np.array(out)


def odd_network(seed):
    rng = np.random.default_rng(seed)
    prior = np.log(rng.dirichlet(np.ones(DIGITS), SHAPES)).astype(np.float32)
    return Network(prior, rng.normal(0, 0.3, sum(Network.SIZES)))


def test_log_likelihood_is_the_naive_one():
    cells = np.random.default_rng(2).integers(1, CELLS, 30)
    around, network = contexts(cells, np.array([0, 12, 30])), odd_network(3)
    assert around.shape == (30, SIDES)
    assert np.allclose(network.log_likelihood(around, cells), naive_log_likelihood(network, around, cells), atol=1e-3)


def test_step_follows_the_gradient():
    """The step is the gradient of the mean log-likelihood, place by place, as differences give it."""
    rng = np.random.default_rng(6)
    cells = np.concatenate([rng.integers(1, WORDS, 8), rng.integers(WORDS + 1, CELLS, 8)])
    around = contexts(cells, np.array([0, 16]))
    network = odd_network(7)
    start = network.weights().astype(np.float64)
    network.step(around, cells, 1e-2)
    gradient = (network.weights() - start) / 1e-2
    edges = np.concatenate([[0], np.cumsum(Network.SIZES)])
    touched = np.flatnonzero(np.abs(gradient) > 2e-3)
    assert all(((touched >= a) & (touched < b)).any() for a, b in zip(edges[:-1], edges[1:], strict=True))
    for place in rng.choice(touched, 40, replace=False):
        up, down = start.copy(), start.copy()
        up[place] += 1e-2
        down[place] -= 1e-2
        slope = (naive_log_likelihood(Network(network.prior, up), around, cells).mean() - naive_log_likelihood(Network(network.prior, down), around, cells).mean()) / 2e-2
        assert gradient[place] == pytest.approx(slope, rel=0.05, abs=2e-4)


def test_probabilities_of_all_words_add_up_to_one():
    """Classes, digits, words of a cell and the rest of a cell for words never seen."""
    from raterlake.llm import kernels as K

    rng = random.Random(8)
    vocabulary_words = sorted({"".join(rng.choice("abcdeABC1.") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    data = np.frombuffer(" ".join(vocabulary_words).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    hashes, _, starts, ends = K.word_hashes(data, offsets, lower=False)
    n = np.random.default_rng(1).integers(1, 50, len(hashes))
    common = np.argsort(-n, kind="stable")[:20]
    shape, digit = pseudolm.shapes(data, starts, ends), pseudolm.digits(hashes)
    total, distinct = np.zeros((SHAPES, DIGITS)), np.zeros((SHAPES, DIGITS))
    rest = np.setdiff1d(np.arange(len(hashes)), common)
    np.add.at(total, (shape[rest], digit[rest]), n[rest])
    np.add.at(distinct, (shape[rest], digit[rest]), 1)
    vocabulary = Vocabulary(hashes[common].view(np.int64).tolist(), total, distinct, (hashes[rest].view(np.int64), n[rest]))
    cells, _, words_ = vocabulary.split(data, offsets)
    inside, missing = vocabulary.inside(cells, words_)
    assert not len(missing) and (cells[common] <= WORDS).all() and (cells[rest] > WORDS).all()
    network = odd_network(9)
    network.prior = vocabulary.prior
    around = np.tile(np.array([[3, 200, 0, 900]]), (CELLS, 1))
    every = np.exp(network.log_likelihood(around, np.arange(CELLS)).astype(np.float64))
    assert every.sum() == pytest.approx(1, abs=1e-4)
    seen = (every[cells[rest]] * np.exp(inside[rest])).sum()
    unseen = (every[1 + WORDS :] * 0.5 / np.exp(vocabulary.whole)).sum()
    assert every[: 1 + WORDS].sum() + seen + unseen == pytest.approx(1, abs=1e-4)


def test_pseudo_likelihood(spark):
    rng = random.Random(11)
    usual = [" ".join(["the", "cat", "sat", "on", "a", "mat"] * rng.randint(5, 30)) for _ in range(200)]
    mixed = []
    for t in usual[:50]:
        w = t.split()
        rng.shuffle(w)
        mixed.append(" ".join(w))
    docs = [(k, t) for k, t in enumerate(usual + mixed)] + [(900, None), (901, ""), (902, "zzz" * 1000)]
    out = {r["doc_id"]: r for r in pseudo_likelihood(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert np.mean([out[k]["per_word"] for k in range(200)]) > np.mean([out[k]["per_word"] for k in range(200, 250)])
    assert out[900]["n_words"] == out[901]["n_words"] == 0 and out[900]["per_word"] is None and out[900]["log_likelihood"] == 0
    assert pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("head", [0, 100, 1 << 18])
def test_pseudo_likelihood_tells_words_of_a_shape_apart(spark, monkeypatch, head):
    """Seldom words for common ones of the same shape score lower, whether counts are at hand or joined."""
    monkeypatch.setattr("raterlake.llm.pseudolm.HEAD", head, raising=False)
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrst"
    usual = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(300)]
    docs = [(k, " ".join(rng.choices(usual, k=100))) for k in range(200)]
    docs += [(k, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(100))) for k in range(200, 210)]
    docs += [(None, docs[0][1])]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs] + [(5, docs[5][1], "x", 1)] * 2, "doc_id long, text string, word string, log_likelihood int")
    rows = pseudo_likelihood(frame).collect()
    assert len({round(r["per_word"], 6) for r in rows if r["doc_id"] == 5}) == 1 and len(rows) == 213
    out = {r["doc_id"]: r for r in rows}
    assert max(out[k]["per_word"] for k in range(200, 210)) < min(out[k]["per_word"] for k in range(200)) - 1
    assert out[None]["log_likelihood"] == pytest.approx(out[0]["log_likelihood"]) and len(out) == 211
    tokens = " ".join(t for _, t in docs).split()
    rare = [w for w in set(tokens) if tokens.count(w) == 1]
    assert len(rare) > 900


def test_plan_of_nothing():
    assert packing.plan({}, 8) == []
