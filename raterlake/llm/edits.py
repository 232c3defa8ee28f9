"""Token counts that follow edits without encoding a document again.

A document is kept as leaves, pieces of about LEAF characters cut where the vocabulary's
pattern surely ends a pre-token (see SURE). Over the leaves stands a segment tree of
character and token sums. An edit finds its leaves by descending the character sums, takes in
a neighbour wherever the cut beside it is no longer such a place, encodes only that
region, and updates the sums up to the root; many edits of a document are made in one
sweep. BPE never joins pre-tokens, so the root is the count that encoding the whole
edited text would give. A leaf is longer only where the text has no such place, as one word
of a megabyte: that is one pre-token, which can only be encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm.store import small_batches
from raterlake.llm.tokenizer import encoder

LEAF = 512

#: ASCII marks but for the apostrophe, which may begin a pre-token of letters, and those of the vocabulary's added token.
_MARK = r"!-&(-/:;=?@\[-`{}~"
#: Letters of scripts without spaces, and their marks.
_IDEOGRAPH, _STOP = "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3", "\u3001\u3002\u300c\u300d\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
#: Where a pre-token surely ends, whatever stands further off: before white space after anything else, and between letters, digits and marks.
SURE = re.compile(
    rf"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9'{_MARK}])|(?<=[0-9])(?=[A-Za-z'{_MARK}])|(?<=[{_MARK}])(?=[A-Za-z0-9])"
    rf"|(?<=[{_IDEOGRAPH}])(?=[{_STOP}])|(?<=[{_STOP}])(?=[{_IDEOGRAPH}])"
)


def pieces(text: str) -> list[str]:
    """``text`` in pieces of at least LEAF characters (but for the last), cut where no pre-token crosses."""
    out, at, end = [], 0, len(text)
    while end - at > 2 * LEAF:
        cut = SURE.search(text, at + LEAF, end - 1)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def _parted(left: str, right: str) -> bool:
    """Whether no pre-token crosses from ``left`` to ``right``."""
    return SURE.match(left[-1] + right[0], 1) is not None


class TokenTree:
    """Segment tree of (characters, tokens) over a document's leaves."""

    def __init__(self, leaves: list[str], tokens: list[int], path: str | None = None):
        self.path = path
        self.encoded = 0
        self._build(leaves, tokens)

    @classmethod
    def of(cls, text: str, path: str | None = None) -> TokenTree:
        leaves = pieces(text)
        encode = encoder(path)
        return cls(leaves, [len(encode(x)) for x in leaves], path)

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(leaves)] = map(len, leaves)
        self.tokens[self.width : self.width + len(leaves)] = tokens
        for node in range(self.width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.width + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf of character ``at`` (the last leaf for the text's end) and the place in it."""
        node = 1
        if at >= self.chars[1]:
            leaf = len(self.leaves) - 1
            while leaf and not self.leaves[leaf]:
                leaf -= 1
            return leaf, len(self.leaves[leaf])
        while node < self.width:
            node *= 2
            if at >= self.chars[node]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def sweep(self, edits: Sequence[tuple[int, int, str]]) -> None:
        """Make ``edits`` (start, stop, replacement), ascending and apart, their places being those of the text before all of them.

        Leaves that the edits touch become regions, which take in neighbours as in edit();
        each region is encoded once, however many edits it holds, and the sums follow.
        """
        out: list[tuple[str, int | None]] = []  # a leaf and its tokens, None where it is to be encoded

        def put(text: str, tokens: int | None) -> None:
            while out and (tokens is None or out[-1][1] is None) and not (text and out[-1][0] and _parted(out[-1][0], text)):
                text, tokens = out.pop()[0] + text, None
            out.append((text, tokens))

        old = self.tokens[self.width : self.width + len(self.leaves)]
        at, k, open_edit = 0, 0, None
        for leaf, tokens in zip(self.leaves, old, strict=True):
            if not leaf:
                continue
            end, place, parts = at + len(leaf), at, []
            touched = open_edit is not None
            if open_edit is not None:
                place = min(end, open_edit)
                open_edit = open_edit if open_edit > end else None
            while open_edit is None and k < len(edits) and edits[k][0] < end:
                start, stop, replacement = edits[k]
                parts += [leaf[place - at : start - at], replacement]
                place, open_edit, touched, k = min(stop, end), stop if stop > end else None, True, k + 1
            put("".join(parts) + leaf[place - at :] if touched else leaf, None if touched else tokens)
            at = end
        tail = "".join(replacement for _, _, replacement in edits[k:])  # what is put in at the end of the text
        if tail:
            put(tail, None)
        leaves, counts = [], []
        for text, tokens in out:
            fresh = [text] if tokens is not None else pieces(text)
            leaves += fresh
            counts += [tokens] if tokens is not None else [len(encoder(self.path)(x)) for x in fresh]
            self.encoded += 0 if tokens is not None else len(text)
        self._build(leaves or [""], counts or [0])

    def edit_all(self, edits: Sequence[tuple[int, int, str]]) -> None:
        """Make ``edits`` one after the other, each by the places of the text as it is then. Those that go from the end towards the start are made in one sweep."""
        sweep: list[tuple[int, int, str]] = []
        for start, stop, replacement in edits:
            size = self.chars[1] if not sweep else None
            if sweep and max(start, stop) <= sweep[-1][0] and start >= 0:
                sweep.append((start, max(start, stop), replacement))
                continue
            if sweep:
                self.sweep(sweep[::-1])
                size = self.chars[1]
            start = max(0, min(start, size))
            sweep = [(start, max(start, min(stop, size)), replacement)]
        if sweep:
            self.sweep(sweep[::-1])

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Put ``replacement`` for the characters start..stop; bounds outside the text are moved to its ends."""
        start = max(0, min(start, self.chars[1]))
        stop = max(start, min(stop, self.chars[1]))
        first, head = self._find(start)
        last, tail = self._find(stop)
        region = self.leaves[first][:head] + replacement + self.leaves[last][tail:]
        while True:
            before = next((i for i in range(first - 1, -1, -1) if self.leaves[i]), None)
            if before is not None and not (region and _parted(self.leaves[before], region)):
                region, first = self.leaves[before] + region, before
                continue
            after = next((i for i in range(last + 1, len(self.leaves)) if self.leaves[i]), None)
            if after is not None and not (region and _parted(region, self.leaves[after])):
                region, last = region + self.leaves[after], after
                continue
            break
        fresh = pieces(region)
        counts = [len(encoder(self.path)(x)) for x in fresh]
        self.encoded += len(region)
        room = last - first + 1
        if len(fresh) > room:  # more leaves than there were: the tree is built anew, without encoding
            old = self.tokens[self.width : self.width + len(self.leaves)]
            self._build(self.leaves[:first] + fresh + self.leaves[last + 1 :], old[:first] + counts + old[last + 1 :])
            return
        for i in range(room):
            self._set(first + i, *((fresh[i], counts[i]) if i < len(fresh) else ("", 0)))


def _trees(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [TokenTree.of(t.as_py() or "", path) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(["".join(t.leaves) for t in trees]), pa.array([[len(x) for x in t.leaves] for t in trees], pa.list_(pa.int32())), pa.array([t.tokens[t.width : t.width + len(t.leaves)] for t in trees], pa.list_(pa.int32())), pa.array([t.tokens[1] for t in trees], pa.int64())],
                names=["id", "text", "leaf_chars", "leaf_tokens", "n_tokens"],
            )

    return run


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id, text, leaf_chars, leaf_tokens, n_tokens): each document's leaves and its count. A null text is empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_trees(tokenizer_path), "id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")


def _edited(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars, tokens, after, encoded = [], [], [], [], []
            for text, sizes, counts, edits in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 5)), strict=True):
                if not edits:
                    texts.append(text), chars.append(sizes), tokens.append(counts), after.append(sum(counts)), encoded.append(0)
                    continue
                at, leaves = 0, []
                for size in sizes:
                    leaves.append(text[at : at + size])
                    at += size
                tree = TokenTree(leaves, counts, path)
                tree.edit_all([(e["start"], e["stop"], e["replacement"] or "") for e in edits])
                texts.append("".join(tree.leaves)), chars.append([len(x) for x in tree.leaves]), tokens.append(tree.tokens[tree.width : tree.width + len(tree.leaves)])
                after.append(tree.tokens[1]), encoded.append(tree.encoded)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), batch.column(4), pa.array([len(e or []) for e in batch.column(5).to_pylist()], pa.int64()), pa.array(after, pa.int64()), pa.array(encoded, pa.int64())],
                names=["id", "text", "leaf_chars", "leaf_tokens", "n_tokens_before", "n_edits", "n_tokens", "n_chars_encoded"],
            )

    return run


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The trees after ``edits`` (id, seq, start, stop, replacement), with n_tokens_before, n_edits and n_chars_encoded.

    Edits of a document are applied by seq (ties: by start and stop, later places
    first); places are characters of the text as it is then, and are moved into it
    if they lie outside. A null replacement deletes. Edits with a null place or of unknown documents
    are ignored; repeated edits are applied again. Rows that repeat an id are
    edited each.
    """
    sound = edits.where("id is not null and start is not null and stop is not null")
    order = F.struct("seq", (-F.col("start")).alias("o1"), (-F.col("stop")).alias("o2"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "replacement")
    lists = sound.groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("edits")).withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["replacement"].alias("replacement"))))
    joined = trees.join(lists, "id", "left").select("id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "edits")
    return joined.mapInArrow(_edited(tokenizer_path), "id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens_before long, n_edits long, n_tokens long, n_chars_encoded long")


#: What redactions() masks: mail addresses of any length, long runs of digits (with single marks between), long hexadecimal strings.
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMBER = re.compile(r"\+?\d(?:[ ().-]{0,2}\d){8,}")
_HEX = re.compile(r"\b[0-9a-f]{32,}\b")


def masked(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, mask) of the places of a text to mask, the last first; of places that overlap the first."""
    found = [(m.start(), m.end(), "<number>") for m in _NUMBER.finditer(text)] + [(m.start(), m.end(), "<secret>") for m in _HEX.finditer(text)]
    if "@" in text:
        found += [(m.start(), m.end(), "<mail>") for m in _MAIL.finditer(text)]
    end, kept = 0, []
    for start, stop, mask in sorted(found):
        if start >= end:
            kept.append((start, stop, mask))
            end = stop
    return kept[::-1]


def _redactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, k, *e) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, e in enumerate(masked(text.as_py() or ""))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "seq", "start", "stop", "replacement"])


def _redacted(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                tree = TokenTree.of(text.as_py() or "", path)
                before, edits = tree.tokens[1], masked(text.as_py() or "")
                tree.edit_all(edits)
                rows.append(("".join(tree.leaves) if edits else text.as_py() or "", before, len(edits), tree.tokens[1], tree.encoded))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True))], names=["id", "text", "n_tokens_before", "n_edits", "n_tokens", "n_chars_encoded"])

    return run


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id, text, n_tokens_before, n_edits, n_tokens, n_chars_encoded): each document's own redactions() found and applied to its tree in one pass, without a shuffle.

    A null text is empty. Repeated rows and rows without an id are edited each; other
    columns are ignored, whatever their names. Edits that come from another table are
    for apply_edits().
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_redacted(tokenizer_path), "id long, text string, n_tokens_before long, n_edits long, n_tokens long, n_chars_encoded long")


def redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edits that mask mail addresses, long numbers and hexadecimal secrets, the last place of a text first."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(_redactions, "id long, seq long, start long, stop long, replacement string")
