"""Main text of web pages by equivalence-class template deduction.

Tokens are the places of a page's elements (the path of block elements with
their class and id). On the pages of one host, tokens with the same occurrence
vector (how often each stands on which page) form an equivalence class. A class is
valid if it is on enough pages, once on each, and its tokens keep an order; its
tokens that lie in different slots of the classes around are classes of their
own, so that valid classes nest. Nested they are the host's template, and what
stands in a token's place is its slot. Text that is the same on different pages
belongs to the template, as does a slot that names itself a menu, advert or
notice if it recurs over the host and holds less than half of the text. The
remaining slots hold the article: of each class the innermost slot with nearly all
text of the pages that have it. So each layout of a host has a slot of its own, and
a page is read by the innermost slot that it has.

What a page says of itself is evidence only. A mark (article, main) lets a slot
of a valid class hold less of the text or recur on a page, and bounds it. The names
of classes and ids (ad, notice, comments, ...) count only where the template bears
them out, or where a host has too few pages for a template. Elements that HTML
defines as something else than text (nav, aside, footer, form, hidden ones) hold
no article text.

Occurrence vectors are never collected: two tokens of a host have equal vectors if
the sums of a hash of (page, occurrences) over the pages are equal, which
pre-aggregate, so a host with a third of all pages is no larger than another.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm.store import settle, small_batches, with_groups

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?(?:>|(?=<)|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# What HTML says of its elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr nobr math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
# Elements and roles that hold no article text, and parts of names that suggest it.
APART = frozenset("nav aside footer form button select dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related recommended respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget".split())
#: Pages that a class must be on.
SUPPORT = 3
#: Shares of their pages' text that a slot holds, and a marked one.
NEARLY_ALL, MARKED = 0.9, 0.5


class Block:
    """A block's text, its place, whether it is in an element that holds no article text, and the places around it whose names suggest so."""

    __slots__ = ("path", "text", "apart", "named")

    def __init__(self, path: str, text: str, apart: bool, named: tuple[str, ...]):
        self.path, self.text, self.apart, self.named = path, text, apart, named


def _names(attributes: dict[str, str]) -> list[str]:
    return [w.lower() for key in ("class", "id") for w in _WORD.findall(attributes.get(key, ""))]


def parse(page: str) -> tuple[list[Block], dict[str, int], set[str]]:
    """The page's blocks of text in order, how often each place occurs (in the order of their first), and the places that open a mark of the article."""
    blocks: list[Block] = []
    places: dict[str, int] = {}
    marks: set[str] = set()
    stack: list[tuple[str, str, bool, tuple[str, ...], bool]] = [("", "", False, (), False)]  # name, path, apart, named, article
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, path, apart, named, _ = stack[-1]
                blocks.append(Block(path, text, apart, named))

    def close(names: frozenset[str] | tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                del stack[depth:]
                return
            if stack[depth][0] in within:
                return

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            parts.append(page[at:])
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name, closing = found[2].lower(), bool(found[1])
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            if not closing and not found[0].endswith("/>"):
                shut = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = shut.end() if shut else end
            continue
        if name in INLINE or (name in VOID and name != "hr"):
            continue
        flush()
        if closing:
            if name == "p" and all(s[0] != "p" for s in stack):
                continue
            close((name,))
            continue
        if name in CLOSES_P:
            close(("p",), ("button", "table", "td", "th", "div", "article", "section"))
        if name == "li":
            close(("li",), ("ul", "ol", "menu"))
        elif name in ("dt", "dd"):
            close(("dt", "dd"), ("dl",))
        elif name in ("td", "th"):
            close(("td", "th"), ("tr", "table"))
        elif name == "tr":
            close(("tr",), ("table",))
        elif name in ("option", "optgroup"):
            close(("option",), ("select",))
        attributes = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(found[3] or "")} if found[3] and not found[3].isspace() else {}
        words = _names(attributes)
        _, path, apart, named, within = stack[-1]
        article = within or name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        apart = apart or name in APART or (name == "header" and not article) or "hidden" in attributes or attributes.get("role", "").lower() in ROLES
        path = f"{path}/{name}" + "".join(f".{w}" for w in sorted(set(words)))
        if not NAMES.isdisjoint(words) and not (article and "header" in words):
            named = (*named, path)
        places[path] = places.get(path, 0) + 1
        if article and not within:
            marks.add(path)
        if name not in VOID:
            stack.append((name, path, apart, named, article))
    flush()
    return blocks, places, marks


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _above(path: str) -> Iterator[str]:
    """The place itself and those around it, innermost first."""
    while path:
        yield path
        path = path[: path.rindex("/")]


def _free(blocks: list[Block]) -> list[Block]:
    """Blocks that are neither apart nor in places whose names suggest so, unless these hold half of the text or more."""
    text = [b for b in blocks if not b.apart]
    free = [b for b in text if not b.named]
    return free if 2 * sum(len(b.text) for b in free) > sum(len(b.text) for b in text) else text


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page and place: how often it occurs, its rank among the page's places, the length and hash of its own text, the text inside of it and on the whole page, the page's hash, and whether it is a mark or named. Text apart isn't counted."""
    for batch in batches:
        rows = []
        for host, key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            blocks, places, marks = parse(page.as_py() or "")
            names = {p for b in blocks for p in b.named}
            texts: dict[str, list] = {}
            whole = body = 0
            for b in _free(blocks):
                own = texts.setdefault(b.path, [0, 0])
                text = b.text.encode()
                own[0] += len(b.text)
                own[1] = zlib.crc32(text, own[1])
                whole += len(b.text)
                body = zlib.crc32(text, body)
            inside: dict[str, int] = {}
            for path, (chars, _) in texts.items():
                for around in _above(path):
                    inside[around] = inside.get(around, 0) + chars
            for rank, (path, n) in enumerate(places.items()):
                rows.append((host, key, path, n, rank, *texts.get(path, (0, 0)), inside.get(path, 0), whole, body, path in marks, path in names))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 12
        types = (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "key", "path", "n", "rank", "chars", "look", "inside", "whole", "body", "mark", "named"])


def classes(tokens: pd.DataFrame) -> list[list[int]]:
    """Valid classes of one host's tokens (path, pages, total, vector, rank), as row numbers in page order; those on most pages first.

    A class has the tokens of one occurrence vector that are once on each of their
    pages and lie in one slot of the classes around; a token goes if its mean
    rank is less than one place after the token's before it, as their order is not
    the same on all pages then.
    """
    found: list[list[int]] = []
    owner: dict[str, tuple[int, str]] = {}  # token's path -> its class and path
    paths, pages, ranks = tokens["path"].tolist(), tokens["pages"].tolist(), tokens["rank"].tolist()
    once = tokens[tokens["total"] == tokens["pages"]]
    groups = sorted(once.groupby(["pages", "vector"]).indices.items(), key=lambda g: (-g[0][0], min(len(paths[once.index[i]]) for i in g[1]), g[0][1]))
    for _, members in groups:
        rows = sorted((int(once.index[i]) for i in members), key=lambda r: (ranks[r], len(paths[r]), paths[r]))
        ordered: list[int] = []
        for r in rows:
            if not ordered or ranks[r] - ranks[ordered[-1]] >= pages[r]:
                ordered.append(r)
        own = {paths[r] for r in ordered}
        slots: dict[tuple[int, str] | None, list[int]] = {}
        for r in ordered:
            around = next((p for p in _above(paths[r]) if p in owner and p not in own), None)
            slots.setdefault(owner.get(around) if around else None, []).append(r)
        for part in slots.values():
            for r in part:
                owner[paths[r]] = (len(found), paths[r])
            found.append(part)
    return found


def _deduced(rows: pd.DataFrame) -> pd.DataFrame:
    """One host's tokens -> its template: the places of content slots, innermost first, the places whose text is the template's own, and whether names count on their own as there are too few pages."""
    rows = rows.reset_index(drop=True)
    pages = int(rows["host_pages"].iloc[0])
    share = (rows["inside"] / rows["whole"].clip(lower=1)).tolist()
    paths, marks = rows["path"].tolist(), rows["mark"].tolist()
    found = classes(rows)
    # a mark may recur on a page, and stands for a class then
    found += [[r] for r in rows.index[rows["mark"] & (rows["total"] != rows["pages"])]]
    slots: set[str] = set()
    for part in found:
        bound = [r for r in part if marks[r] and share[r] >= MARKED]
        if bound:
            slots.add(min((paths[r] for r in bound), key=lambda p: (p.count("/"), p)))
    bounds = frozenset(slots)
    for part in found if pages >= SUPPORT else ():
        free = [paths[r] for r in part if share[r] >= NEARLY_ALL and bounds.isdisjoint(_above(paths[r]))]
        if free:
            slots.add(max(free, key=lambda p: (p.count("/"), p)))
    # the same text on pages that differ
    constant = rows[(rows["pages"] >= SUPPORT) & (rows["chars"] > 0) & (rows["low"] == rows["high"]) & (rows["first"] < rows["last"]) & (rows["chars"] < 0.5 * rows["whole"])]
    named = rows[rows["named"] & (rows["inside"] < 0.5 * rows["whole"])]
    ordered = sorted(slots, key=lambda p: (-p.count("/"), p))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "content": ["\n".join(ordered)], "fixed": [sorted(constant["path"])], "borne_out": [sorted(named["path"])], "few": [pages < SUPPORT]})


_TEMPLATE = "host string, content string, fixed array<string>, borne_out array<string>, few boolean"


def occurrences(pages: DataFrame) -> DataFrame:
    """Tokens of each host from pages (host, key, html): on how many pages, how often, their occurrence vector, and sums over the pages; only those on SUPPORT pages, or on all of a host with fewer."""
    schema = "host string, key long, path string, n long, rank long, chars long, look long, inside long, whole long, body long, mark boolean, named boolean"
    rows = pages.select("host", "key", "html").mapInArrow(_tokens, schema)
    hashed = F.xxhash64("key", "n")
    half = lambda c: F.sum(c).cast("string")
    by_token = settle(
        rows.groupBy("host", "path").agg(
            F.count("*").alias("pages"),
            F.sum("n").alias("total"),
            F.concat_ws(",", half(hashed.bitwiseAND(0xFFFFFFFF)), half(F.shiftrightunsigned(hashed, 32))).alias("vector"),
            *(F.sum(c).alias(c) for c in ("rank", "chars", "inside", "whole")),
            F.min("look").alias("low"),
            F.max("look").alias("high"),
            F.min("body").alias("first"),
            F.max("body").alias("last"),
            F.max("mark").alias("mark"),
            F.max("named").alias("named"),
        )
    )
    return with_groups(by_token, ["host"], host_pages=F.max("pages")).where(F.col("pages") >= F.least(F.lit(SUPPORT), "host_pages"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, content, fixed, borne_out, few) from pages (host, key, html): the content slots' places, a line each and innermost first; the places of constant text; the named places that recur; whether there are too few pages for a template."""
    return occurrences(pages).groupBy("host").applyInPandas(_deduced, _TEMPLATE)


def slot_of(blocks: list[Block], content: str) -> str:
    """The innermost of the template's slots that holds text of this page; empty if none does."""
    around = {p for b in blocks for p in _above(b.path)}
    return next((slot for slot in content.split("\n") if slot in around), "")


def main_text(page: str, content: str = "", fixed: frozenset[str] = frozenset(), borne_out: frozenset[str] | None = None) -> str:
    """What stands in the page's content slot without the template's own text, a line a block; all but the template's text if no slot is on the page. ``borne_out`` are the named places that count; None for all."""
    blocks = parse(page)[0]
    sure = _free(blocks) if borne_out is None else [b for b in blocks if not b.apart and borne_out.isdisjoint(b.named)]
    free = [b for b in sure if b.path not in fixed]
    slot = slot_of(free, content)
    return "\n".join(b.text for b in free if b.path == slot or b.path.startswith(slot + "/") or not slot)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for batch in batches:
        texts = []
        for page, host, content, fixed, borne_out, few in zip(batch.column(2), *(batch.column(c).to_pylist() for c in range(3, 8)), strict=True):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = (content or "", frozenset(fixed or ()), None if few or few is None else frozenset(borne_out or ()))
            texts.append(main_text(page.as_py() or "", *known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


#: Templates of so many characters in all are sent to every task; beyond, pages and templates are joined by a shuffle.
BROADCAST_CHARS = 32 << 20
SALTS = 64


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of each page, blocks in page order joined by a line feed; empty if there is none.

    Null html is empty. Pages without a host (null, or no address) share one
    template. Repeated rows are read each, and count each in the template. A host of
    fewer than SUPPORT pages has only marks and names to go by. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = settle(templates(rows.withColumn("key", F.xxhash64("page_id", "url"))))
    chars = F.length("content") + F.aggregate(F.concat("fixed", "borne_out"), F.lit(0), lambda n, x: n + F.length(x) + 20)
    if (found.agg(F.sum(chars)).first()[0] or 0) <= BROADCAST_CHARS:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:  # a host with a third of all pages is dealt over SALTS tasks
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    out = joined.select("page_id", "url", "html", "host", "content", "fixed", "borne_out", "few").mapInArrow(_extracted, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
