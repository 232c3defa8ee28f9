"""A Merkle manifest of a data set: one tree of three-way nodes a group, one tree over the groups' roots, and each leaf's authentication path.

Leaves are dealt in aligned blocks of BLOCK leaves. Inside a block the paths come from
a fractal traversal (Jakobsson, Leighton, Micali and Szydlo 2003): in each tier of levels the
existing subtree gives the siblings of the present leaf while the desired one, the next
of that tier, grows by a leaf a step. What it holds is two small subtrees a tier,
whatever the block's size. The blocks' roots are the leaves of the next round, and so on
until each group is one block; paths are then completed from the top down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.llm.store import drop, settle, small_batches

ARITY = 3
#: Levels of a tier, and of a block.
TIER, LEVELS = 2, 6
BLOCK = ARITY**LEVELS
#: Groups of so many counts are sent to every task at most.
BROADCAST_COUNTS = 1_000_000


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Subtree:
    """The nodes at levels ``low`` to ``high`` above leaves that come one by one; below ``low`` only runs that aren't full yet are held."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.rows: list[list[str]] = [[] for _ in range(high + 1)]

    def add(self, node: str, level: int = 0) -> None:
        row = self.rows[level]
        row.append(node)
        if level < self.high and len(row) % ARITY == 0:
            self._raise(level, ARITY)

    def _raise(self, level: int, n: int) -> None:
        row = self.rows[level]
        parent = digest(*row[-n:])
        if level < self.low:
            row.clear()
        self.add(parent, level + 1)

    def close(self) -> None:
        """No leaves follow: runs that aren't full become nodes."""
        for level in range(self.high):
            rest = len(self.rows[level]) % ARITY
            if rest:
                self._raise(level, rest)

    def siblings(self, leaf: int) -> Iterator[tuple[str, str]]:
        """At each level, what stands left and right of the node above ``leaf`` (counted from the subtree's first leaf) in its run."""
        for level in range(self.low, self.high):
            at = leaf // ARITY**level
            start = at - at % ARITY
            run = self.rows[level]
            yield "".join(run[start:at]), "".join(run[at + 1 : start + ARITY])


def traverse(leaves: Sequence[str], levels: int, tier: int = TIER) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf in turn, ``levels`` pairs of what is left and right of it."""
    tiers = [(low, min(low + tier, levels)) for low in range(0, levels, tier)]
    existing, desired = [], [Subtree(low, high) for low, high in tiers]
    for low, high in tiers:
        first = Subtree(low, high)
        for leaf in leaves[: ARITY**high]:
            first.add(leaf)
        first.close()
        existing.append(first)
    for at in range(len(leaves)):
        for i, (low, high) in enumerate(tiers):
            if at and at % ARITY**high == 0:
                desired[i].close()
                existing[i], desired[i] = desired[i], Subtree(low, high)
        yield [pair for (_, high), tree in zip(tiers, existing, strict=True) for pair in tree.siblings(at % ARITY**high)]
        for (_, high), tree in zip(tiers, desired, strict=True):
            ahead = at + ARITY**high  # the leaf of the next subtree at this place
            if ahead < len(leaves):
                tree.add(leaves[ahead])


def top(leaves: Sequence[str], levels: int) -> str:
    """The node ``levels`` above ``leaves``."""
    tree = Subtree(levels, levels)
    for leaf in leaves:
        tree.add(leaf)
    tree.close()
    return tree.rows[levels][0]


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that ``leaf`` and its path give."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def _levels(n: int) -> int:
    """Levels of a block in a group of ``n`` nodes: all, if others stand beside it."""
    return LEVELS if n > BLOCK else height(n)


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def _block_root(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = _in_order(table)
    n = table["n"][0].as_py()
    root = top(table["node"].to_pylist(), _levels(n))
    return pa.table({"g": [key[0].as_py()], "idx": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "node": [root]})


NODES = "g string, idx long, n long, node string"


def _block() -> Column:
    return F.expr(f"idx div {BLOCK}").alias("block")


def rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables, roots): ``nodes`` (g, idx from 0 in g, n of g, node; g not null), the roots of its blocks, theirs, and so on; and the one root of each group (g, node)."""
    tables, roots = [nodes], []
    while True:
        up = settle(tables[-1].select("g", "idx", "n", "node").groupBy("g", _block()).applyInArrow(_block_root, NODES))
        roots.append(up.where("n = 1").select("g", "node"))
        more = up.where("n > 1")
        if more.isEmpty():
            break
        tables.append(more)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return tables, out


#: What the paths of a round hold: the path above a block, and what follows of it.
PATHS = "g string, idx long, lefts array<string>, rights array<string>, subroot string, root string"


def _paths(left: pa.Table, right: pa.Table) -> tuple[pa.Table, Iterator[tuple[list[tuple[str, str]], str, str]]]:
    """The rows of a block in order, and for each its whole path, its group's root and the root."""
    left = _in_order(left)
    above = right.slice(0, 1).to_pylist()[0]
    upper = list(zip(above["lefts"], above["rights"], strict=True))
    paths = traverse(left["node"].to_pylist(), _levels(left["n"][0].as_py()))
    return left, ((path + upper, above["subroot"], above["root"]) for path in paths)


def _descend(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return pa.table({"g": pa.array([], pa.string()), "idx": pa.array([], pa.int64()), "lefts": pa.array([], pa.list_(pa.string())), "rights": pa.array([], pa.list_(pa.string())), "subroot": pa.array([], pa.string()), "root": pa.array([], pa.string())})
    rows, found = _paths(left, right)
    found = list(found)
    return pa.table(
        {
            "g": rows["g"],
            "idx": rows["idx"],
            "lefts": pa.array([[a for a, _ in p] for p, _, _ in found], pa.list_(pa.string())),
            "rights": pa.array([[b for _, b in p] for p, _, _ in found], pa.list_(pa.string())),
            "subroot": [s for _, s, _ in found],
            "root": [r for _, _, r in found],
        }
    )


def _proofs(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), **{c: pa.array([], pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")}, "verified": pa.array([], pa.bool_())})
    rows, found = _paths(left, right)
    subroots, roots, proofs, folded = [], [], [], []
    for (path, subroot, root), held in zip(found, rows["held"].to_pylist(), strict=True):
        subroots.append(subroot)
        roots.append(root)
        proofs.append(digest(*(part for pair in path for part in pair)))
        folded.append(fold(held, path))
    return pa.table({"doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": subroots, "root": roots, "proof_sha256": proofs, "folded_root": folded, "verified": [a == b for a, b in zip(folded, roots, strict=True)]})


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def descend(tables: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """PATHS for the blocks of the first table, ``above`` having them (idx 0) for each group as a whole."""
    paths = above
    for i in range(len(tables) - 1, 0, -1):
        # a group that is one block in this round already gets its path from above
        done = settle(tables[i].groupBy("g", _block()).cogroup(paths.groupBy("g", F.col("idx").alias("block"))).applyInArrow(_descend, PATHS))
        paths = done.unionByName(above.join(done.select("g").distinct(), "g", "left_anti"))
    return paths


def leaf_of(columns: Sequence[Column]) -> Column:
    """H of the columns in order: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    enc = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(enc(c.cast("string")) for c in columns)), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """A settled table of ``rows`` with idx (from 0 in the ``group``, by ``order``) and n (its rows). ``rows`` is read twice.

    Rows are dealt by ranges of group and order, sorted and written with their
    place in the range; the groups' parts in the ranges are then counted, so a group may span
    any number of ranges and no window runs over it.
    """
    ranged = settle(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy(group, "part").agg(F.count("*").alias("c"), F.min("place").alias("first"))
    w = Window.partitionBy(group).orderBy("part")
    bases = counts.select(group, "part", (F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("base"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    few = counts.count() <= BROADCAST_COUNTS
    out = ranged.join(F.broadcast(bases) if few else bases, [group, "part"]).withColumn("idx", F.col("place") + F.col("base")).drop("place", "part", "base")
    out._raterlake_path = ranged._raterlake_path  # for drop()
    return out


def merkle_manifest(docs: DataFrame, group: str = "source", id_col: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), held: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row a row of ``docs``.

    A leaf is leaf_of() of ``columns``. The leaves of a ``group`` ascend by id (null first, equal ids
    by leaf); the groups' roots, null first and then by UTF-8 bytes, are the leaves of the tree that
    gives the root. ``held`` is the text that a reader holds now (default: unchanged): its leaf
    is folded with the path of the original, and ``verified`` says whether that gives the
    root. Paths themselves come from descend(); proof_sha256 is the hash of a
    path's siblings, bottom up and from left to right. Equal rows are leaves of their own.
    An empty table has no rows.
    """
    small_batches(docs.sparkSession)
    cols = [F.col(c) for c in columns]
    now = leaf_of([held if c == "text" and held is not None else F.col(c) for c in columns])
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # "-" is below "="
    leaves = settle(docs.select(key.alias("g"), F.col(id_col).cast("long").alias("doc_id"), leaf_of(cols).alias("node"), now.alias("held")))
    placed = numbered(leaves, "g", ["doc_id", "node", "held"])
    tables, roots = rounds(placed)
    subroots = settle(roots.select(F.lit("").alias("one"), F.col("g").alias("name"), "node"))
    ordered = numbered(subroots, "one", ["name"]).select(F.col("one").alias("g"), "idx", "n", "node", "name")
    upper, found = rounds(ordered)
    none = F.array().cast("array<string>")
    whole = found.select("g", F.lit(0).cast("long").alias("idx"), none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    blocks = descend(upper, whole)
    tops = settle(ordered.select("g", "idx", "n", "node").groupBy("g", _block()).cogroup(blocks.groupBy("g", F.col("idx").alias("block"))).applyInArrow(_descend, PATHS))
    named = tops.drop("g", "subroot").join(ordered.select("idx", F.col("name").alias("g"), F.col("node").alias("subroot")), "idx").select("g", F.lit(0).cast("long").alias("idx"), "lefts", "rights", "subroot", "root")
    above = descend(tables, settle(named))
    drop(leaves)
    return placed.groupBy("g", _block()).cogroup(above.groupBy("g", F.col("idx").alias("block"))).applyInArrow(_proofs, PROOFS)
