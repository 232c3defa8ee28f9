"""Exact threshold pairs of vectors: cover trees and their dual traversal.

Equal vectors are collapsed first. The rest is dealt to cells by nearest pivot,
and a cell is cut into blocks of a bounded number of rows; a block is the top node
of its cover tree, with a centre and a covering radius. A vector goes to the pair
of its own block and another only if its distance from the other's centre is at
most the other's radius and the reach of the threshold together; that is a bound,
so no pair is lost.

Each block's tree is built once (nested levels, each with half the radius of the
level above); in a task the trees of two blocks are traversed together from the coarsest level: a pair
of nodes is dropped if even its closest members are too far apart, counted whole,
without being opened, if even its farthest members are near enough, and opened
otherwise. Only counts and a spanning forest of the links leave the task, so a
group of thousands of near copies costs one row a member.

On vectors without structure nearly every one is a node of its own on the
coarsest level, and the work is the product of the blocks, as it must be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm.components import connected_components
from raterlake.llm.store import attached, drop, settle, small_batches, with_groups

#: Radii of the levels, as Euclidean distances of unit vectors.
RADII = (0.5, 0.25, 0.125, 0.0625)
BLOCK = 4096
MAX_PIVOTS = 1024
#: Bounds are widened by so much against rounding (a distance near 0 has an error of 1e-8); decisions are made on the cosine itself.
EPS = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in double precision."""
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def nets(x: np.ndarray) -> np.ndarray:
    """(levels, rows): the centre of each row on each level; nested, each level's centres at least its radius apart within a node of the level above."""
    n = len(x)
    near = x @ x.T
    chosen: list[int] = []
    above = np.zeros(n, np.int64)
    out = []
    for radius in RADII:
        least = 1 - radius * radius / 2
        centre = np.full(n, -1, np.int64)
        fresh = []
        for i in chosen + list(range(n)):
            if centre[i] < 0:
                own = (near[i] >= least) & (centre < 0) & (above == above[i])
                own[i] = True
                centre[own] = i
                fresh.append(i)
        chosen, above = fresh, centre
        out.append(centre)
    return np.stack(out)


class Tree:
    """Cover tree over rows ``x`` from their nodes' names by level; levels holds each row's centre, a row of its node, and the radii around centres that cover their nodes."""

    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in names:
            _, first, node = np.unique(level, return_index=True, return_inverse=True)
            centre = first[node]
            reach = np.zeros(len(x))
            np.maximum.at(reach, centre, distance(np.einsum("ij,ij->i", x, x[centre])))
            self.levels.append((centre, reach))
        self.levels.append((np.arange(len(x)), np.zeros(len(x))))


def _positions(parent: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes sorted by parent, and the offsets of each parent's."""
    order = np.argsort(parent[nodes], kind="stable")
    kids = nodes[order]
    return kids, np.searchsorted(parent[kids], np.arange(len(parent) + 1))


def traverse(a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows of two trees: counts a row (weighted by the other side), and pairs that join all linked rows, the rows of ``b`` numbered after those of ``a``."""
    far = float(distance(np.array(cosine)))
    count_a, count_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    join_a, join_b = [], []
    shift = 0 if same else len(a.x)
    pa_, pb_ = None, None
    for level in range(len(a.levels)):
        (ca, ra), (cb, rb) = a.levels[level], b.levels[level]
        na, nb = np.unique(ca), np.unique(cb)
        if pa_ is None:
            low = distance(a.x[na] @ b.x[nb].T) - ra[na][:, None] - rb[nb][None, :]
            i, j = np.nonzero(low <= far + EPS)
            i, j = na[i], nb[j]
            if same:
                i, j = i[i <= j], j[i <= j]
        else:
            up_a, up_b = a.levels[level - 1][0], b.levels[level - 1][0]
            ka, oa = _positions(up_a, na)
            kb, ob = _positions(up_b, nb)
            sa, sb = oa[pa_ + 1] - oa[pa_], ob[pb_ + 1] - ob[pb_]
            many = sa * sb
            total = int(many.sum())
            which = np.repeat(np.arange(len(pa_)), many)
            inside = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            i = ka[oa[pa_[which]] + inside // sb[which]]
            j = kb[ob[pb_[which]] + inside % sb[which]]
            if same:  # a node opened against itself gives each pair of its parts twice
                keep = (pa_[which] != pb_[which]) | (i <= j)
                i, j = i[keep], j[keep]
        near = np.concatenate([np.einsum("ij,ij->i", a.x[i[s : s + 65536]], b.x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        gap = distance(near)
        bottom = level == len(a.levels) - 1
        if bottom:
            hit = near >= cosine
            if same:
                hit &= i != j
            i, j = i[hit], j[hit]
            np.add.at(count_a, i, wb[j])
            np.add.at(count_b, j, wa[i])
            join_a.append(i)
            join_b.append(j + shift)
            break
        open_ = gap - ra[i] - rb[j] <= far + EPS
        whole = open_ & (gap + ra[i] + rb[j] <= far - 10 * EPS)
        if whole.any():
            weight_a, weight_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
            np.add.at(weight_a, ca, wa)
            np.add.at(weight_b, cb, wb)
            u, v = i[whole], j[whole]
            node_a, node_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
            np.add.at(node_a, u, weight_b[v])
            other = np.ones(len(u), bool) if not same else u != v
            np.add.at(node_b, v[other], weight_a[u[other]])
            count_a += node_a[ca]
            count_b += node_b[cb]
            if same:
                own = np.isin(ca, u[u == v])
                count_a[own] -= wa[own]
            for nodes, centre, by in ((u, ca, 0), (v, cb, shift)):
                rows = np.flatnonzero(np.isin(centre, nodes))
                join_a.append(rows + by)
                join_b.append(centre[rows] + by)
            join_a.append(u)
            join_b.append(v + shift)
        open_ &= ~whole
        pa_, pb_ = i[open_], j[open_]
    return count_a, count_b, np.concatenate(join_a), np.concatenate(join_b)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, each tree a star on its least id."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in parent if find(x) != x]


def _pair(cosine: float, kind: str, width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values("id", kind="stable")
        ids, weights, trees = [], [], []
        for block in dict.fromkeys((i, j)):
            own = rows[rows["own"] == block]
            ids.append(own["id"].to_numpy(np.int64))
            weights.append(own["weight"].to_numpy(np.int64))
            trees.append(Tree(_matrix(own["v"], kind, width), np.stack([own[f"c{k}"].to_numpy(np.int64) for k in range(len(RADII))])))
        if not len(ids[0]) or not len(ids[-1]):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "n", "other")})
        count_a, count_b, left, right = traverse(trees[0], trees[-1], weights[0], weights[-1], cosine, i == j)
        named = np.concatenate(ids)
        star = _forest(named[left], named[right])
        counted = np.concatenate([ids[0][count_a > 0], ids[-1][count_b > 0]])
        return pd.DataFrame(
            {
                "id": np.concatenate([counted, np.array([x for x, _ in star], np.int64)]),
                "n": np.concatenate([count_a[count_a > 0], count_b[count_b > 0], np.zeros(len(star), np.int64)]),
                "other": np.concatenate([counted, np.array([y for _, y in star], np.int64)]),
            }
        )

    return run


def _matrix(column: pd.Series, kind: str, width: int) -> np.ndarray:
    """Unit rows from the packed vectors; shorter vectors are filled with zeros."""
    x = np.zeros((len(column), width))
    for row, packed in enumerate(column):
        own = np.frombuffer(packed, kind)
        x[row, : len(own)] = own
    if len(x):
        x /= np.abs(x).max(axis=1, keepdims=True)
        x = unit(x)
    return x


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.values, kind).tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["id", "weight", "v"])

    return run


def _nodes(kind: str, width: int):
    """A block's rows with the ids of their centres, so that a block's tree is built once and not in every pair."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        centres = rows["id"].to_numpy(np.int64)[nets(_matrix(rows["v"], kind, width))]
        return rows.assign(**{f"c{k}": centres[k] for k in range(len(RADII))})

    return run


_CENTRES = "".join(f", c{k} long" for k in range(len(RADII)))


def _cells(pivots: np.ndarray, kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = _matrix(frame["v"], kind, pivots.shape[1]) @ pivots.T
            cell = near.argmax(axis=1)
            yield frame.assign(cell=cell.astype(np.int32), far=distance(near[np.arange(len(frame)), cell]))

    return run


def _routed(pivots: np.ndarray, cells: np.ndarray, radii: np.ndarray, reach: float, kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            gap = distance(_matrix(frame["v"], kind, pivots.shape[1]) @ pivots.T)
            own = frame["block"].to_numpy()
            for at in range(0, len(frame), 512):
                row, block = np.nonzero(gap[at : at + 512][:, cells] <= radii[None, :] + reach + EPS)
                row += at
                yield pd.DataFrame({"i": np.minimum(own[row], block).astype(np.int32), "j": np.maximum(own[row], block).astype(np.int32), "own": own[row].astype(np.int32), "id": frame["id"].to_numpy()[row], "weight": frame["weight"].to_numpy()[row], "v": frame["v"].to_numpy()[row], **{f"c{k}": frame[f"c{k}"].to_numpy()[row] for k in range(len(RADII))}})

    return run


def linked_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a vector: id, n_links (other vectors of at least that cosine), component_id, kept.

    Vectors that are null, empty, all zero or hold a null or non-finite component
    link with nothing. Vectors of different lengths are compared as if the shorter
    were filled with zeros. Rows that repeat an id are vectors of their own. A row
    without an id links with nothing: its component_id is null, and it is kept. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    sound = "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    valid = rows.where(sound)
    same = settle(valid.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("key", F.monotonically_increasing_id()))
    n, width = same.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        drop(same)
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    packed = same.select(F.col("key").alias("id"), "weight", "v").mapInArrow(_packed(kind), "id long, weight long, v binary")
    n_pivots = min(MAX_PIVOTS, -(-n // BLOCK))
    chosen = packed.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()
    pivots = _matrix(chosen["v"], kind, width)
    placed = settle(packed.mapInPandas(_cells(pivots, kind), "id long, weight long, v binary, cell int, far double"))
    sizes = {r["cell"]: -(-r["n"] // BLOCK) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_PIVOTS rows
    first, cells = {}, []
    for cell in sorted(sizes):
        first[cell] = len(cells)
        cells += [cell] * sizes[cell]
    table = F.create_map(*(F.lit(x) for cell in sorted(sizes) for x in (cell, first[cell])))
    parts = F.create_map(*(F.lit(x) for cell in sorted(sizes) for x in (cell, sizes[cell])))
    blocked = placed.withColumn("block", (table[F.col("cell")] + F.pmod(F.xxhash64("id"), parts[F.col("cell")].cast("long"))).cast("int"))
    radii = np.full(len(cells), -9.0)
    for r in blocked.groupBy("block").agg(F.max("far").alias("r")).collect():  # one row for BLOCK vectors
        radii[r["block"]] = r["r"]
    reach = float(distance(np.array(cosine)))
    noded = settle(blocked.select("id", "weight", "v", "block").groupBy("block").applyInPandas(_nodes(kind, width), "id long, weight long, v binary, block int" + _CENTRES))
    routed = noded.mapInPandas(_routed(pivots, np.array(cells), radii, reach, kind), "i int, j int, own int, id long, weight long, v binary" + _CENTRES)
    found = settle(routed.groupBy("i", "j").applyInPandas(_pair(cosine, kind, width), "id long, n long, other long"))
    drop(placed, noded)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = settle(components.join(same.select(F.col("key").alias("node"), "rep"), "node"))
    labels = with_groups(named, ["component"], label=F.min("rep")).select("node", "label")
    per_vector = same.join(counts, same.key == counts.id, "left").join(labels, F.col("key") == F.col("node"), "left")
    per_vector = per_vector.select("v", F.col("weight").alias("_n"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    linked = attached(valid, settle(per_vector), ["v"]).select("id", "n_links", "component_id")
    drop(found, components, named)
    alone = rows.where(f"not coalesce({sound}, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id").withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
