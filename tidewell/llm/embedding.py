"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one, taken from their mean and turned onto the principal
axes of the table, so the leading dimensions tell most about every distance.  A tree over
the leading axes cuts the table into tiles; two unit vectors with cosine t are at most
sqrt(2 - 2 t) apart, so tiles whose boxes are further apart never meet.  Inside a pair of
tiles the products of the leading dimensions come first; what the other dimensions can
add is at most the product of the suffix norms, and a pair is dropped as soon as the
threshold is out of reach.

Equal vectors form one class and are compared once.  A pair of tiles reports, for each
class, its number of partners and one link to a partner's root, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_groups, materialize, release, sampled
from tidewell.llm.components import connected_components, name_components
from tidewell.llm.forest import Forest

#: Tiles at least; vectors of a tile at most (about), which bounds the memory of a pair of tiles.
TILES = 12
TILE_ROWS = 32_768
#: Axes that tiles are cut along, and rows at most that the tree of cuts is made from.
AXES, TREE_ROWS = 6, 50_000
STEPS = (16, 32)
CHUNK = 256
SLACK = 1e-9


def _matrix(column, kind: str) -> np.ndarray:
    """Rows of packed numbers as a float64 matrix."""
    return np.frombuffer(b"".join(column), dtype=kind).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centred(x: np.ndarray, turn: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates on the axes, and what each vector adds to a product of coordinates to make it a cosine."""
    u = _unit(x)
    return (u - mean) @ turn, u @ mean - mean @ mean / 2


def _similar(u: np.ndarray, v: np.ndarray, add_u: np.ndarray, add_v: np.ndarray, tail_u: list, tail_v: list, cuts: list[int], least: float) -> tuple:
    """Index pairs of u and v whose cosine reaches ``least``, with the cosines."""
    k = cuts[0]
    s = u[:, :k] @ v[:, :k].T + add_u[:, None] + add_v[None, :]
    i, j = np.nonzero(s + np.outer(tail_u[0], tail_v[0]) >= least)
    if len(i) * 8 > s.size:
        s += u[:, k:] @ v[:, k:].T
        i, j = np.nonzero(s >= least)
        return i, j, s[i, j]
    s = s[i, j]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        if not len(i):
            break
        s = s + np.einsum("ij,ij->i", u[i, a:b], v[j, a:b])
        on = s + tail_u[n][i] * tail_v[n][j] >= least
        i, j, s = i[on], j[on], s[on]
    return i, j, s


def compare(x: np.ndarray, y: np.ndarray | None, wx: np.ndarray, wy: np.ndarray, turn: np.ndarray, mean: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted partners of each vector and its root, for x against y, or x against itself if y is None.

    Vectors are numbered through x, then y.
    """
    d = x.shape[1]
    cuts = sorted({min(c, d) for c in STEPS} | {d})
    ux, ax = _centred(x, turn, mean)
    uy, ay = (ux, ax) if y is None else _centred(y, turn, mean)
    tails = [[np.linalg.norm(u[:, c:], axis=1) for c in cuts] for u in (ux, uy)]
    ox, oy = np.argsort(ux[:, 0], kind="stable"), np.argsort(uy[:, 0], kind="stable")
    reach, first = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK, uy[oy, 0]
    shift = 0 if y is None else len(x)
    other, weight = (x, wx) if y is None else (y, wy)
    n = len(x) + (0 if y is None else len(y))
    partners, forest = np.zeros(n), Forest(n)
    place = np.empty(len(x), dtype=np.int64)
    place[ox] = np.arange(len(x))
    for a in range(0, len(x), CHUNK):
        rows = ox[a : a + CHUNK]
        lo = np.searchsorted(first, ux[rows[0], 0] - reach)
        cols = oy[lo : np.searchsorted(first, ux[rows[-1], 0] + reach, "right")]
        if y is None:
            cols = oy[max(a, lo) : lo + len(cols)]
        i, j, s = _similar(ux[rows], uy[cols], ax[rows], ay[cols], [t[rows] for t in tails[0]], [t[cols] for t in tails[1]], cuts, threshold - SLACK)
        i, j = rows[i], cols[j]
        if y is None:
            once = place[i] < place[j]
            i, j, s = i[once], j[once], s[once]
        near = np.flatnonzero(s < threshold + SLACK)
        if len(near):
            p, q = x[i[near]], other[j[near]]
            s[near] = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
            on = s >= threshold
            i, j = i[on], j[on]
        partners += np.bincount(i, weight[j], n) + np.bincount(j + shift, wx[i], n)
        forest.add(i, j + shift)
    forest.add(np.zeros(0, int), np.zeros(0, int))
    return partners, forest.parent


class Cuts:
    """A tree that halves a sample at medians of its widest axis, until there are ``leaves`` leaves."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.axis, self.at, self.child = [], [], []
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(1)
        if leaves < 2 or spread.max() <= 0:
            self.leaves += 1
            return -self.leaves
        axis = int(spread.argmax())
        left = leaves // 2
        at = float(np.quantile(rows[:, axis], left / leaves))
        if not (low := rows[:, axis] < at).any():
            at = float(np.nextafter(rows[:, axis].min(), np.inf))
            low = rows[:, axis] < at
        me = len(self.axis)
        self.axis.append(axis), self.at.append(at), self.child.append((0, 0))
        self.child[me] = (self._grow(rows[low], left), self._grow(rows[~low], leaves - left))
        return me

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """Number from 0 of the leaf that each row falls into."""
        at = np.full(len(rows), self.root)
        axis, cut, child = np.array(self.axis, int), np.array(self.at), np.array(self.child, int).reshape(-1, 2)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            at[inner] = child[node, (rows[inner, axis[node]] >= cut[node]).astype(int)]
        return -at - 1


def near_boxes(low: np.ndarray, high: np.ndarray, reach: float) -> list[list[int]]:
    """For each box, the boxes (itself too) that are within ``reach`` of it."""
    out = []
    for a in range(len(low)):
        gap = np.maximum(0.0, np.maximum(low - high[a], low[a] - high))
        out.append(np.flatnonzero((gap**2).sum(axis=1) <= reach * reach).tolist())
    return out


def dedup_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", tiles: int = TILES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    Vectors are linked when their cosine, in double precision, is at least ``threshold``
    (above 0).  A vector that is null, zero, or holds null or non-finite numbers links
    with nothing, nor does one whose id is null; such a row is its own component and
    kept.  Vectors of different lengths never link; each length that several vectors
    have is compared by itself, one after the other.  Rows that repeat an id count as
    vectors of their own.  Other columns are ignored.
    """
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    cast = "array<float>" if element == "float" else "array<double>"
    base = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast(cast).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("x", lambda v: v != 0)
    base = base.withColumn("_d", F.when(F.col("_id").isNotNull() & F.coalesce(finite, F.lit(False)), F.size("x")).otherwise(0))
    # One row per length; a length that one vector has can have no link.
    lengths = [r["_d"] for r in base.where("_d > 0").groupBy("_d").count().where("count > 1").orderBy("_d").collect()]
    alone = base.where(~F.col("_d").isin(lengths)).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    out = alone
    for d in lengths:
        out = _compare_all(base.where(F.col("_d") == d), d, kind, threshold, tiles, tile_rows).union(out)
    return out.withColumnRenamed("_id", id_col)


def _compare_all(base: DataFrame, d: int, kind: str, threshold: float, tiles: int, tile_rows: int) -> DataFrame:
    """(_id, n_links, component_id, kept) of the vectors x of ``base``, all valid and of length d.

    A class of equal vectors is a node, numbered when the classes are written; ids only name results.
    """
    spark = base.sparkSession
    same = [F.xxhash64("x").alias("h1"), F.hash("x").alias("h2")]
    facts = ["h1", "h2", "rep", "m", "node"]

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in facts), pa.array([r.tobytes() for r in flat], pa.binary())], names=[*facts, "v"])

    classes = base.groupBy("x").agg(F.min("_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("m"))
    classes = classes.select(*same, "rep", "m", F.monotonically_increasing_id().alias("node"), "x")
    classes = materialize(classes.mapInArrow(pack, "h1 long, h2 int, rep long, m long, node long, v binary"), "vector-classes")

    def moments(batches: Iterator) -> Iterator:
        import pandas as pd

        total, one, n = np.zeros((d, d)), np.zeros(d), 0
        for b in batches:
            if len(b):
                u = _unit(_matrix(b["v"], kind))
                total, one, n = total + u.T @ u, one + u.sum(axis=0), n + len(u)
        yield pd.DataFrame({"i": np.arange(d * d + d + 1), "s": np.concatenate([total.ravel(), one, [float(n)]])})

    sums = np.zeros(d * d + d + 1)
    for r in classes.select("v").mapInPandas(moments, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r.i] = r.s
    n = int(sums[-1])
    mean = sums[d * d : -1] / max(n, 1)
    _, axes = np.linalg.eigh(sums[: d * d].reshape(d, d) / max(n, 1) - np.outer(mean, mean))
    turn = np.ascontiguousarray(axes[:, ::-1])
    used = min(AXES, d)
    coordinates = [f"p{i}" for i in range(used)]

    def leading(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            if len(b):
                p = _centred(_matrix(b["v"], kind), turn[:, :used], mean)[0]
                yield pd.concat([b.reset_index(drop=True), pd.DataFrame(p, columns=coordinates)], axis=1)

    placed = materialize(classes.select("node", "m", "v").mapInPandas(leading, "node long, m long, v binary, " + ", ".join(f"{c} double" for c in coordinates)), "vector-axes")
    few = sampled(placed, F.col("node"), min(1.0, TREE_ROWS / max(n, 1))).select(*coordinates)
    tree = Cuts(np.array([tuple(r) for r in few.collect()]).reshape(-1, used), max(tiles, math.ceil(n / tile_rows)))

    def cut_of(batches: Iterator) -> Iterator:
        for b in batches:
            b["q"] = tree.leaf_of(b[coordinates].to_numpy()).astype("int32")
            yield b

    placed = placed.mapInPandas(cut_of, placed.schema.simpleString()[7:-1].replace(":", " ") + ", q int")
    # The boxes are those of all rows; a leaf with far more than its share is split by a hash.
    boxes = placed.groupBy("q").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}{i}") for i, c in enumerate(coordinates) for name, f in (("lo", F.min), ("hi", F.max)))).orderBy("q").collect()
    share = max(1, math.ceil(1.5 * n / max(tree.leaves, 1)))
    first, low, high = {}, [], []
    for r in boxes:
        parts = math.ceil(r["n"] / share)
        first[r["q"]] = (len(low), parts)
        low += [[r[f"lo{i}"] for i in range(used)]] * parts
        high += [[r[f"hi{i}"] for i in range(used)]] * parts
    partners_of = near_boxes(np.array(low).reshape(-1, used), np.array(high).reshape(-1, used), math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    by_cut = spark.createDataFrame([(q, f, parts) for q, (f, parts) in first.items()], "q int, first int, parts int")
    by_tile = spark.createDataFrame(list(enumerate(partners_of)), "tile int, to array<int>")
    # Both have a row per tile: n / tile_rows of them.  Each row goes to the pairs of tiles that its tile is in.
    rows = placed.join(by_cut, "q").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")).join(by_tile, "tile")
    rows = rows.select("tile", "node", "m", "v", F.explode("to").alias("to"))
    rows = rows.select(F.least("tile", "to").alias("a"), F.greatest("tile", "to").alias("b"), "tile", "node", "m", "v")

    def meet(key, part):
        import pandas as pd

        a, b = key
        left, right = part[part["tile"] == a], part[part["tile"] == b]
        if a == b:
            names = left["node"].to_numpy()
            w = left["m"].to_numpy(float)
            partners, root = compare(_matrix(left["v"], kind), None, w, w, turn, mean, threshold)
        elif len(left) and len(right):
            names = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
            partners, root = compare(_matrix(left["v"], kind), _matrix(right["v"], kind), left["m"].to_numpy(float), right["m"].to_numpy(float), turn, mean, threshold)
        else:
            return pd.DataFrame({"node": [], "n": [], "root": []})
        on = partners > 0
        return pd.DataFrame({"node": names[on], "n": partners[on].astype("int64"), "root": names[root][on]})

    met = materialize(rows.groupBy("a", "b").applyInPandas(meet, "node long, n long, root long"), "vector-links")
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    found = materialize(connected_components(met.select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-components")
    every = classes.select(*facts).join(counts, "node", "left").join(name_components(classes, found), "node", "left")
    every = every.select("h1", "h2", "m", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("name", "rep").alias("component_id"))
    every = materialize(every, "vector-facts")
    release(met, found)
    out = join_groups(base.select("_id", *same), every, ["h1", "h2"], "m")
    return out.select("_id", "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
