"""Neighbours by a split tree of each scene.

A scene of more than ``LEAF`` points is cut by a k-d tree into leaves of about so many. The tree is built from a random sample, ``SAMPLE`` points for each
leaf and at most ``MOST_LEAVES`` leaves a scene (the leaves of still larger scenes grow); as it splits at medians, a few points far from the rest, or a dense
corner of a large box, change nothing. Points are shuffled once, by leaf, and each leaf is searched by itself. A point whose k-th neighbour is nearer than the closest split
on its way down the tree has its answer; the few others go on to the leaves that their ball meets, which wait as packed rows.

Trees are broadcast while all together have at most ``BROADCAST_NODES`` nodes; beyond that chunks of a scene's points meet its tree in a join. Leaves can only
become much larger than meant where very many points are at one place. Then the places are searched: of each, as many points as can be among the k nearest
of any other, and the points that ask are dealt into parts of a leaf.

Within a leaf, points are taken block by block; blocks farther from a block of queries than what it has found are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.operators.scenes import SCENE, settled

XYZ = ("x", "y", "z")
LEAF = 50_000
SAMPLE = 64
MOST_LEAVES = 1 << 16
BROADCAST_NODES = 1_000_000
CROWDED = 4  # times LEAF: a leaf beyond that holds many points at one place
BLOCK = 192
WHOLE = 1024  # points that are compared without blocks
STEP = 64
FEW = 64  # columns whose least values bound the nearest
SLACK = 1e-9  # of a distance: bounds are compared a little generously, distances exactly

#: What can be told of a point's nearest within its leaf: the sum and number of distances; moments of their places and its own.
SUMMARIES = {"sums": ("sum_d", "n"), "moments": ("xx", "xy", "xz", "yy", "yz", "zz")}

_TREE = "axis array<int>, value array<double>, left array<int>, right array<int>"


# One leaf: arrays only.


def blocks(xyz: np.ndarray, size: int = BLOCK) -> list[np.ndarray]:
    """Rows of ``xyz`` in blocks of at most ``size`` that are near one another."""
    out, todo = [], [np.arange(len(xyz))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = xyz[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(part[:, axis], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _boxes(xyz: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([xyz[p].min(axis=0) for p in parts]), np.stack([xyz[p].max(axis=0) for p in parts])


def _away(xyz: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each point from each box."""
    out = np.zeros((len(xyz), len(low)))
    for c in range(3):
        side = np.maximum(np.maximum(low[None, :, c] - xyz[:, None, c], xyz[:, None, c] - high[None, :, c]), 0)
        out += side * side
    return np.sqrt(out)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for c in range(3):
        side = a[:, None, c] - b[None, :, c]
        side *= side
        out += side
    return np.sqrt(out, out=out)


def _best(d: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row, by distance and place."""
    if d.shape[1] > k:
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
    else:
        row, col = np.nonzero(np.isfinite(d))
    return _ranked(row, d[row, col], at[row, col], len(d), k)


def _ranked(row: np.ndarray, dist: np.ndarray, place: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((place, dist, row))
    row, dist, place = row[order], dist[order], place[order]
    first = np.searchsorted(row, np.arange(n))
    rank = np.arange(len(row)) - first[row]
    near = rank < k
    out_d, out_at = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    out_d[row[near], rank[near]], out_at[row[near], rank[near]] = dist[near], place[near]
    return out_d, out_at


def knn(points: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of the k points nearest to each query, but for its ``own`` row (-1: none); ties go to smaller rows.
    inf and -1 where there are fewer, or none nearer than ``within``."""
    found, at = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64)
    if not len(points) or not len(queries):
        return found, at
    if len(points) <= WHOLE and np.isfinite(points).all() and np.isfinite(queries).all():
        return _within(*_compared(points, queries, own, k), within)
    parts = blocks(points)
    low, high = _boxes(points, parts)
    limit = np.full(len(queries), np.inf) if within is None else within
    for rows in blocks(queries):
        q = queries[rows]
        away = _away(q, low, high) * (1 - SLACK)
        least = away.min(axis=0)
        d, p, most = found[rows], at[rows], limit[rows]
        for b in np.argsort(least):
            kth = np.minimum(d[:, -1], most)
            if least[b] > kth.max():
                break
            asks = np.flatnonzero(away[:, b] <= kth)
            if not len(asks):
                continue
            part = parts[b]
            new = _apart(q[asks], points[part])
            new[own[rows[asks]][:, None] == part[None, :]] = np.inf
            both = np.concatenate([d[asks], new], axis=1)
            d[asks], p[asks] = _best(both, np.concatenate([p[asks], np.broadcast_to(part, new.shape)], axis=1), k)
        found[rows], at[rows] = d, p
    return _within(found, at, within)


def _compared(points: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``knn`` of few points: all are compared, in two buffers, by squares; only those about as near as the k-th are ordered."""
    n, wide = len(points), len(points) // FEW * FEW
    at, asks = np.ascontiguousarray(points.T), np.ascontiguousarray(queries.T)
    buffers = np.empty((2, STEP, n))
    hits = []
    for start in range(0, len(queries), STEP):
        mine = own[start : start + STEP]
        d, side = buffers[:, : len(mine)]
        for c in range(3):
            to = side if c else d
            np.subtract(asks[c, start : start + STEP, None], at[c], out=to)
            np.multiply(to, to, out=to)
            if c:
                np.add(d, side, out=d)
        has = np.flatnonzero(mine >= 0)
        d[has, mine[has]] = np.inf
        kth = np.full(len(mine), np.inf)
        if n > k:  # the k-th of some least values is no nearer than the k-th of all
            few = d[:, :wide].reshape(len(mine), -1, FEW).min(axis=1) if wide > FEW and 4 * k <= FEW else d
            kth = np.partition(few, k - 1, axis=1)[:, k - 1]
        hit = np.flatnonzero(d <= np.minimum(kth * (1 + SLACK), np.finfo(float).max)[:, None])
        hits.append((hit + start * n, np.sqrt(d.ravel()[hit])))
    row, place = np.divmod(np.concatenate([h for h, _ in hits]), n)
    return _ranked(row, np.concatenate([d for _, d in hits]), place, len(queries), k)


def summarized(summary: str, points: np.ndarray, xyz: np.ndarray, d: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """``SUMMARIES`` of what ``knn`` found."""
    hit = at >= 0
    if summary == "sums":
        return {"sum_d": np.where(hit, d, 0).sum(axis=1), "n": hit.sum(axis=1).astype(float)}
    out, step = np.zeros((len(SUMMARIES["moments"]), len(xyz))), 16 * BLOCK
    for k in range(0, len(xyz) if len(points) else 0, step):
        mask = np.pad(hit[k : k + step], ((0, 0), (0, 1)), constant_values=True)[..., None]  # the point itself is one of them, at 0
        away = np.pad(points[at[k : k + step]] - xyz[k : k + step, None], ((0, 0), (0, 1), (0, 0)))
        n = mask.sum(axis=1)
        away = np.where(mask, away - (np.where(mask, away, 0).sum(axis=1) / n)[:, None], 0)
        for j, ab in enumerate(SUMMARIES["moments"]):
            out[j, k : k + step] = (away[..., "xyz".index(ab[0])] * away[..., "xyz".index(ab[1])]).sum(axis=1) / n[:, 0]
    return dict(zip(SUMMARIES["moments"], out))


def _within(found: np.ndarray, at: np.ndarray, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if within is not None:
        out = found > within[:, None]
        found[out], at[out] = np.inf, -1
    return found, at


def count_within(points: np.ndarray, weights: np.ndarray, queries: np.ndarray, radius: float) -> np.ndarray:
    """Sums of the weights of points at most ``radius`` from each query. Blocks that lie within it whole are added up without a look at their points."""
    out = np.zeros(len(queries), np.int64)
    if not len(points) or not len(queries):
        return out
    parts = blocks(points, BLOCK // 4)
    low, high = _boxes(points, parts)
    total = np.array([weights[p].sum() for p in parts])
    for rows in blocks(queries):
        q = queries[rows]
        meets = _away(q, low, high) * (1 - SLACK) <= radius
        far = np.zeros(meets.shape)
        for c in range(3):
            side = np.maximum(np.abs(q[:, None, c] - low[None, :, c]), np.abs(q[:, None, c] - high[None, :, c]))
            far += side * side
        whole = np.sqrt(far) * (1 + SLACK) <= radius
        count = whole @ total
        rim = meets & ~whole
        for b in np.flatnonzero(rim.any(axis=0)):
            asks = np.flatnonzero(rim[:, b])
            count[asks] += (_apart(q[asks], points[parts[b]]) <= radius) @ weights[parts[b]]
        out[rows] = count
    return out


# Trees.


def split(sample: np.ndarray, leaves: int) -> tuple[list, list, list, list]:
    """axis (-1: a leaf), value (a split's place, a leaf's number), left and right of the nodes of a tree."""
    axis, value, left, right = [-1], [0.0], [-1], [-1]
    todo, n = [(0, sample, leaves)], 0
    while todo:
        node, rows, most = todo.pop()
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(3)
        a = int(np.argmax(spread))
        if most < 2 or not spread[a] > 0:
            value[node], n = float(n), n + 1
            continue
        x = rows[:, a]
        at = np.partition(x, len(x) // 2)[len(x) // 2]
        if at == x.min():
            at = x[x > at].min()
        axis[node], value[node] = a, float(at)
        left[node], right[node] = len(axis), len(axis) + 1
        for side in (axis, left, right):
            side += [-1, -1]
        value += [0.0, 0.0]
        below = x < at
        share = min(most - 1, max(1, round(most * below.mean())))
        todo += [(right[node], rows[~below], most - share), (left[node], rows[below], share)]
    return axis, value, left, right


class Tree:
    def __init__(self, axis, value, left, right):
        self.axis, self.value = np.asarray(axis, np.int64), np.asarray(value, float)
        self.next = np.stack([np.asarray(left, np.int64), np.asarray(right, np.int64)])

    def leaf_of(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each point, and how far the closest split on its way is."""
        node, edge = np.zeros(len(xyz), np.int64), np.full(len(xyz), np.inf)
        inner = np.flatnonzero(self.axis[node] >= 0)
        while len(inner):
            at = node[inner]
            x, v = xyz[inner, self.axis[at]], self.value[at]
            edge[inner] = np.minimum(edge[inner], np.abs(x - v))
            node[inner] = self.next[(x >= v).astype(np.int64), at]
            inner = inner[self.axis[node[inner]] >= 0]
        return self.value[node].astype(np.int32), edge

    def met_by(self, xyz: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves of the balls around the points."""
        row, node = np.arange(len(xyz)), np.zeros(len(xyz), np.int64)
        radius = radius * (1 + SLACK)
        rows, leaves = [row[:0]], [node[:0]]
        while len(row):
            done = self.axis[node] < 0
            rows.append(row[done])
            leaves.append(self.value[node[done]].astype(np.int64))
            row, node = row[~done], node[~done]
            away = xyz[row, self.axis[node]] - self.value[node]
            both = away <= radius[row], away >= -radius[row]
            row, node = np.concatenate([row[b] for b in both]), np.concatenate([self.next[k, node[b]] for k, b in enumerate(both)])
        return np.concatenate(rows), np.concatenate(leaves)


class Splits:
    """The trees of the scenes of ``points`` that have more than ``leaf`` points."""

    def __init__(self, points: DataFrame, leaf: int = LEAF, broadcast_nodes: int = BROADCAST_NODES):
        self.leaf, self.by_place = leaf, False
        sizes = points.groupBy(SCENE).agg(F.count("*").alias("_n")).filter(F.col("_n") > leaf)
        self.sizes = settled(sizes.withColumn("_leaves", F.least(F.ceil(F.col("_n") / leaf), F.lit(MOST_LEAVES))))
        self.trees, self.held = None, None
        if self.sizes.isEmpty():
            return
        self.trees = settled(self._grown(points))
        if (self.trees.agg(F.sum(F.size("axis"))).first()[0] or 0) <= broadcast_nodes:
            rows = self.trees.collect()  # at most broadcast_nodes nodes
            self.held = {r[SCENE]: (r["axis"], r["value"], r["left"], r["right"]) for r in rows}

    def _grown(self, points: DataFrame) -> DataFrame:
        rows = points.join(self.sizes, SCENE)
        drawn = F.pmod(F.xxhash64(F.lit("split"), "pid"), F.lit(1 << 30)) < F.col("_leaves") * SAMPLE / F.col("_n") * (1 << 30)
        sample = rows.filter(drawn).select(SCENE, *XYZ, "_leaves")

        def grow(group: pa.Table) -> pa.Table:
            xyz = np.stack([group[c].to_numpy() for c in XYZ], axis=1)
            nodes = split(xyz[np.lexsort(xyz.T)], group["_leaves"][0].as_py())
            kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32())
            columns = {n: pa.array([v], pa.list_(kind)) for n, v, kind in zip(("axis", "value", "left", "right"), nodes, kinds)}
            return pa.table({SCENE: group[SCENE].slice(0, 1).combine_chunks()} | columns)

        return sample.groupBy(SCENE).applyInArrow(grow, T.StructType([points.schema[SCENE], *T.StructType.fromDDL(_TREE)]))

    def deal(self, rows: DataFrame, radius: str | None = None) -> DataFrame:
        """``rows`` with ``leaf`` and ``edge`` (null for a scene of one leaf); with ``radius``, a column, each once for every leaf that its ball meets."""
        if self.trees is None:
            return rows.withColumns({"leaf": F.lit(0), "edge": F.lit(None).cast("double")})
        schema = T.StructType([*rows.schema, T.StructField("leaf", T.IntegerType()), T.StructField("edge", T.DoubleType())])
        if self.held is not None:
            shared = rows.sparkSession.sparkContext.broadcast(self.held)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                trees: dict = {}
                for batch in batches:
                    scenes = batch.column(batch.schema.names.index(SCENE)).dictionary_encode()
                    of = scenes.indices.to_numpy()
                    for k, scene in enumerate(scenes.dictionary.to_pylist()):
                        if scene in shared.value and scene not in trees:
                            trees[scene] = Tree(*shared.value[scene])
                        yield _dealt(batch if len(scenes.dictionary) == 1 else batch.take(pa.array(np.flatnonzero(of == k))), trees.get(scene), radius)

            return rows.mapInArrow(run, schema)
        chunks = self.sizes.select(SCENE, F.ceil(F.col("_n") / (16 * self.leaf)).cast("int").alias("_chunks"))
        many = rows.join(chunks, SCENE).withColumn("_chunk", F.pmod(F.xxhash64("pid"), F.col("_chunks")).cast("int")).drop("_chunks")
        trees = self.trees.join(chunks, SCENE).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")

        names = rows.columns

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            tree = Tree(*(right[c][0].as_py() for c in ("axis", "value", "left", "right")))
            batches = [_dealt(b, tree, radius) for b in left.select(names).combine_chunks().to_batches()]
            return pa.Table.from_batches(batches) if batches else _empty(schema)

        dealt = many.groupBy(SCENE, "_chunk").cogroup(trees.groupBy(SCENE, "_chunk")).applyInArrow(meet, schema)
        few = rows.join(chunks, SCENE, "left_anti").withColumns({"leaf": F.lit(0), "edge": F.lit(None).cast("double")})
        return few.select(*schema.names).unionByName(dealt)


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def _dealt(batch: pa.RecordBatch, tree: Tree | None, radius: str | None) -> pa.RecordBatch:
    names = batch.schema.names
    if tree is None:
        more = [pa.array(np.zeros(len(batch), np.int32)), pa.nulls(len(batch), pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "leaf", "edge"])
    xyz = np.stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in XYZ], axis=1)
    if radius is None:
        leaf, edge = tree.leaf_of(xyz)
    else:
        row, leaf = tree.met_by(xyz, batch.column(names.index(radius)).to_numpy(zero_copy_only=False))
        batch, edge = batch.take(pa.array(row)), np.zeros(len(row))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(edge)], [*names, "leaf", "edge"])


# Searches.


def _sorted_by_id(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Table]:
    table = table.take(pc.sort_indices(table["pid"])).combine_chunks()
    return table["pid"].chunk(0) if table["pid"].num_chunks else pa.array([], table["pid"].type), _xyz(table), table


def _xyz(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in XYZ], axis=1)


def _packed_row(scene, leaf, ids: pa.Array, xyz: np.ndarray, weights: np.ndarray | None) -> dict:
    """What other leaves' points ask: ids and coordinates of a leaf."""
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    weight = pa.array([weights.tobytes() if weights is not None else None], pa.binary())
    return {SCENE: scene, "leaf": pa.array([leaf], pa.int32()), "ids": listed, "at": pa.array([np.ascontiguousarray(xyz).tobytes()], pa.binary()), "weight": weight}


def _unpacked(right: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    row = right.slice(0, 1).combine_chunks()
    ids = row["ids"].chunk(0).flatten()
    weight = row["weight"][0].as_py()
    return ids, np.frombuffer(row["at"][0].as_py(), float).reshape(-1, 3), np.frombuffer(weight, np.int64) if weight else np.ones(len(ids), np.int64)


class Search:
    """What is looked for in each leaf: the k nearest, or with ``radius`` the number within it."""

    def __init__(self, scene: T.DataType, pid: T.DataType, k: int | None, radius: float | None, summary: str | None = None):
        self.k, self.radius, self.summary = k, radius, summary
        base = T.StructType().add(SCENE, scene).add("pid", pid)
        for c in XYZ:
            base.add(c, T.DoubleType())
        base.add("leaf", T.IntegerType())
        if k:
            base.add("others", T.ArrayType(pid)).add("ds", T.ArrayType(T.DoubleType()))
            for name in SUMMARIES.get(summary, ()):
                base.add(name, T.DoubleType())
        else:
            base.add("found", T.LongType())
        self.found = base.add("reach", T.DoubleType()).add("open", T.BooleanType())
        self.packed = T.StructType().add(SCENE, scene).add("leaf", T.IntegerType()).add("ids", T.ArrayType(pid)).add("at", T.BinaryType()).add("weight", T.BinaryType())
        self.both = T.StructType([*self.found, *(f for f in self.packed if f.name not in self.found.names)])
        self.columns = _empty(self.both).schema

    def answers(self, queries: pa.Table, ids: pa.Array, points: np.ndarray, weights: np.ndarray, own: np.ndarray) -> pa.Table:
        """``queries`` with what was found. ``reach``, where they have it, bounds the distances."""
        xyz = _xyz(queries)
        within = queries["reach"].to_numpy() if "reach" in queries.column_names else None
        columns = {c: queries[c] for c in (SCENE, "pid", *XYZ, "leaf")}
        if self.k:
            d, at = knn(points, xyz, own, self.k, within)
            hit, reach = at >= 0, d[:, -1]
            if self.summary:
                columns |= summarized(self.summary, points, xyz, d, at)
                if within is None:  # of the others all that is wanted is told
                    hit = hit & self._open(queries, reach)[:, None]
            ends = pa.array(np.concatenate([[0], np.cumsum(hit.sum(axis=1))]).astype(np.int32))
            columns["others"] = pa.ListArray.from_arrays(ends, ids.take(pa.array(at[hit])))
            columns["ds"] = pa.ListArray.from_arrays(ends, pa.array(d[hit]))
        else:
            reach = np.full(len(xyz), self.radius)
            count = count_within(points, weights, xyz, self.radius)
            columns["found"] = pa.array(count)
        columns["reach"] = pa.array(reach)
        columns["open"] = pa.array(self._open(queries, reach))
        return pa.table(columns)

    def _open(self, queries: pa.Table, reach: np.ndarray) -> np.ndarray:
        edge = pc.fill_null(queries["edge"], np.inf).to_numpy() if "edge" in queries.column_names else np.full(len(reach), np.inf)
        return (reach * (1 + SLACK) >= edge) & np.isfinite(edge)

    def whole_leaf(self, group: pa.Table) -> pa.Table:
        """A leaf's points ask one another; the packed leaf is the last row, if other leaves may ask."""
        ids, xyz, table = _sorted_by_id(group)
        weights = table["weight"].to_numpy() if "weight" in table.column_names else np.ones(len(ids), np.int64)
        found = self.answers(table, ids, xyz, weights, np.arange(len(ids)))
        schema = self.columns
        rows = pa.table({f.name: found[f.name] if f.name in found.column_names else pa.nulls(len(found), f.type) for f in schema}, schema)
        if table["edge"].null_count == len(table):
            return rows
        row = _packed_row(table[SCENE].slice(0, 1).combine_chunks(), table["leaf"][0].as_py(), ids, xyz, weights if "weight" in table.column_names else None)
        return pa.concat_tables([rows, pa.table({f.name: row[f.name] if f.name in row else pa.nulls(1, f.type) for f in schema}, schema)])

    def pack(self, group: pa.Table) -> pa.Table:
        ids, xyz, table = _sorted_by_id(group)
        return pa.table(_packed_row(table[SCENE].slice(0, 1).combine_chunks(), table["leaf"][0].as_py(), ids, xyz, None), _empty(self.packed).schema)

    def asked(self, left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries meet a packed leaf."""
        schema = _empty(self.found).schema
        if not len(left):
            return schema.empty_table()
        left = left.combine_chunks()
        if len(right):
            ids, xyz, weights = _unpacked(right)
        else:
            ids, xyz, weights = pa.array([], schema.field("pid").type), np.zeros((0, 3)), np.zeros(0, np.int64)
        own = pc.fill_null(pc.index_in(left["pid"].combine_chunks(), ids), -1).to_numpy().astype(np.int64) if len(ids) else np.full(len(left), -1)
        return self.answers(left, ids, xyz, weights, own).select(schema.names).cast(schema)


def _finite(rows: DataFrame) -> DataFrame:
    return rows.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in XYZ))


def _dealt_apart(rows: DataFrame, packed: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Both by (scene, leaf, part): a leaf that very many ask has several parts, to each of which its row is sent."""
    parts = settled(rows.groupBy(SCENE, "leaf").agg(F.ceil(F.count("*") / size).cast("int").alias("_parts")))
    left = rows.join(parts, [SCENE, "leaf"]).withColumn("_part", F.pmod(F.xxhash64("pid"), F.col("_parts")).cast("int")).drop("_parts")
    right = packed.join(parts, [SCENE, "leaf"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left, right


def _ask(search: Search, rows: DataFrame, packed: DataFrame, size: int) -> DataFrame:
    left, right = _dealt_apart(rows, packed, size)
    keys = [SCENE, "leaf", "_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda asks, leaf: search.asked(asks, leaf), search.found)


def _first_answers(search: Search, points: DataFrame, queries: DataFrame | None, k: int | None, leaf: int, broadcast_nodes: int) -> tuple:
    """Answers from each query's own leaf, the packed leaves (None if no scene has several) and the trees."""
    splits = Splits(points, leaf, broadcast_nodes)
    dealt = splits.deal(points)
    if splits.trees is not None:
        dealt = settled(dealt)
        crowded = dealt.groupBy(SCENE, "leaf").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > CROWDED * leaf
        if crowded and k:
            first = W.partitionBy(SCENE, *XYZ).orderBy("pid")  # ties go to smaller ids, so no other is among the k nearest of any point
            few = settled(points.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= k + 1).drop("_at"))
            queries = points if queries is None else queries
            splits = Splits(few, leaf, broadcast_nodes)
            dealt = splits.deal(few)
        elif crowded:  # points at one place count together
            few = settled(points.groupBy(SCENE, *XYZ).agg(F.min("pid").alias("pid"), F.count("*").alias("weight")))
            splits = Splits(few, leaf, broadcast_nodes)
            splits.by_place = True
            dealt = splits.deal(few)
    if queries is None:
        all_ = dealt.groupBy(SCENE, "leaf").applyInArrow(lambda leaf: search.whole_leaf(leaf), search.both)
        all_ = all_ if splits.trees is None else settled(all_)  # without trees it is read once
        packed = all_.filter("at IS NOT NULL").select(*search.packed.names) if splits.trees is not None else None
        return all_.filter("at IS NULL").select(*search.found.names), packed, splits
    packed = settled(dealt.groupBy(SCENE, "leaf").applyInArrow(lambda leaf: search.pack(leaf), search.packed))
    return settled(_ask(search, splits.deal(queries), packed, leaf)), packed if splits.trees is not None else None, splits


def _further(search: Search, found: DataFrame, packed: DataFrame, splits: Splits) -> DataFrame:
    """Answers of the other leaves that open queries meet."""
    asks = found.filter("open").select(SCENE, "pid", *XYZ, F.col("leaf").alias("_own"), "reach")
    asks = splits.deal(asks, "reach").filter(F.col("leaf") != F.col("_own")).drop("_own", "edge")
    return _ask(search, settled(asks), packed, splits.leaf)


def _merged(search: Search, found: DataFrame, packed: DataFrame, splits: Splits, k: int) -> DataFrame:
    """(scene_id, pid, other, d, rank) of the queries that ask several leaves."""
    more = found.filter("open").select(SCENE, "pid", "others", "ds").unionByName(_further(search, found, packed, splits).select(SCENE, "pid", "others", "ds"))
    more = more.select(SCENE, "pid", F.explode(F.arrays_zip("others", "ds")).alias("x")).select(SCENE, "pid", F.col("x.others").alias("other"), F.col("x.ds").alias("d"))
    order = W.partitionBy(SCENE, "pid").orderBy("d", "other")
    return settled(more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def nearest(points: DataFrame, k: int, queries: DataFrame | None = None, leaf: int = LEAF, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(scene_id, pid, other, d, rank) of the k points nearest to each point, or to each of ``queries``, itself left out; ties go to the smaller id.

    Rows are scene_id, pid (unique in its scene), x, y and z; those without coordinates neither ask nor are found."""
    columns = (SCENE, "pid", *XYZ)
    points, queries = (None if d is None else _finite(d.select(*columns)) for d in (points, queries))
    search = Search(points.schema[SCENE].dataType, points.schema["pid"].dataType, k, None)
    found, packed, splits = _first_answers(search, points, queries, k, leaf, broadcast_nodes)
    listed = F.posexplode(F.arrays_zip("others", "ds")).alias("rank", "x")
    out = [SCENE, "pid", F.col("x.others").alias("other"), F.col("x.ds").alias("d"), (F.col("rank") + 1).alias("rank")]
    done = found if packed is None else found.filter("NOT open")
    done = done.select(SCENE, "pid", listed).select(*out)
    if packed is None:
        return done
    return done.unionByName(_merged(search, found, packed, splits, k))


def summaries(points: DataFrame, k: int, summary: str, leaf: int = LEAF, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(scene_id, pid, the columns of ``SUMMARIES``) of the k nearest of each point. They are worked out where a leaf is searched; only of points that ask several
    leaves are neighbours listed. If no scene has several leaves, nothing is kept: it is searched again each time the result is read."""
    points = _finite(points.select(SCENE, "pid", *XYZ))
    search = Search(points.schema[SCENE].dataType, points.schema["pid"].dataType, k, None, summary)
    found, packed, splits = _first_answers(search, points, None, k, leaf, broadcast_nodes)
    out = [SCENE, "pid", *SUMMARIES[summary]]
    if packed is None:
        return found.select(*out)
    listed = _merged(search, found, packed, splits, k)
    if summary == "sums":
        more = listed.groupBy(SCENE, "pid").agg(F.sum("d").alias("sum_d"), F.count("*").cast("double").alias("n"))
    else:
        near = listed.join(points.withColumnRenamed("pid", "other"), [SCENE, "other"]).select(SCENE, "pid", *XYZ)
        near = near.unionByName(found.filter("open").select(SCENE, "pid", *XYZ))
        more = near.groupBy(SCENE, "pid").agg(*(F.covar_pop(*ab).alias(ab) for ab in SUMMARIES["moments"]))
    return found.filter("NOT open").select(*out).unionByName(more)


def counts_within(points: DataFrame, radius: float, leaf: int = LEAF, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(scene_id, pid, neighbours): how many other points each point has within the radius."""
    points = _finite(points.select(SCENE, "pid", *XYZ))
    search = Search(points.schema[SCENE].dataType, points.schema["pid"].dataType, None, float(radius))
    found, packed, splits = _first_answers(search, points, None, None, leaf, broadcast_nodes)
    counts = found.select(SCENE, "pid", *XYZ, "found")
    if packed is not None:
        counts = counts.unionByName(_further(search, found, packed, splits).select(SCENE, "pid", *XYZ, "found"))
        counts = counts.groupBy(SCENE, "pid", *XYZ).agg(F.sum("found").alias("found"))
    if splits.by_place:
        counts = points.join(counts.drop("pid"), [SCENE, *XYZ])
    return counts.select(SCENE, "pid", (F.col("found") - 1).alias("neighbours"))
