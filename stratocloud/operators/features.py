"""Feature vectors: similarity, heat, linear probes, principal components and test-time variants."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.operators.places import numbered
from stratocloud.operators.scenes import settled


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity_to(features: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """``similarity`` of every row to the vector of ``query``'s one row."""
    one = query.select(vector).first()[0]  # a single vector
    return features.withColumn("similarity", cosine(F.col(vector), F.array(*(F.lit(float(v)) for v in one))))


PIVOTS = 256  # rows drawn as centres of groups
SLACK = 1e-9  # of similarities worked out in another order
ANGLE_SLACK = 1e-6
BLOCK_ROWS = 5_000  # of rows that meet a part of a head
MATCH_ROWS = 50_000  # at most, of each side in a task that compares all pairs of two blocks: what is shuffled grows with the rows times the blocks
LEAST_ROWS = 5_000  # blocks are not made smaller than that to give every core some
BLOCK_VALUES = 4_000_000  # numbers in a block
STEP, WIDE = 512, 4096  # queries and rows that are compared at once
PAIRS = 1_000_000  # that are compared by the expression at once


def _dealt(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _directed(vector: str) -> Column:
    size = F.sqrt(dot(F.col(vector), F.col(vector)))
    return F.coalesce((size > 0) & (size < float("inf")), F.lit(False))


def _block_rows(rows: DataFrame, vector: str, most: int) -> tuple[int, int]:
    """The number of rows, and how many go into a block: enough blocks of both sides for every core, none too wide to be held."""
    n, width = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks = math.ceil(math.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))
    return n, max(1, min(most, BLOCK_VALUES // max(1, width or 1), max(LEAST_ROWS, -(-n // blocks))))


def best_match(features: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", block_rows: int = MATCH_ROWS, itself: bool = True) -> DataFrame:
    """The most similar row to each query, of equals the smaller id; without ``itself`` not the row of the query's own id.

    Both sides are dealt into blocks of at most about ``block_rows``; a task compares one block of queries with one of rows, as matrices, and only rows within ``SLACK`` of
    the best once more, as the expression ``cosine`` does. It hands on one row a query. Pairs without similarity (null or zero vectors) win only where a query has no others.
    """
    no_self = F.lit(True) if itself else F.col("query") != F.col("other")
    real = features.filter(_directed(vector)).select(F.col(key).alias("other"), F.col(vector).alias("v"))
    asked = queries.filter(_directed(vector)).select(F.col(key).alias("query"), F.col(vector).alias("q"))
    n_a, n_b = (max(1, -(-n // most)) for n, most in (_block_rows(asked, "q", block_rows), _block_rows(real, "v", block_rows)))
    left = asked.select("*", _dealt(F.col("query"), n_a).alias("_a"), _each(n_b).alias("_b"))
    right = real.select("*", _dealt(F.col("other"), n_b).alias("_b"), _each(n_a).alias("_a"))
    best = settled(_picked(_compared(left, right, ("_a", "_b"), n_a * n_b, itself)))
    # the least id of all is the answer to a query that is similar to nothing
    alone = queries.select(F.col(key).alias("query")).join(best, "query", "left_anti")
    least = features.select(F.col(key).alias("other")).orderBy(F.col("other").asc_nulls_last()).limit(2)
    rest = alone.crossJoin(least).filter(no_self).groupBy("query").agg(F.min("other").alias("other")).withColumn("similarity", F.lit(None).cast("double"))
    return best.unionByName(rest)


def _compared(left: DataFrame, right: DataFrame, keys: Sequence[str], tasks: int, itself: bool) -> DataFrame:
    """(query, other, similarity): each query's best row of each block that it meets. They are long work on little data, so they are dealt into ``tasks``, not by bytes."""
    found = T.StructType([left.schema["query"], right.schema["other"], T.StructField("similarity", T.DoubleType())])
    n = max(1, min(tasks, 10_000))
    sides = (d.repartition(n, *keys).groupBy(*keys) for d in (left, right))
    return next(sides).cogroup(next(sides)).applyInArrow(_comparison(itself), found)


def _picked(every: DataFrame) -> DataFrame:
    pick = F.min_by(F.struct("other", "similarity"), F.struct(-F.col("similarity"), F.col("other")))
    return every.groupBy("query").agg(pick.alias("m")).select("query", "m.*")


def _comparison(itself: bool):
    """Compares a table of queries with one of rows: (query, other, similarity) of each query's best row.

    Where queries have ``floor``, a similarity already found, only rows as good are told; where they have ``meets``, bits of groups, they are compared with these groups' rows only.
    """

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            right = _least_of_equals(right, 1 if itself else 2)
            q, v = (_matrix(t[c].combine_chunks()) for t, c in ((left, "q"), (right, "v")))
            sides = [np.ascontiguousarray(x.T) for x in (q, v)]
            norms = [np.sqrt(_summed(x, x)) for x in sides]
            uq, uv = _unit(q), _unit(v)
            ids = _ranks(right["other"])
            meets = _bits(left["meets"].combine_chunks()) if "meets" in left.column_names else np.ones((len(left), 1), bool)
            parts = _slices(right["group"].to_numpy() if "meets" in left.column_names else np.zeros(len(right), int))
            floor = left["floor"].to_numpy() if "floor" in left.column_names else np.full(len(left), -np.inf)
            best = np.where(np.isfinite(floor), floor, -np.inf)
            own = (np.zeros(0, np.int64),) * 2 if itself else _own(left["query"], right["other"], ids)
            for start in range(0, len(q), STEP):
                rows = np.arange(start, min(start + STEP, len(q)))
                mine = slice(*np.searchsorted(own[0], (start, start + STEP)))
                hits = []
                for asks, part in _tiles(rows, meets[rows], parts):
                    near = uq[asks] @ uv[part].T
                    at, to = own[0][mine], own[1][mine] - part.start
                    there = (to >= 0) & (to < near.shape[1]) & np.isin(at, asks)
                    near[np.searchsorted(asks, at[there]), to[there]] = -np.inf
                    most = near.max(axis=1)
                    new = np.flatnonzero((most >= best[asks] - SLACK) & np.isfinite(most))
                    best[asks[new]] = np.maximum(best[asks[new]], most[new])
                    row, col = np.nonzero(near[new] >= best[asks[new], None] - SLACK)
                    hits.append((asks[new[row]], col + part.start, near[new[row], col]))
                if hits:
                    row, col, near = map(np.concatenate, zip(*hits))
                    close = near >= best[row] - SLACK
                    found.append(_best_of(row[close], col[close], sides, norms, ids))
        row, col, similarity = map(np.concatenate, zip(*found))
        return pa.table({"query": left["query"].take(pa.array(row)), "other": right["other"].take(pa.array(col)), "similarity": similarity})

    return compare


def _best_of(row: np.ndarray, col: np.ndarray, sides: list[np.ndarray], norms: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs, each row's with the greatest similarity, of equals the smaller id."""
    value = np.empty(len(row))
    for k in range(0, len(row), PAIRS):
        r, c = row[k : k + PAIRS], col[k : k + PAIRS]
        value[k : k + PAIRS] = _summed(*sides, r, c) / (norms[0][r] * norms[1][c])
    order = np.lexsort((ids[col], -value, row))
    order = order[np.r_[True, row[order][1:] != row[order][:-1]][: len(order)]]
    return row[order], col[order], value[order]


def _summed(a: np.ndarray, b: np.ndarray, row=slice(None), col=slice(None)) -> np.ndarray:
    """``dot`` of columns, added up in the same order."""
    out = np.zeros(a[:1, row].shape[1])
    for x, y in zip(a, b):
        out += x[row] * y[col]
    return out


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    return pc.rank(ids.combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)


def _least_of_equals(rows: pa.Table, n: int) -> pa.Table:
    """``rows`` by group, but of equal vectors only those of the ``n`` least ids: no other can be an answer, and copies of a vector would all be close to one another."""
    rows = rows.combine_chunks()
    x = np.ascontiguousarray(_matrix(rows["v"].combine_chunks()))
    same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    ids = _ranks(rows["other"])
    order = np.lexsort((ids, same))
    first = np.r_[True, same[order][1:] != same[order][:-1]]
    new = first | np.r_[True, ids[order][1:] != ids[order][:-1]]
    count = np.cumsum(new)
    keep = order[new & (count - np.maximum.accumulate(np.where(first, count, 0)) < n)]
    if "group" in rows.column_names:
        keep = keep[np.argsort(rows["group"].to_numpy()[keep], kind="stable")]
    return rows.take(pa.array(keep)).combine_chunks()


def _slices(groups: np.ndarray) -> list[tuple[int, slice]]:
    """Groups, in order, and where their rows are, at most ``WIDE`` at once."""
    found, first = np.unique(groups, return_index=True)
    ends = zip(found.tolist(), first.tolist(), [*first.tolist()[1:], len(groups)])
    return [(g, slice(k, min(k + WIDE, b))) for g, a, b in ends for k in range(a, b, WIDE)]


def _tiles(rows: np.ndarray, meets: np.ndarray, parts: list[tuple[int, slice]]) -> Iterator[tuple[np.ndarray, slice]]:
    """Which of ``rows`` are compared with which slice; slices side by side that all of them meet are one."""
    whole, every = None, meets.all(axis=0)
    for group, part in parts:
        if every[group] and whole and part.stop - whole.start <= WIDE:
            whole = slice(whole.start, part.stop)
            continue
        if whole:
            yield rows, whole
        whole = part if every[group] else None
        if not every[group] and meets[:, group].any():
            yield rows[meets[:, group]], part
    if whole:
        yield rows, whole


def _bits(meets: pa.Array) -> np.ndarray:
    bits = np.frombuffer(b"".join(meets.to_pylist()), np.uint8).reshape(len(meets), -1)
    return np.unpackbits(bits, axis=1).view(bool)


def _own(queries: pa.ChunkedArray, others: pa.ChunkedArray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of queries and rows of the same id, by query."""
    order = np.argsort(ids, kind="stable")
    at = pc.fill_null(pc.index_in(queries.combine_chunks(), others.combine_chunks()), -1).to_numpy()
    has = np.flatnonzero(at >= 0)
    low, high = (np.searchsorted(ids[order], ids[at[has]], side) for side in ("left", "right"))
    n = high - low
    return np.repeat(has, n), order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _chained(centres: np.ndarray) -> np.ndarray:
    """Centres in an order in which each is followed by the nearest of the rest, so that groups that share a block are near one another."""
    left, order = list(range(1, len(centres))), [0]
    while left:
        order.append(left.pop(int(np.argmax(centres[left] @ centres[order[-1]]))))
    return centres[order]


def _shelved(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each group and the number of its blocks: a group of over ``most`` rows is dealt into several of its own, others share one."""
    first, blocks, last, free = [], -(-sizes // most), -1, 0
    for n, k in zip(sizes, np.maximum(1, blocks)):
        if k > 1 or n > free:
            last, free = last + 1, most
        first.append(last)
        last, free = (last + k - 1, 0) if k > 1 else (last, free - n)
    return np.array(first), np.maximum(1, blocks)


def pruned_match(
    features: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block_rows: int = MATCH_ROWS, itself: bool = True, seed: int = 42,
) -> DataFrame:
    """The rows of :func:`best_match`, exactly, without comparing what cannot win.

    Rows are dealt to the nearest of ``pivots`` rows, drawn by a keyed hash (that many at most, which is what is broadcast). Angles obey the triangle inequality, so no row
    of a group is nearer to a query than the query's angle to the pivot less the largest angle in the group. A query is first compared with its own group; then only with
    the groups that this bound leaves. Groups share blocks of at most about ``block_rows``, and a query goes once to each block that has a group for it, with the list of
    its groups, so that even where nothing can be left out no more is shuffled than by ``best_match``.
    Rows without direction (null, empty or zero vectors) have no similarity and go to nobody; queries like that are answered as by ``best_match``.
    """
    real = features.filter(_directed(vector)).select(F.col(key).alias("other"), F.col(vector).alias("v"))
    asked = queries.filter(_directed(vector)).select(F.col(key).alias("query"), F.col(vector).alias("q"))
    rest = queries.filter(~_directed(vector))
    drawn = real.orderBy(F.xxhash64(F.lit(seed), "other"), "other").limit(pivots).collect()  # a bounded sample
    if not drawn:
        return best_match(features, queries, key, vector, block_rows, itself)
    centres = _chained(_unit(np.array([r["v"] for r in drawn], float)))
    shared = features.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_matrix(batch.column(1)), shared.value)
                own = np.argmin(angles, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], [*batch.schema.names, "group", "angle"])

    placed = [T.StructField("group", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    rows, asks = (settled(d.mapInArrow(near, T.StructType([*d.schema, *placed]))) for d in (real, asked))
    reach, sizes, asking = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
    for g, r, n in rows.groupBy("group").agg(F.max("angle"), F.count("*")).collect():  # at most ``pivots`` rows
        reach[g], sizes[g] = r, n
    for g, n in asks.groupBy("group").agg(F.count("*")).collect():
        asking[g] = n
    shelf, deck = _shelved(sizes, _block_rows(rows, "v", block_rows)[1]), _shelved(asking, _block_rows(asks, "q", block_rows)[1])
    of = lambda values: F.element_at(F.array(*map(F.lit, values.tolist())), F.col("group") + 1).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(of(blocks[0]), of(blocks[0] + blocks[1] - 1)))
    one_of = lambda blocks, name: (of(blocks[0]) + F.pmod(F.xxhash64(name), of(blocks[1]))).cast("int")
    rows = rows.select("other", "v", "group", one_of(shelf, "other").alias("shelf"))
    asks = asks.select("query", "q", "group", one_of(deck, "query").alias("deck"))
    first = asks.withColumn("shelf", all_of(shelf)), rows.withColumn("deck", all_of(deck))
    tasks = max(features.sparkSession.sparkContext.defaultParallelism, int((sizes * asking).sum()) // LEAST_ROWS**2)
    one = settled(_compared(*first, ("group", "shelf", "deck"), min(tasks, int((shelf[1] * deck[1]).sum())), itself))

    holds = np.zeros((len(centres), int((shelf[0] + shelf[1]).max())), np.float32)  # which groups each block has rows of
    for g in np.flatnonzero(sizes):
        holds[g, shelf[0][g] : shelf[0][g] + shelf[1][g]] = 1
    known = features.sparkSession.sparkContext.broadcast((centres, reach, holds))
    ask = T.StructType([*asks.schema, *T.StructType.fromDDL("floor double, meets binary, shelves array<int>")])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach, holds = known.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1_000):
                batch = whole.slice(k, 1_000)
                floor, own = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("floor", "group"))
                bound = _angles(_matrix(batch.column(1)), centres) - reach  # of the angle to any row of each group
                best = np.where(np.isfinite(floor), np.arccos(np.clip(floor, -1, 1)), np.inf)
                meets = (bound <= best[:, None] + ANGLE_SLACK) & (reach > -np.inf)
                meets[np.arange(len(own)), own] = False
                row, at = np.nonzero(meets.astype(np.float32) @ holds)
                ends = pa.array(np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32))
                bits = pa.array([b.tobytes() for b in np.packbits(meets, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, bits, pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32)))], ask.names)

    so_far = one.groupBy("query").agg(F.max("similarity").alias("floor"))
    asks = settled(asks.join(so_far, "query", "left").select(*ask.names[:5]).mapInArrow(to_blocks, ask))
    left = asks.withColumn("shelf", F.explode("shelves")).drop("shelves", "group")
    pairs = settled(left.select("deck", "shelf").distinct())  # of blocks
    two = _compared(left, rows.join(pairs, "shelf"), ("deck", "shelf"), pairs.count(), itself)
    out = _picked(one.unionByName(two))
    return out if rest.isEmpty() else out.unionByName(best_match(features, rest, key, vector, block_rows, itself))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ centres.T, -1, 1))


def heat(scored: DataFrame, value: str = "similarity", key: str = "vec_id") -> DataFrame:
    """Similarities as heat: the values at ranks 2 % and 10 % from the top and 50 % set the scale; below the middle one heat fades by 0.9."""
    placed = numbered(scored, F.desc(value), F.col(key))
    n = placed.count()
    at = {s: min(n - 1, int(n * s)) for s in (0.02, 0.1, 0.5)}
    marks = dict(placed.filter(F.col("_place").isin(*at.values())).select("_place", value).collect())  # three rows
    high, mid, low = (F.lit(marks.get(at[s])).cast("double") for s in at)
    up, down = F.try_divide(F.col(value) - mid, high - mid), F.try_divide(F.col(value) - mid, mid - low)
    sig = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.coalesce(x, F.lit(0.0))))
    return scored.withColumn("heat", F.when(F.col(value) >= mid, sig(up)).otherwise(F.lit(0.9) * sig(down)))


def linear_probe(features: DataFrame, head: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 10_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, class_id, logit): the class of the largest w x + b, of equals the smaller. ``head`` has class_id, weight, bias, a row a class.

    A head of at most ``most`` classes meets every row where it is; a larger one is dealt into parts of so many, and the rows into blocks of about
    ``block_rows``, so that a task holds one block and one part and their number follows both tables.
    """
    parts = max(1, -(-head.count() // most))
    blocks = 1 if parts == 1 else max(1, -(-features.count() // block_rows))
    left = features.select(key, vector, _dealt(F.col(key), blocks).alias("_a"), _each(parts).alias("_b"))
    right = head.select("class_id", "weight", "bias", _dealt(F.col("class_id"), parts).alias("_b"), _each(blocks).alias("_a"))
    met = left.crossJoin(F.broadcast(right.drop("_a", "_b"))) if parts == 1 else left.join(right, ["_a", "_b"])
    scored = met.withColumn("logit", dot(F.col("weight"), F.col(vector)) + F.col("bias"))
    best = F.min_by(F.struct("class_id", "logit"), F.struct(-F.col("logit"), F.col("class_id")))
    return scored.groupBy(key).agg(best.alias("m")).select(key, "m.*")


def resolve_width(features: DataFrame, columns: Sequence[str], width: int) -> str:
    """The first column whose vectors have the width that the head wants."""
    first = features.select(*(F.size(c).alias(c) for c in columns)).first()
    for c in columns:
        if first is not None and first[c] == width:
            return c
    raise ValueError(f"no representation of width {width}")


def pca_colors(features: DataFrame, vector: str = "embedding", brightness: float = 1.2) -> DataFrame:
    """r, g, b in 0..1: 0.6 of components 1-3 and 0.4 of 4-6 of the vectors as they are, stretched to 0..1, brightened and clamped."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = features.withColumn("_v", array_to_vector(F.col(vector)))
    df = PCA(k=6, inputCol="_v", outputCol="_p").fit(df).transform(df).withColumn("_a", vector_to_array("_p"))
    mixed = [0.6 * F.get("_a", F.lit(k)) + 0.4 * F.get("_a", F.lit(k + 3)) for k in range(3)]
    df = df.withColumns({f"_c{k}": v for k, v in enumerate(mixed)})
    lows, highs = ({k: df.agg(f(f"_c{k}")).scalar() for k in range(3)} for f in (F.min, F.max))
    out = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(f"_c{k}") - lows[k], highs[k] - lows[k]), F.lit(0.0)) * brightness)) for k, c in enumerate("rgb")}
    return df.withColumns(out).drop("_v", "_p", "_a", "_c0", "_c1", "_c2")


#: Quarter turns, and scales of the test-time variants; one more is mirrored.
TURNS = (0.0, 0.5, 1.0, 1.5)
SCALES = (1.0, 0.95, 1.05)


def test_variants(points: DataFrame) -> DataFrame:
    """Thirteen copies of each point: four quarter turns at three scales about the origin, and one mirrored; ``variant`` numbers them."""
    import math

    plans = [(round(math.cos(t * math.pi)), round(math.sin(t * math.pi)), s, 1.0) for s in SCALES for t in TURNS] + [(1, 0, 1.0, -1.0)]
    rows = F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(float(c)).alias("c"), F.lit(float(s)).alias("s"), F.lit(z).alias("k"), F.lit(m).alias("m")) for k, (c, s, z, m) in enumerate(plans)))
    df = points.withColumn("_t", F.explode(rows))
    t = lambda n: F.col(f"_t.{n}")
    moved = {"x": (F.col("x") * t("c") - F.col("y") * t("s")) * t("k") * t("m"), "y": (F.col("x") * t("s") + F.col("y") * t("c")) * t("k") * t("m"), "z": F.col("z") * t("k")}
    return df.withColumn("variant", t("variant")).withColumns(moved).drop("_t")


def split_of(rows: DataFrame, splits: str | Sequence[str], column: str = "split") -> DataFrame:
    return rows.filter(F.col(column).isin(*([splits] if isinstance(splits, str) else splits)))
