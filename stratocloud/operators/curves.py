"""Space-filling curves: Morton and Hilbert codes of grid cells, orders of scenes along them, and patches."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocloud.operators.scenes import SCENE, beside, settled, spread

MOST_DEPTH = 16
RANGE_BITS = 9
CROWD = 50_000

#: Bits spread three apart by halving steps: (shift, mask).
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(v: Column) -> Column:
    v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x1249249249249249))
    for (shift, _), (_, mask) in zip(reversed(_SPREAD), list(reversed(_SPREAD))[1:] + [(0, 0x1FFFFF)]):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_code(x: Column, y: Column, z: Column) -> Column:
    """Bit i of x, y and z goes to 3i + 2, 3i + 1 and 3i."""
    return F.shiftleft(_spread(x), 2).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(z))


def morton_cell(code: Column) -> tuple[Column, Column, Column]:
    return tuple(_gather(F.shiftright(code, k)) for k in (2, 1, 0))


def to_gray(v: Column) -> Column:
    return v.bitwiseXOR(F.shiftright(v, 1))


def from_gray(v: Column, bits: int = 63) -> Column:
    shift = 1
    while shift < bits:
        v = v.bitwiseXOR(F.shiftright(v, shift))
        shift *= 2
    return v


def depth_of(largest: Column) -> Column:
    """Bits that grid coordinates up to ``largest`` need (the bit length of largest + 1)."""
    return F.length(F.bin(largest + 1))


def _turned(x: list[np.ndarray], bit: int, k: int) -> None:
    """One step of Skilling's transform, in place."""
    low = (1 << bit) - 1
    on = (x[k] >> bit & 1).astype(bool)
    t = np.where(on, low, (x[0] ^ x[k]) & low)
    x[0] ^= t
    if k:
        x[k] ^= np.where(on, 0, t)


def _numbers(columns: Sequence[pa.Array]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns' values, 0 for nulls, and which rows have a null."""
    none = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)
    return [np.array(pc.fill_null(c.cast(pa.int64()), 0)) for c in columns], none


def with_hilbert(cells: DataFrame, depth: int, columns: Sequence[str] = ("gx", "gy", "gz"), name: str = "code") -> DataFrame:
    """Adds the Hilbert code by Skilling's transform, a bit plane at a time, worked out on arrays: as columns it is too long an expression to be compiled."""

    def coded(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        x, none = _numbers((a, b, c))
        for bit in reversed(range(1, depth)):
            for k in range(3):
                _turned(x, bit, k)
        x[1] ^= x[0]
        x[2] ^= x[1]
        t = np.zeros_like(x[0])
        for bit in range(1, depth):
            t ^= np.where(x[2] >> bit & 1, (1 << bit) - 1, 0)
        code = np.zeros_like(t)
        for k in range(3):
            v = (x[k] ^ t) & 0x1FFFFF
            for shift, mask in _SPREAD:
                v = (v | v << shift) & mask
            code |= v << (2 - k)
        return pa.array(code, pa.int64(), mask=none)

    return cells.withColumn(name, F.arrow_udf(coded, "long")(*map(F.col, columns)))


def with_hilbert_cell(codes: DataFrame, depth: int, code: str = "code", columns: Sequence[str] = ("gx", "gy", "gz")) -> DataFrame:
    """Adds the cell of a Hilbert code."""

    def cell(c: pa.Array) -> pa.Array:
        (v,), none = _numbers((c,))
        x = []
        for k in (2, 1, 0):
            g = v >> k & _SPREAD[-1][1]
            for (shift, _), (_, mask) in zip(reversed(_SPREAD), list(reversed(_SPREAD))[1:] + [(0, 0x1FFFFF)]):
                g = (g | g >> shift) & mask
            x.append(g)
        x = [x[0] ^ x[2] >> 1, x[1] ^ x[0], x[2] ^ x[1]]
        for bit in range(1, depth):
            for k in (2, 1, 0):
                _turned(x, bit, k)
        return pa.StructArray.from_arrays([pa.array(w, pa.int64(), mask=none) for w in x], ["a", "b", "c"])

    df = codes.withColumn("_h", F.arrow_udf(cell, "a long, b long, c long")(F.col(code)))
    return df.withColumns({c: F.col(f"_h.{n}") for c, n in zip(columns, "abc")}).drop("_h")


def batch_code(batch: Column, code: Column, depth: int) -> Column:
    """The scene's number above the code of the cell."""
    return batch.cast("long") * F.lit(1 << 3 * depth) + code


ORDERS = ("z", "z-trans", "hilbert", "hilbert-trans")


def with_codes(cells: DataFrame, depth: int, orders: Sequence[str] = ORDERS) -> DataFrame:
    """A code column for each order; ``-trans`` swaps x and y."""
    if not 0 < depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 1 to {MOST_DEPTH}")
    df = cells
    for order in orders:
        name, axes = "code_" + order.replace("-", "_"), ("gy", "gx", "gz") if order.endswith("-trans") else ("gx", "gy", "gz")
        if order.startswith("z"):
            df = df.withColumn(name, morton_code(*map(F.col, axes)))
        elif order.startswith("hilbert"):
            df = with_hilbert(df, depth, axes, name)
        else:
            raise ValueError(f"unknown order {order!r}")
    return df


def shuffled(orders: Sequence[str], seed: int) -> list[str]:
    """The orders in a random order, the same for all scenes."""
    return sorted(orders, key=lambda o: hashlib.md5(f"{seed}:order:{o}".encode()).hexdigest())


def serialize(
    cells: DataFrame, depth: int, orders: Sequence[str] = ORDERS, key: str = "pid", shuffle: int | None = None, crowd: int = CROWD,
) -> DataFrame:
    """A code and the place in its scene for each order. With ``shuffle``, a seed, the orders are shuffled, and the columns are
    order_0, code_0, place_0, order_1, ... in the order drawn.

    Rows are dealt by the leading bits of their codes: none where a scene has at most ``crowd`` rows, ``RANGE_BITS`` otherwise, and as many more
    where a range would still hold more.
    The sizes of all orders' ranges come from one aggregate.
    """
    df = with_codes(cells, depth, orders)
    codes = {o: "code_" + o.replace("-", "_") for o in orders}
    most, n = cells.groupBy(SCENE).agg(F.count("*").alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) <= crowd:  # a scene is a range: one shuffle serves all orders
        df = with_codes(spread(cells, SCENE, n=n or 0), depth, orders)
        for order, code in codes.items():
            place = F.row_number().over(W.partitionBy(SCENE).orderBy(code, key)) - 1
            df = df.withColumn(f"place_{order.replace('-', '_')}", place.cast("long"))
    else:
        df = settled(df)  # codes are long expressions, which each order's join would work out again
        sizes, crowded = _ranges(df, codes, 3 * depth, crowd)
        for order, code in codes.items():
            df = _in_range(df, order, code, crowded, 3 * depth)
            before = sizes.filter(F.col("_order") == order).select(SCENE, "_range", "_before")
            df = df.join(before, [SCENE, "_range"])
            within = F.row_number().over(W.partitionBy(SCENE, "_range").orderBy(code, key))
            df = df.withColumn(f"place_{order.replace('-', '_')}", (F.col("_before") + within - 1).cast("long")).drop("_range", "_before")
    if shuffle is None:
        return df
    drawn, out = shuffled(orders, shuffle), [c for c in cells.columns]
    for k, o in enumerate(drawn):
        name = o.replace("-", "_")
        out += [F.lit(o).alias(f"order_{k}"), F.col(f"code_{name}").alias(f"code_{k}"), F.col(f"place_{name}").alias(f"place_{k}")]
    return df.select(*out)


def _cut(code: Column, bits: int, level: int) -> Column:
    """The code with all but its leading bits of that level zero."""
    low = max(0, bits - RANGE_BITS * level)
    return F.shiftleft(F.shiftright(code, low), low)


def _ranges(df: DataFrame, codes: dict[str, str], bits: int, crowd: int) -> tuple[DataFrame, list[DataFrame]]:
    """(scene_id, _order, _range, _before) of all ranges, and for each level but the last its crowded ranges."""
    listed = F.explode(F.array(*(F.struct(F.lit(o).alias("_order"), F.col(c).alias("_code")) for o, c in codes.items()))).alias("_x")
    rows, sizes, crowded, level = df.select(SCENE, listed).select(SCENE, "_x.*"), None, [], 0
    while True:
        found = settled(rows.groupBy(SCENE, "_order", _cut(F.col("_code"), bits, level).alias("_range")).agg(F.count("*").alias("_size")))
        many = found.filter(F.col("_size") > crowd)
        last = RANGE_BITS * level >= bits or many.isEmpty()
        part = found if last else found.filter(F.col("_size") <= crowd)
        sizes = part if sizes is None else sizes.unionByName(part)
        if last:
            break
        crowded.append(many.drop("_size"))
        rows = rows.withColumn("_range", _cut(F.col("_code"), bits, level)).join(many.drop("_size"), [SCENE, "_order", "_range"], "left_semi").drop("_range")
        level += 1
    up_to = W.partitionBy(SCENE, "_order").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    return settled(sizes.select(SCENE, "_order", "_range", F.coalesce(F.sum("_size").over(up_to), F.lit(0)).alias("_before"))), crowded


def _in_range(df: DataFrame, order: str, code: str, crowded: list[DataFrame], bits: int) -> DataFrame:
    """Adds each row's ``_range`` in an order."""
    place = _cut(F.col(code), bits, 0)
    for level, many in enumerate(crowded):
        mark = many.filter(F.col("_order") == order).select(SCENE, F.col("_range").alias("_now"), F.lit(True).alias("_many"))
        df = df.withColumn("_now", _cut(F.col(code), bits, level)).join(mark, [SCENE, "_now"], "left")
        df = df.withColumn(f"_many{level}", F.coalesce("_many", F.lit(False))).drop("_now", "_many")
        place = F.when(F.col(f"_many{level}"), _cut(F.col(code), bits, level + 1)).otherwise(place)
    return df.withColumn("_range", place).drop(*(f"_many{level}" for level in range(len(crowded))))


def patches(places: DataFrame, size: int, place: str = "place") -> DataFrame:
    """Patches of ``size`` neighbours in an order; scenes of more than a patch are filled up to a whole number of them.

    The last patch borrows the points that stand as far before the end of the patch before it; those rows are ``padded``.
    """
    df = beside(places, F.count("*").alias("_n"))
    short = F.when((F.col("_n") > size) & (F.pmod("_n", F.lit(size)) != 0), F.lit(size) - F.pmod("_n", F.lit(size))).otherwise(0)
    df = df.withColumn("_short", short)
    own = df.withColumn("patch", F.floor(F.col(place) / size)).withColumn("slot", F.col(place)).withColumn("padded", F.lit(False))
    whole = F.floor(F.col("_n") / size) * size
    lent = df.filter((F.col("_short") > 0) & (F.col(place) >= F.col("_n") - size) & (F.col(place) < F.col("_n") - size + F.col("_short")))
    lent = lent.withColumn("patch", F.floor(whole / size)).withColumn("slot", F.col(place) + size).withColumn("padded", F.lit(True))
    return own.unionByName(lent).drop("_n", "_short")


def relative_bins(members: DataFrame, size: int) -> DataFrame:
    """Clamped grid offsets of all pairs within a patch; a patch has at most ``size`` points, so pairs are at most size squared a patch."""
    bound = int((4 * size) ** (1 / 3) * 2)
    n = members.count()
    a = members.select(SCENE, "patch", "pid", *(F.col(c).alias(f"a{c}") for c in ("gx", "gy", "gz")))
    b = members.select(SCENE, "patch", F.col("pid").alias("other"), "gx", "gy", "gz")
    clamp = lambda c: F.greatest(F.lit(-bound), F.least(F.col(f"a{c}") - F.col(c), F.lit(bound))) + bound
    a, b = (spread(df, SCENE, "patch", n=n) for df in (a, b))
    return a.hint("merge").join(b, [SCENE, "patch"]).select(SCENE, "patch", "pid", "other", *(clamp(c).alias(f"d{c[1]}") for c in ("gx", "gy", "gz")))
