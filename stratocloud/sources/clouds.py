"""Point-cloud files: PLY and NPZ contents to rows and back, one file a scene. Contents travel as a binary column, as
Spark's ``binaryFile`` reader gives them, so that any store that Spark reads will do.

A file is made by one task from one scene, and a binary cell holds at most 2 GB: some 75 million points with colours and normals. Larger scenes
are written as Parquet (``write_scenes``), which has no such limit."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.operators.scenes import SCENE

XYZ, RGB, NORMAL = ("x", "y", "z"), ("r", "g", "b"), ("nx", "ny", "nz")
_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
_NAMES = {"red": "r", "green": "g", "blue": "b"}


def ply_bytes(columns: dict[str, np.ndarray], normals_first: bool = False) -> bytes:
    """A binary PLY of x, y, z and, where all three are there, colours and normals. Colours of at most 1 are taken as shares of 255."""
    groups = [(XYZ, "float", "<f4")]
    rest = [(RGB, "uchar", "u1"), (NORMAL, "float", "<f4")]
    groups += [g for g in (rest[::-1] if normals_first else rest) if all(c in columns for c in g[0])]
    long = {v: k for k, v in _NAMES.items()}
    names = [(c, kind, t) for g, kind, t in groups for c in g]
    data = np.empty(len(columns["x"]), [(c, t) for c, _, t in names])
    for c, _, _ in names:
        v = columns[c]
        if c in RGB and len(v) and max(np.max(columns[k]) for k in RGB) <= 1.0:
            v = v * 255
        data[c] = v
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(data)}", *(f"property {kind} {long.get(c, c)}" for c, kind, _ in names), "end_header\n"]
    return "\n".join(head).encode() + data.tobytes()


def read_ply(content: bytes) -> dict[str, np.ndarray]:
    """Columns of the vertices of a binary or text PLY; colours and normals only if all three of them are there."""
    end = content.index(b"end_header")
    start = content.index(b"\n", end) + 1
    fields, n, here, text, order = [], 0, False, False, "<"
    for line in content[:end].decode("ascii").splitlines():
        part = line.split()
        if part[:1] == ["format"]:
            text, order = part[1] == "ascii", ">" if "big" in part[1] else "<"
        elif part[:1] == ["element"]:
            here = part[1] == "vertex"
            n = int(part[2]) if here else n
        elif part[:1] == ["property"] and here:
            fields.append((_NAMES.get(part[2], part[2]), _TYPES[part[1]].replace("<", order)))
    if text:
        rows = np.loadtxt(io.BytesIO(content[start:]), max_rows=n, ndmin=2)
        data = {name: rows[:, k] for k, (name, _) in enumerate(fields)}
    else:
        table = np.frombuffer(content, np.dtype(fields), n, start)
        data = {name: table[name] for name, _ in fields}
    keep = [*XYZ, *(c for g in (RGB, NORMAL) if all(k in data for k in g) for c in g)]
    return {c: data[c] for c in keep}


def _encode(points: DataFrame, writer, columns: list[str]) -> DataFrame:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pid")
        content = writer({c: t[c].to_numpy() for c in columns})
        return pa.table({SCENE: pa.array([key[0].as_py()], t[SCENE].type), "content": pa.array([content], pa.binary())})

    kind = points.schema[SCENE].dataType.simpleString()
    return points.select(SCENE, "pid", *columns).groupBy(SCENE).applyInArrow(run, f"{SCENE} {kind}, content binary")


def encode_ply(points: DataFrame, normals_first: bool = False) -> DataFrame:
    """(scene_id, content): each scene's file."""
    columns = [c for c in (*XYZ, *RGB, *NORMAL) if c in points.columns]
    return _encode(points, lambda c: ply_bytes(c, normals_first), columns)


def npz_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """coord, and where they are there color, normal and segment."""
    out = io.BytesIO()
    stack = {n: np.stack([columns[c] for c in g], 1).astype(t) for n, g, t in (("coord", XYZ, "f4"), ("color", RGB, "u1"), ("normal", NORMAL, "f4")) if all(c in columns for c in g)}
    np.savez(out, **stack, **({"segment": columns["segment"]} if "segment" in columns else {}))
    return out.getvalue()


def read_npz(content: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        data = {}
        for name, group in (("coord", XYZ), ("color", RGB), ("normal", NORMAL)):
            if name in z.files:
                data |= {c: z[name][:, k] for k, c in enumerate(group)}
        return data | ({"segment": z["segment"]} if "segment" in z.files else {})


def encode_npz(points: DataFrame) -> DataFrame:
    return _encode(points, npz_bytes, [c for c in (*XYZ, *RGB, *NORMAL, "segment") if c in points.columns])


def encode_npy(points: DataFrame) -> DataFrame:
    """(scene_id, name, content): coord.npy, color.npy and normal.npy of each scene, the last two only where the columns are there."""
    groups = [(n, g, t) for n, g, t in (("coord", XYZ, "f4"), ("color", RGB, "u1"), ("normal", NORMAL, "f4")) if all(c in points.columns for c in g)]

    def content(columns: dict[str, np.ndarray], group: tuple[str, ...], kind: str) -> bytes:
        out = io.BytesIO()
        np.save(out, np.stack([columns[c] for c in group], 1).astype(kind))
        return out.getvalue()

    files = None
    for name, group, kind in groups:
        one = _encode(points, lambda c, g=group, k=kind: content(c, g, k), list(group)).select(SCENE, F.lit(f"{name}.npy").alias("name"), "content")
        files = one if files is None else files.unionByName(one)
    return files


def write_files(files: DataFrame, root: str) -> None:
    """Writes each ``content`` to ``root``/``path`` (a local or mounted folder, or any store that Arrow knows). Tasks write their own rows; a
    task that is run again writes the same bytes anew."""

    def write(rows: Iterator) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for row in rows:
            at = f"{base}/{row['path']}"
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as out:
                out.write(bytes(row["content"]))

    files.select("path", "content").foreachPartition(write)


def _decode(files: DataFrame, reader) -> DataFrame:
    kinds = {**dict.fromkeys(XYZ, pa.float64()), **dict.fromkeys(RGB, pa.int32()), **dict.fromkeys(NORMAL, pa.float64()), "segment": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in enumerate(batch.column(1)):
                data = reader(content.as_py())
                n = len(data["x"])
                scene = pa.array([batch.column(0)[k].as_py()] * n, batch.column(0).type)
                columns = [pa.array(np.asarray(data[c]).astype(t.to_pandas_dtype())) if c in data else pa.nulls(n, t) for c, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([scene, pa.array(np.arange(n)), *columns], [SCENE, "row", *kinds])

    kind = files.schema[SCENE].dataType.simpleString()
    schema = f"{SCENE} {kind}, row bigint, " + ", ".join(f"{c} {'double' if t == pa.float64() else 'int'}" for c, t in kinds.items())
    return files.select(SCENE, "content").mapInArrow(run, schema)


def decode_ply(files: DataFrame) -> DataFrame:
    """scene_id, row and the columns of every vertex; a group that a file lacks is null."""
    return _decode(files, read_ply)


def decode_npz(files: DataFrame) -> DataFrame:
    return _decode(files, read_npz)


def load_files(spark, path: str, glob: str = "*.ply") -> DataFrame:
    """(scene_id, content) of all files below a folder; the scene is the folder's name, or the file's if it has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias(SCENE), "content")


def write_scenes(points: DataFrame, path: str) -> None:
    """Parquet, a folder a scene, rows of a file in order of their keys. Scenes are dealt by ranges of (scene, key), so a large one is
    several files, written by several tasks."""
    points.repartitionByRange(SCENE, "pid").sortWithinPartitions(SCENE, "pid").write.mode("overwrite").partitionBy(SCENE).parquet(path)
