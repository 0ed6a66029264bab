"""Writers: tables, GeoJSON rows, web polylines, typed containers, and the store of stage results."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet.functions.text import base36

from . import filesink


def write_any(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write by suffix: parquet, csv with a header, JSON lines, or shapefiles of polygons (see write_shapefile)."""
    kind = path.lower().rsplit(".", 1)[-1]
    out = df.write.mode(mode)
    if kind == "parquet":
        out.parquet(path)
    elif kind == "csv":
        out.option("header", True).csv(path)
    elif kind in ("json", "geojson"):
        out.json(path)
    elif kind == "shp":
        write_shapefile(df, path, mode=mode)
    else:
        raise ValueError(path)


def polyline(points: Column) -> Column:
    """Points (x, y in degrees from a centre) as millionths in base 36: "x,y x,y ...".

    Half a millionth is added before the fraction is cut off towards zero, also below zero.
    """
    n = lambda v: base36((v * 1000000 + 0.5).cast("long"))
    return F.array_join(F.transform(points, lambda p: F.concat(n(p["x"]), F.lit(","), n(p["y"]))), " ")


def unpolyline(text: Column) -> Column:
    """Inverse of polyline(), in millionths."""
    n = lambda s: F.when(s.startswith("-"), -F.conv(F.substring(s, 2, 20), 36, 10).cast("long")).otherwise(F.conv(s, 36, 10).cast("long"))
    return F.transform(F.split(text, " "), lambda p: F.struct(n(F.get(F.split(p, ","), 0)).alias("x"), n(F.get(F.split(p, ","), 1)).alias("y")))


def features(df: DataFrame, points: str, properties: list[str]) -> DataFrame:
    """(feature): a GeoJSON LineString row by row, ready for a text or JSON sink."""
    coords = F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    geometry = F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def shapefile_bytes(kind: int, shapes: list[tuple[list, list]], fields: list[str], records: list[tuple], width: int = 20) -> tuple[bytes, bytes, bytes]:
    """The .shp, .shx and .dbf files of shapes (lists of x by part, lists of y by part) of ``kind`` 3 or 5.

    Attributes are text of ``width`` bytes, longer ones are cut; names of ten characters. A shape without points is a null shape.
    """
    body, index, boxes = bytearray(), bytearray(), []
    for number, (xs, ys) in enumerate(shapes, 1):
        parts = [np.column_stack([np.asarray(x, "<f8"), np.asarray(y, "<f8")]) for x, y in zip(xs, ys, strict=True) if len(x)]
        if parts:
            points = np.concatenate(parts)
            boxes.append([*points.min(axis=0), *points.max(axis=0)])
            starts = np.cumsum([0, *map(len, parts[:-1])]).astype("<i4")
            content = struct.pack("<i4dii", kind, *boxes[-1], len(parts), len(points)) + starts.tobytes() + points.tobytes()
        else:
            content = struct.pack("<i", 0)
        index += struct.pack(">ii", 50 + len(body) // 2, len(content) // 2)
        body += struct.pack(">ii", number, len(content) // 2) + content
    b = np.array(boxes) if boxes else np.zeros((1, 4))
    box = [*b[:, :2].min(axis=0), *b[:, 2:].max(axis=0)]
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)
    cell = lambda v, n: ("" if v is None else str(v)).encode("latin-1", "replace")[:n].ljust(n)
    columns = b"".join(f.encode("latin-1", "replace")[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width, 0]) + bytes(14) for f in fields)
    rows = b"".join(b" " + b"".join(cell(v, width) for v in r) for r in records)
    dbf = bytes([3, 100, 1, 1]) + struct.pack("<IHH", len(records), 33 + len(columns), 1 + width * len(fields)) + bytes(20) + columns + b"\r" + rows + b"\x1a"
    return head(len(body)) + bytes(body), head(len(index)) + bytes(index), dbf


def write_shapefile(df: DataFrame, path: str, kind: int = 5, mode: str = "error", rows_per_file: int = 100_000) -> None:
    """Write rows (xs, ys: coordinates by part; all other columns are attributes) as shapefiles in the folder ``path``.

    Tasks encode at most ``rows_per_file`` rows into one file and write it themselves; the driver sees no content (see
    filesink). A shapefile holds 2 GB at most, so this is an export of results, not of raw data.
    """
    if kind not in (3, 5):
        raise ValueError(f"shape type {kind}")
    fields = [c for c in df.columns if c not in ("xs", "ys")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, held = TaskContext.get().partitionId(), 0, []

        def file(rows: list) -> pd.DataFrame:
            made = shapefile_bytes(kind, [(r[0], r[1]) for r in rows], fields, [r[2:] for r in rows])
            return pd.DataFrame({"name": [f"part-{task:05d}-{n:03d}.{suffix}" for suffix in ("shp", "shx", "dbf")], "content": made})

        for batch in batches:
            held += batch.itertuples(index=False, name=None)
            while len(held) >= rows_per_file:
                yield file(held[:rows_per_file])
                held, n = held[rows_per_file:], n + 1
        if held:
            yield file(held)

    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if fs.exists(folder):
        if mode != "overwrite":
            raise FileExistsError(path)
        fs.delete(folder, True)
    fs.mkdirs(folder)
    text = df.select("xs", "ys", *[F.col(f"`{c}`").cast("string").alias(c) for c in fields])
    filesink.write_files(text.mapInPandas(run, "name string, content binary"), path)


def container_bytes(entries: dict[str, np.ndarray | str]) -> bytes:
    """A typed container in memory (see readers.container)."""
    out = bytearray()
    for name, v in entries.items():
        head = name.encode("ascii")[:63].ljust(63, b"\0")
        if isinstance(v, str):
            data = v.encode("utf-8")
            out += bytes([64 + 3]) + head + struct.pack("<Q", len(data)) + data
        else:
            kind = {"u": 1, "i": 2, "f": 3}[v.dtype.kind]
            out += bytes([16 * kind + 3 + v.dtype.itemsize.bit_length() - 1]) + head + struct.pack(f"<{v.ndim + 1}Q", v.ndim, *v.shape) + v.astype(v.dtype.newbyteorder("<")).tobytes()
    return bytes(out) + b"\0"


def stage(spark: SparkSession, store: str, name: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's result from the store, made and written there first if this stage with these parameters is new."""
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{store.rstrip('/')}/{name}-{key}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
