"""Readers: everything comes through Spark's own file access, so any store that Spark reaches will do."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBERS = "array<struct<kind:string,ref:long,role:string>>"
NODE_SCHEMA = "node_id long, lon double, lat double, tags map<string,string>"
WAY_SCHEMA = "way_id long, refs array<long>, tags map<string,string>"


class UnreadableFile(ValueError):
    """A file of a kind that no reader knows, or that its reader cannot use."""


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Read by suffix; anything unknown raises UnreadableFile."""
    kind = path.rsplit("/", 1)[-1].lower().rsplit(".", 1)[-1]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "txt"):
        return csv_table(spark, path)
    if kind in ("json", "geojson"):
        return spark.read.option("multiLine", True).json(path)
    if kind == "gml":
        return spark.read.format("xml").option("rowTag", "featureMember").load(path)
    if kind == "shp":
        return shapefile(spark, path)
    if kind in ("tif", "tiff"):
        return raster(spark, path)
    if kind in ("uic", "uia"):
        return container(spark, path)
    if kind in ("xls", "xlsx"):
        return excel_table(spark, path)
    raise UnreadableFile(path)


def typed(col: Column) -> Column:
    """What a cell holds: int, float or str."""
    d = F.trim(col).try_cast("double")
    return F.when(d.isNull(), "str").when(d == F.floor(d), "int").otherwise("float")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose header is the leading non-empty cells of the first row; all columns as strings."""
    df = spark.read.option("header", True).csv(path)
    named = []
    for c in df.columns:
        if c.startswith("_c") and c[2:].isdigit():
            break
        named.append(c)
    return df.select(*[F.col(f"`{c}`") for c in named])


def column_types(df: DataFrame) -> DataFrame:
    """One row: for each column the widest type of its cells (int < float < str)."""
    order = {"int": 0, "float": 1, "str": 2}
    code = lambda c: F.max(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), typed(F.coalesce(F.col(f"`{c}`"), F.lit("")))))
    return df.agg(*[F.get(F.array(*map(F.lit, order)), code(c)).alias(c) for c in df.columns])


def excel_table(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of a workbook, read in one task; all columns as strings, in rows of arrays with the header first."""

    def sheet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                t = pd.read_excel(io.BytesIO(content), header=None, dtype=str)
                yield pd.DataFrame({"row": range(len(t)), "cells": t.fillna("").to_numpy().tolist()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(sheet, "row int, cells array<string>")


def osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an OpenStreetMap XML file."""
    tag = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))
    node = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_lon", T.DoubleType()), T.StructField("_lat", T.DoubleType()), T.StructField("tag", tag)])
    way = T.StructType([T.StructField("_id", T.LongType()), T.StructField("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))), T.StructField("tag", tag)])
    tags = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))).alias("tags")
    nodes = spark.read.format("xml").option("rowTag", "node").schema(node).load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema(way).load(path)
    return nodes.select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), tags), ways.select(F.col("_id").alias("way_id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), tags)


def osm_xml_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations (relation_id, members, tags) of an OpenStreetMap XML file; members (kind, ref, role) in their order."""
    text = lambda *names: T.StructType([T.StructField(n, T.LongType() if n in ("_id", "_ref") else T.StringType()) for n in names])
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("member", T.ArrayType(text("_type", "_ref", "_role"))), T.StructField("tag", T.ArrayType(text("_k", "_v")))])
    rows = spark.read.format("xml").option("rowTag", "relation").schema(schema).load(path)
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("kind"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role")))
    tags = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>")))
    return rows.select(F.col("_id").alias("relation_id"), F.coalesce(members, F.array().cast(MEMBERS)).alias("members"), tags.alias("tags"))


def member_ways(relations: DataFrame) -> DataFrame:
    """Rows (relation_id, way_id, role) of the ways among the members of multipolygons and boundaries."""
    some = relations.filter(F.try_element_at("tags", F.lit("type")).isin("multipolygon", "boundary"))
    return some.select("relation_id", F.explode("members").alias("m")).filter("m.kind = 'way'").select("relation_id", F.col("m.ref").alias("way_id"), "m.role")


def osm_bounds(text: Column) -> Column:
    """(minlat, minlon, maxlat, maxlon) from the head of an OpenStreetMap file."""
    one = lambda k: F.regexp_extract(text, rf'{k}="([-0-9.]+)"', 1).try_cast("double").alias(k)
    return F.struct(*[one(k) for k in ("minlat", "minlon", "maxlat", "maxlon")])


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, varint or bytes)."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif key & 7 == 5:
            value, at = data[at : at + 4], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _numbers(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def _primitives(block: bytes) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Nodes, ways and relations of one primitive block."""
    strings: list[str] = []
    groups, scale, lat0, lon0 = [], 100, 0, 0
    for k, v in _fields(block):
        if k == 1:
            strings = [s.decode("utf-8") for _, s in _fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k == 19:
            lat0 = v
        elif k == 20:
            lon0 = v
    nodes, ways, relations = [], [], []
    for group in groups:
        for k, v in _fields(group):
            if k == 2:
                f = dict(_fields(v))
                ids, lats, lons = (np.cumsum(_numbers(f[i], True)) for i in (1, 8, 9))
                pairs = iter(_numbers(f.get(10, b"")))
                for i, la, lo in zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True):
                    tags = {}
                    for key in pairs:
                        if key == 0:
                            break
                        tags[strings[key]] = strings[next(pairs)]
                    nodes.append((i, 1e-9 * (lon0 + scale * lo), 1e-9 * (lat0 + scale * la), tags))
            elif k == 3:
                f = dict(_fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(_numbers(f.get(2, b"")), _numbers(f.get(3, b"")), strict=True)}
                ways.append((f[1], np.cumsum(_numbers(f.get(8, b""), True)).tolist(), tags))
            elif k == 4:
                f = dict(_fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(_numbers(f.get(2, b"")), _numbers(f.get(3, b"")), strict=True)}
                members = zip(_numbers(f.get(10, b"")), np.cumsum(_numbers(f.get(9, b""), True)).tolist(), _numbers(f.get(8, b"")), strict=True)
                relations.append((f[1], [(("node", "way", "relation")[kind], ref, strings[role]) for kind, ref, role in members], tags))
    return nodes, ways, relations


def _blobs(content: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        head = dict(_fields(content[at + 4 : at + 4 + n]))
        at += 4 + n
        body = content[at : at + head[3]]
        at += head[3]
        if head[1] == b"OSMData":
            yield body


def _pbf(spark: SparkSession, path: str, kind: int, schema: str) -> DataFrame:
    """Nodes, ways or relations of an OpenStreetMap binary file, split into its compressed blobs, which are dealt out."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for k, body in enumerate(_blobs(content)):
                    yield pd.DataFrame({"k": [k], "body": [body]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch["body"]:
                f = dict(_fields(body))
                got = _primitives(f[1] if 1 in f else zlib.decompress(f[3]))[kind]
                if got:
                    yield pd.DataFrame(got, columns=[c.split()[0] for c in schema.split(", ")])

    blobs = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "k int, body binary").repartition("k")
    return blobs.mapInPandas(decode, schema)


def osm_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an OpenStreetMap binary file."""
    return _pbf(spark, path, 0, NODE_SCHEMA), _pbf(spark, path, 1, WAY_SCHEMA)


def osm_pbf_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations (relation_id, members, tags) of an OpenStreetMap binary file, as osm_xml_relations gives them."""
    return _pbf(spark, path, 2, f"relation_id long, members {MEMBERS}, tags map<string,string>")


def assemble(nodes: DataFrame, ways: DataFrame, keys: tuple[str, ...], frame: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Vertices (way_id, seq, node_id, lon, lat) of ways with any of ``keys`` all of whose nodes lie in ``frame``.

    Consecutive equal nodes and consecutive equal places count once; ways of fewer than two vertices go.
    """
    from pyspark.sql import Window as W

    if frame:
        left, right, low, high = frame
        nodes = nodes.filter(F.col("lon").between(left, right) & F.col("lat").between(low, high))
    kept = ways.filter(F.exists(F.map_keys("tags"), lambda k: k.isin(*keys)))
    flat = kept.select("way_id", F.size("refs").alias("n"), F.posexplode("refs").alias("seq", "node_id"))
    placed = flat.join(nodes.select("node_id", "lon", "lat"), "node_id")
    w = W.partitionBy("way_id").orderBy("seq")
    full = placed.withColumns({"found": F.count(F.lit(1)).over(W.partitionBy("way_id")), "same": (F.lag("lon").over(w) == F.col("lon")) & (F.lag("lat").over(w) == F.col("lat"))})
    line = full.filter("found = n and not coalesce(same, false)")
    return line.withColumn("left", F.count(F.lit(1)).over(W.partitionBy("way_id"))).filter("left > 1").select("way_id", "seq", "node_id", "lon", "lat")


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shape, part, xs, ys) of polylines and polygons, one for each part; other kinds raise UnreadableFile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                kind = struct.unpack("<i", content[32:36])[0]
                if kind not in (3, 5):
                    raise UnreadableFile(f"shape type {kind}")
                at, rows = 100, []
                while at + 8 < len(content):
                    number, words = struct.unpack(">ii", content[at : at + 8])
                    body = content[at + 8 : at + 8 + 2 * words]
                    at += 8 + 2 * words
                    if struct.unpack("<i", body[:4])[0] == 0:
                        continue
                    n_parts, n_points = struct.unpack("<ii", body[36:44])
                    first = [*np.frombuffer(body, "<i4", n_parts, 44).tolist(), n_points]
                    xy = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
                    rows += [(number, p, xy[a:b, 0].tolist(), xy[a:b, 1].tolist()) for p, (a, b) in enumerate(zip(first, first[1:], strict=False))]
                yield pd.DataFrame(rows, columns=["shape", "part", "xs", "ys"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "shape int, part int, xs array<double>, ys array<double>")


def dbf(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shape, fields) of a shapefile's attribute table: a map of trimmed strings, shapes counted from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["content"]:
                n, head, size = struct.unpack("<IHH", c[4:12])
                fields, at = [], 32
                while c[at] != 13:
                    fields.append((c[at : at + 11].split(b"\0")[0].decode("latin-1"), c[at + 16]))
                    at += 32
                rows = []
                for i in range(n):
                    p, row = head + i * size + 1, {}
                    for name, width in fields:
                        row[name] = c[p : p + width].decode("latin-1").strip()
                        p += width
                    rows.append((i + 1, row))
                yield pd.DataFrame(rows, columns=["shape", "fields"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "shape int, fields map<string,string>")


def raster(spark: SparkSession, path: str) -> DataFrame:
    """Cells (col, row, h) of a single-band TIFF of 32-bit floats or 16-bit integers, uncompressed or deflated strips."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["content"]:
                e = "<" if c[:2] == b"II" else ">"
                (at,) = struct.unpack(e + "I", c[4:8])
                (n,) = struct.unpack(e + "H", c[at : at + 2])
                tags = {}
                for i in range(n):
                    tag, kind, count = struct.unpack(e + "HHI", c[at + 2 + 12 * i : at + 10 + 12 * i])
                    form, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, (None, 0))
                    if form:
                        raw = c[at + 10 + 12 * i : at + 14 + 12 * i]
                        p = struct.unpack(e + "I", raw)[0] if size * count > 4 else None
                        tags[tag] = struct.unpack(e + form * count, c[p : p + size * count] if p is not None else raw[: size * count])
                width, height = tags[256][0], tags[257][0]
                parts = [c[o : o + m] for o, m in zip(tags[273], tags[279], strict=True)]
                if tags.get(259, (1,))[0] in (8, 32946):
                    parts = [zlib.decompress(p) for p in parts]
                kind = {(32, 3): "f4", (16, 2): "i2", (16, 1): "u2"}[tags[258][0], tags.get(339, (1,))[0]]
                h = np.frombuffer(b"".join(parts), e + kind)[: width * height].reshape(height, width)
                for r in range(height):
                    yield pd.DataFrame({"col": np.arange(width), "row": r, "h": h[r].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "col long, row long, h double")


def container(spark: SparkSession, path: str) -> DataFrame:
    """Entries (name, dtype, shape, text, values) of typed containers: strings as text, arrays flattened as doubles.

    An entry is a type byte (kind * 16 + log2 of the bits), a name of 63 bytes, then for a string its byte length and
    bytes, for an array the number of dimensions, their lengths and little-endian data; a zero byte ends the file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["content"]:
                at, rows = 0, []
                while c[at]:
                    kind, bits = divmod(c[at], 16)
                    name = c[at + 1 : at + 64].split(b"\0")[0].decode("latin-1")
                    at += 64
                    (n,) = struct.unpack("<Q", c[at : at + 8])
                    at += 8
                    if kind == 4:
                        rows.append((name, "text", [], c[at : at + n].decode({3: "utf-8", 4: "utf-16-le", 5: "utf-32-le"}[bits]), None))
                        at += n
                    elif kind in (1, 2, 3):
                        shape = struct.unpack(f"<{n}Q", c[at : at + 8 * n])
                        at += 8 * n
                        form = " uif"[kind] + str(2 ** (bits - 3))
                        count = int(np.prod(shape))
                        v = np.frombuffer(c, "<" + form, count, at)
                        at += v.nbytes
                        rows.append((name, form, list(shape), None, v.astype(float).tolist()))
                    else:
                        raise UnreadableFile(f"entry type {c[at - 72]}")
                yield pd.DataFrame(rows, columns=["name", "dtype", "shape", "text", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, dtype string, shape array<long>, text string, values array<double>")


def config(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, rest) of configuration lines: the key ends at the first space."""
    s = F.trim(F.col(column))
    return lines.filter(s != "").select(F.substring_index(s, " ", 1).alias("key"), F.ltrim(F.when(F.instr(s, " ") > 0, F.expr(f"substring(trim(`{column}`), instr(trim(`{column}`), ' '))")).otherwise("")).alias("rest"))


def profiles(text: str) -> dict[str, dict[str, float]]:
    """Cyclist profiles of a text: minutes to seconds, km to metres, km/h to metres a second; a missing field raises."""
    out: dict[str, dict[str, float]] = {}
    name = None
    for line in filter(None, map(str.strip, text.split("\n"))):
        key, _, rest = line.replace(":", " ").strip().partition(" ")
        key, words = key.lower(), rest.split()
        if key == "profile":
            name = " ".join(words)
            out[name] = {}
        elif name is None:
            raise UnreadableFile(f"outside a profile: {line}")
        elif key not in ("note", "notes"):
            unit = 60.0 if key.endswith("_time") else 1000.0 if key == "max_dist" else 1 / 3.6
            out[name][key] = float(words[0]) * unit
    need = {"max_time", "max_dist", *(f"lts{k}" for k in range(-1, 5))}
    for name, fields in out.items():
        if need - set(fields):
            raise UnreadableFile(f"{name} lacks {sorted(need - set(fields))}")
    return out


def gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """stops, shapes (ordered points of each) and stop_times (ordered calls of each trip, in seconds)."""
    from velonet.functions.arrays import clock_seconds

    read = lambda n: spark.read.option("header", True).csv(f"{folder}/{n}.txt")
    stops = read("stops").select("stop_id", F.col("stop_lon").cast("double").alias("lon"), F.col("stop_lat").cast("double").alias("lat"))
    pts = F.array_sort(F.collect_list(F.struct(F.col("shape_pt_sequence").cast("int").alias("seq"), F.col("shape_pt_lon").cast("double").alias("lon"), F.col("shape_pt_lat").cast("double").alias("lat"))))
    calls = F.array_sort(F.collect_list(F.struct(F.col("stop_sequence").cast("int").alias("seq"), clock_seconds(F.col("arrival_time")).alias("arrival"), clock_seconds(F.col("departure_time")).alias("departure"), "stop_id")))
    return {"stops": stops, "shapes": read("shapes").groupBy("shape_id").agg(pts.alias("points")), "stop_times": read("stop_times").groupBy("trip_id").agg(calls.alias("calls"))}
