"""Round trips of readers, writers and streams."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from velonet.sources import readers as R
from velonet.sources import writers as K
from velonet.streaming import events as E


def test_container_round_trip(spark, tmp_path):
    data = {"test1": np.array([3, 1, 4], np.uint32), "test2": np.array([[5, -6], [-4, 3]], np.int8), "test3": "héllo", "test4": np.array([1.5], np.float32)}
    (tmp_path / "a.uic").write_bytes(K.container_bytes(data))
    got = {r["name"]: r for r in R.read_any(spark, str(tmp_path / "a.uic")).collect()}
    assert got["test1"]["values"] == [3, 1, 4] and got["test1"]["dtype"] == "u4"
    assert got["test2"]["shape"] == [2, 2] and got["test2"]["values"] == [5, -6, -4, 3]
    assert got["test3"]["text"] == "héllo" and got["test4"]["values"] == [1.5]


def test_osm_xml(spark, tmp_path):
    text = '<osm><node id="1" lon="1.0" lat="2.0"><tag k="highway" v="stop"/></node><node id="2" lon="1.1" lat="2.0"/><node id="3" lon="1.1" lat="2.0"/><way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="path"/></way><way id="8"><nd ref="1"/><nd ref="99"/><tag k="highway" v="path"/></way></osm>'
    (tmp_path / "m.osm").write_text(text)
    nodes, ways = R.osm_xml(spark, str(tmp_path / "m.osm"))
    assert {r["node_id"]: r["tags"] for r in nodes.collect()}[1] == {"highway": "stop"}
    assert {r["way_id"]: r["refs"] for r in ways.collect()} == {7: [1, 2, 3], 8: [1, 99]}
    got = R.assemble(nodes, ways, ("highway",)).orderBy("seq").collect()
    assert [(r["way_id"], r["node_id"]) for r in got] == [(7, 1), (7, 2)]  # 3 lies on 2; way 8 lacks a node


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _zig(n):
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _field(k, v):
    return _varint(k << 3 | 2) + _varint(len(v)) + v if isinstance(v, bytes) else _varint(k << 3) + _varint(v)


def test_osm_pbf(spark, tmp_path):
    strings = b"".join(_field(1, s) for s in (b"", b"highway", b"path"))
    dense = _field(1, _zig(5) + _zig(1)) + _field(8, _zig(460000000) + _zig(10)) + _field(9, _zig(-630000000) + _zig(-10)) + _field(10, bytes([1, 2, 0, 0]))
    way = _field(1, 77) + _field(2, bytes([1])) + _field(3, bytes([2])) + _field(8, _zig(5) + _zig(1))
    block = _field(1, strings) + _field(2, _field(2, dense)) + _field(2, _field(3, way))
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    head = _field(1, b"OSMData") + _field(3, len(blob))
    (tmp_path / "m.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob)
    nodes, ways = R.osm_pbf(spark, str(tmp_path / "m.pbf"))
    got = {r["node_id"]: (round(r["lon"], 7), round(r["lat"], 7), r["tags"]) for r in nodes.collect()}
    assert got == {5: (-63.0, 46.0, {"highway": "path"}), 6: (-63.000001, 46.000001, {})}
    assert [(r["way_id"], r["refs"], r["tags"]) for r in ways.collect()] == [(77, [5, 6], {"highway": "path"})]


def test_shapefile_and_dbf(spark, tmp_path):
    body = struct.pack("<i4dii2i", 3, 0, 0, 1, 1, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 2, 2, 3, 3)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + 8 + len(body)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
    (tmp_path / "a.shp").write_bytes(head + struct.pack(">ii", 1, len(body) // 2) + body)
    rows = R.read_any(spark, str(tmp_path / "a.shp")).orderBy("part").collect()
    assert [(r["shape"], r["part"], r["xs"]) for r in rows] == [(1, 0, [0.0, 1.0]), (1, 1, [2.0, 3.0])]
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15)
    (tmp_path / "a.dbf").write_bytes(bytes(4) + struct.pack("<IHH", 1, 65, 6) + bytes(20) + field + b"\r" + b" Oak  ")
    assert R.dbf(spark, str(tmp_path / "a.dbf")).first()["fields"] == {"NAME": "Oak"}


def test_shapefile_round_trip(spark, tmp_path):
    rows = [([[0.0, 0.0, 4.0], [9.0, 9.5, 9.0]], [[0.0, 4.0, 0.0], [1.0, 1.5, 2.0]], "Elm", 7), ([[1.5, 2.5, 2.0]], [[-1.0, -1.0, 3.0]], None, 8), ([], [], "a name of more than twenty characters", 9)]
    df = spark.createDataFrame(rows, "xs array<array<double>>, ys array<array<double>>, name string, code long").coalesce(1)
    path = str(tmp_path / "o.shp")
    K.write_any(df, path)
    got = {(r["shape"], r["part"]): (r["xs"], r["ys"]) for r in R.shapefile(spark, path + "/*.shp").collect()}
    assert got == {(i + 1, p): (x, y) for i, (xs, ys, _, _) in enumerate(rows) for p, (x, y) in enumerate(zip(xs, ys, strict=True))}
    fields = {r["shape"]: r["fields"] for r in R.dbf(spark, path + "/*.dbf").collect()}
    assert fields == {1: {"name": "Elm", "code": "7"}, 2: {"name": "", "code": "8"}, 3: {"name": "a name of more than", "code": "9"}}
    with pytest.raises(FileExistsError):
        K.write_any(df, path)
    K.write_shapefile(df.filter("code < 0"), path, mode="overwrite")
    K.write_shapefile(df, path, mode="overwrite", rows_per_file=2)
    assert R.shapefile(spark, path + "/*.shp").count() == 3 and len(list((tmp_path / "o.shp").glob("*.shx"))) == 2
    with pytest.raises(ValueError):
        K.write_shapefile(df, path, kind=1)


def test_raster(spark, tmp_path):
    h = np.arange(6, dtype="<f4").reshape(2, 3)
    entries = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 24), (339, 3, 1, 3)]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4)
    (tmp_path / "a.tif").write_bytes(b"II*\0" + struct.pack("<I", 32) + h.tobytes() + ifd)
    got = {(r["col"], r["row"]): r["h"] for r in R.read_any(spark, str(tmp_path / "a.tif")).collect()}
    assert got == {(c, r): float(h[r, c]) for r in range(2) for c in range(3)}


def test_tables_config_profiles(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,\n1,2.5,zz\n3,x,yy\n")
    t = R.read_any(spark, str(tmp_path / "t.csv"))
    assert t.columns == ["a", "b"] and R.column_types(t).first().asDict() == {"a": "int", "b": "str"}
    lines = spark.createDataFrame([("ROOT /data/x y",), ("",), ("FLAG",)], "value string")
    assert [tuple(r) for r in R.config(lines).collect()] == [("ROOT", "/data/x y"), ("FLAG", "")]
    text = "profile: Work\nmax_time 30\nmax_dist 9\n" + "\n".join(f"LTS{k} 18" for k in range(-1, 5))
    assert R.profiles(text)["Work"]["max_time"] == 1800 and abs(R.profiles(text)["Work"]["lts1"] - 5) < 1e-9
    with pytest.raises(R.UnreadableFile):
        R.profiles("profile: X\nmax_time 3")
    with pytest.raises(R.UnreadableFile):
        R.read_any(spark, "a.xyz")


def test_gtfs(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_lon,stop_lat\ns1,1.5,2.5\n")
    (tmp_path / "shapes.txt").write_text("shape_id,shape_pt_sequence,shape_pt_lon,shape_pt_lat\na,10,3,4\na,2,1,2\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,25:00:10,25:01:00,s1,1\n")
    g = R.gtfs(spark, str(tmp_path))
    assert [p["lon"] for p in g["shapes"].first()["points"]] == [1.0, 3.0]
    assert g["stop_times"].first()["calls"][0]["arrival"] == 90010


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, [(0.5, -0.25), (0.000001, 0.0)])], "id int, pts array<struct<x:double,y:double>>")
    code = df.select(K.polyline(F.col("pts")).alias("c")).first()["c"]
    xs, ys = zip(*[p.split(",") for p in code.split()], strict=True)
    assert [int(v, 36) for v in xs] == [500000, 1] and [int(v, 36) for v in ys] == [-249999, 0]
    assert '"LineString"' in K.features(df, "pts", ["id"]).first()["feature"]
    K.write_any(df.select("id"), str(tmp_path / "o.csv"))
    assert R.read_any(spark, str(tmp_path / "o.csv")).collect()[0]["id"] == "1"
    made = []
    make = lambda: made.append(1) or df.select("id")
    for _ in range(2):
        assert K.stage(spark, str(tmp_path / "store"), "s", {"a": 1}, make).count() == 1
    assert len(made) == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", i % 3, "ab"[i % 2], float(i), "{}") for i in range(96)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = E.windowed(E.stream(spark, str(tmp_path / "in")), late="0 seconds").writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("w").collect()}
    want = {tuple(r) for r in E.windowed(df).collect()}
    assert got <= want and len(got) >= 6
    assert E.sessions(df).count() >= 3
