"""Residents keep their parcels' totals, whatever way lines enter; tiles are read back as drawn; files are committed whole."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velonet.operators import placement as P
from velonet.operators import tiles as R
from velonet.operators.polygons import clip_segments
from velonet.sources import filesink

PARCELS = "poly long, xs array<double>, ys array<double>, pop double"
SEGMENTS = "line long, seg long, x1 double, y1 double, x2 double, y2 double, len double"


def _segments(lines):
    return [(n, i, *map(float, a), *map(float, b), math.dist(a, b)) for n, pts in lines.items() for i, (a, b) in enumerate(zip(pts, pts[1:], strict=False), 1)]


def test_placed_residents(spark):
    # 1 and 2 share a border at x = 100; 3 has a notch from above, so that a straight line leaves and enters again
    notch = ([200.0, 300.0, 300.0, 260.0, 260.0, 240.0, 240.0, 200.0], [0.0, 0.0, 100.0, 100.0, 40.0, 40.0, 100.0, 100.0])
    box = lambda l: ([l, l + 100.0, l + 100.0, l], [0.0, 0.0, 100.0, 100.0])
    rows = [(1, *box(0.0), 60.0), (2, *box(100.0), 10.0), (3, *notch, 8.0), (4, *box(0.0), 0.0), (5, *box(0.0), None), (6, *box(9000.0), 7.0), (7, [], [], 5.0)]
    lines = {10: [(-50, 50), (50, 50), (150, 50)], 11: [(190, 70), (310, 70)], 12: [(20, 90), (20, 99)], 13: [(-9, -9), (-9, 200)]}
    got = [tuple(r) for r in P.placed_residents(spark.createDataFrame(rows, PARCELS), spark.createDataFrame(_segments(lines), SEGMENTS), 30.0, 64.0).collect()]
    by = lambda p, n: sorted(tuple(round(v, 6) for v in r[2:]) for r in got if r[:2] == (p, n))
    # 100 m in parcel 1: a margin of 5 m, four points; with the 9 m of line 12 in its middle the weights are 20, 30, 30, 30 and 9
    assert [r[:3] for r in by(1, 10)] == [(55, 5, 50), (85, 35, 50), (115, 65, 50), (145, 95, 50)]
    assert [r[3] for r in by(1, 10)] == [round(60 * w / 119, 6) for w in (20, 30, 30, 30)]
    assert by(1, 12) == [(4.5, 20, 94.5, round(60 * 9 / 119, 6))]
    # parcel 2 also holds the first 10 m of line 11, which is shorter than a step
    assert [r[1] for r in by(2, 10)] == [110, 140] and [r[3] for r in by(2, 10)] == [round(10 * 25 / 65, 6), round(10 * 30 / 65, 6)]
    assert by(2, 11) == [(5, 195, 70, round(10 * 10 / 65, 6))]
    # two runs of 40 m: each a margin of 5 m, weights 20 and 30
    assert [(r[1], r[3]) for r in by(3, 11)] == [(205, 1.6), (235, 2.4), (265, 1.6), (295, 2.4)]
    assert {r[:2] for r in got} == {(1, 10), (1, 12), (2, 10), (2, 11), (3, 11)}
    none = P.placed_residents(spark.createDataFrame([], PARCELS), spark.createDataFrame(_segments(lines), SEGMENTS), 30.0, 64.0)
    assert none.count() == 0


def test_many_short_segments_are_one_run(spark):
    r = random.Random(5)
    cuts = sorted({0.0, 997.0, *(round(r.uniform(0, 997), 3) for _ in range(200))})
    lines = {1: [(c, 0.0) for c in cuts]}
    parcel = spark.createDataFrame([(1, [-10.0, 1500.0, 1500.0, -10.0], [-5.0, -5.0, 5.0, 5.0], 100.0)], PARCELS)
    got = sorted(r["pos"] for r in P.placed_residents(parcel, spark.createDataFrame(_segments(lines), SEGMENTS), 50.0, 100.0).collect())
    assert len(got) == 20 and all(abs(p - (23.5 + 50 * k)) < 1e-6 for k, p in enumerate(got))


def test_frame_takes_what_meets_it(spark):
    rows = [(1, 1, -5.0, 5.0, 15.0, 5.0), (2, 1, -1.0, -1.0, -1.0, 20.0), (3, 1, 4.0, 4.0, 5.0, 5.0), (4, 1, 8.0, 14.0, 14.0, 8.0), (5, 1, 10.0, 10.0, 20.0, 20.0), (6, 1, 3.0, 3.0, 3.0, 3.0), (7, 1, 30.0, 3.0, 30.0, 3.0)]
    df = spark.createDataFrame(rows, "line long, seg long, x1 double, y1 double, x2 double, y2 double")
    assert {r["line"] for r in R.in_frame(df, 0, 10, 0, 10).collect()} == {1, 3, 5, 6}


def test_tiles_round_trip(spark, tmp_path):
    rows = [(1, -3.5, 0.5, 4.5, 0.5, 5), (2, 0.5, -2.5, 0.5, 2.5, 7), (3, 0.5, 0.5, 0.5, 0.5, 6), (4, 3.5, 3.5, 3.5, 3.5, None)]
    drawn = R.pixels(spark.createDataFrame(rows, "line long, x1 double, y1 double, x2 double, y2 double, value int"), "value", 1.0, 4)
    seen = {(r["tile_x"] * 4 + r["px"], r["tile_y"] * 4 + r["py"]): (r["value"], r["n"]) for r in drawn.collect()}
    want = {(x, 0): (5, 1) for x in range(-4, 5)} | {(0, y): (7, 1) for y in range(-3, 3)} | {(0, 0): (7, 3)}
    assert seen == want
    folder = str(tmp_path / "tiles")
    filesink.write_files(R.tile_files(drawn, 4), folder)
    read = {(r["tile_x"] * 4 + r["px"], r["tile_y"] * 4 + r["py"]): r["value"] for r in R.tiles_read(spark, folder, 4).collect()}
    assert read == {k: v[0] for k, v in want.items()}
    low = {r["value"] for r in R.pixels(spark.createDataFrame(rows[:3], "line long, x1 double, y1 double, x2 double, y2 double, value int"), "value", 1.0, 4, lowest=True).filter("tile_x = 0 and tile_y = 0 and px = 0 and py = 0").collect()}
    assert low == {5}


def test_picture_keeps_values():
    grid = np.random.default_rng(3).integers(-1, 8, (9, 13))
    assert (R.indexes(R.picture(grid)) == np.where(grid < 0, 8, grid)).all()


def test_files_are_committed_whole(spark, tmp_path):
    folder = str(tmp_path / "out")
    filesink.write_files(spark.range(40, numPartitions=4).select(F.format_string("f%d.bin", "id").alias("name"), F.when(F.col("id") != 7, F.col("id").cast("string").cast("binary")).alias("content"), F.lit(1).alias("more")), folder)
    files = {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(folder)}
    assert files == {f"f{i}.bin": b"" if i == 7 else str(i).encode() for i in range(40)}
    with pytest.raises(Exception, match="same file name"):
        filesink.write_files(spark.range(2).select(F.lit("a").alias("name"), F.lit(b"x").alias("content")), folder)
    with pytest.raises(Exception, match="file name"):
        filesink.write_files(spark.range(1).select(F.lit("../a").alias("name"), F.lit(b"x").alias("content")), folder)
    # a task that outlives its failed job may leave a hidden folder, never a file
    assert {n for n in os.listdir(folder) if not n.startswith("_temporary-")} == set(files)


def test_pairs_of_lines_and_parcels_go_to_no_exchange(spark):
    r = random.Random(8)
    star = lambda x, y, n: tuple([c + s * (90 if k % 2 else 300) for k in range(n) for s in [f(2 * math.pi * k / n)]] for c, f in ((x, math.cos), (y, math.sin)))
    rows = [(k, *star(r.uniform(0, 4000), r.uniform(0, 4000), r.choice((4, 6, 10))), float(k % 7)) for k in range(60)]
    lines = {n: [(r.uniform(-500, 4500), r.uniform(-500, 4500)) for _ in range(4)] for n in range(80)}
    parcels, segments = spark.createDataFrame(rows, PARCELS), spark.createDataFrame(_segments(lines), SEGMENTS)
    got = P.placed_residents(parcels, segments, 40.0, 100.0)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    # points where the plain clipping leaves something of a line, and nowhere else; parcels keep their totals
    clipped = {(c["poly"], c["line"]): c["len"] for c in clip_segments(segments, parcels.filter("pop > 0"), 100.0).groupBy("poly", "line").agg(F.sum("len").alias("len")).collect()}
    points = got.collect()
    assert {(p["poly"], p["line"]) for p in points} == set(clipped) and len(clipped) > 500
    each = {}
    for p in points:
        each[p["poly"]] = each.get(p["poly"], 0.0) + p["weight"]
    assert all(abs(v - k % 7) < 1e-9 for k, v in each.items())
