"""Truth tables of the row-wise functions."""

import pytest
from pyspark.sql import functions as F

from velonet.functions import arrays as A
from velonet.functions import tags as T
from velonet.functions import text as X


def value(spark, build, tags: dict):
    df = spark.createDataFrame([(list(tags.items()),)], "tags array<struct<k:string,v:string>>")  # keeps the order of the tags
    return df.select(F.map_from_entries("tags").alias("tags")).select(build(F.col("tags")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("tags", "want"),
    [
        ({"highway": "residential"}, 2),
        ({"highway": "construction"}, 5),
        ({"highway": "construction", "construction": "tertiary"}, 3),
        ({"highway": "no such"}, -1),
        ({"cycleway": "x"}, 1),
        ({"access": "yes", "foot": "yes"}, -1),
        ({"foot": "yes"}, 0),
        ({"ferry": "yes", "highway": "primary"}, 0),
        ({"motor_vehicle": "no", "highway": "primary"}, 1),
        ({"highway": "primary", "cycleway:left": "track"}, 1),
        ({"highway": "residential", "access": "private"}, 5),
        ({"highway": "motorway", "bicycle": "yes"}, 4),
        ({"highway": "path", "bicycle": "permissive"}, 1),
        ({"highway": "primary", "bicycle": "designated"}, 1),
        ({"highway": "cycleway", "bicycle": "no"}, 0),
        ({"highway": "primary", "bicycle": "dangerous"}, 5),
        ({"highway": "primary", "bicycle": "sometimes"}, -1),
        ({}, -1),
    ],
)
def test_cycle_type(spark, tags, want):
    assert value(spark, T.cycle_type, tags) == want


@pytest.mark.parametrize(
    ("tags", "forward", "backward"),
    [
        ({"cycleway": "lane"}, 3, 3),
        ({"cycleway": "no"}, 0, 0),
        ({"cycleway:right": "track"}, 4, 0),
        ({"cycleway:left": "lane", "cycleway:left:oneway": "no"}, 3, 3),
        ({"cycleway:both": "shared_lane"}, 1, 1),
        ({"cycleway:right": "lane", "cycleway:right:lane": "exclusive"}, 3, 0),
        ({"cycleway:right": "shared_lane", "cycleway:right:lane": "pictogram"}, 1, 0),
        ({"cycleway:right:width": "2"}, 1, 1),
        ({"cycleway": "something new"}, 1, 1),
        ({}, 0, 0),
    ],
)
def test_bike_infra(spark, tags, forward, backward):
    assert value(spark, lambda t: T.bike_infra(t, True), tags) == forward
    assert value(spark, lambda t: T.bike_infra(t, False), tags) == backward


@pytest.mark.parametrize(
    ("tags", "forward", "backward"),
    [
        ({}, 50, 50),
        ({"maxspeed": "30"}, 30, 30),
        ({"maxspeed": "130"}, 100, 100),
        ({"maxspeed": "30 mph"}, 48, 48),
        ({"maxspeed": "national"}, 50, 50),
        ({"maxspeed:forward": "40"}, 40, 50),
        ({"maxspeed:backward": "40", "highway": "motorway"}, 100, 40),
        ({"maxspeed": "60", "maxspeed:backward": "40"}, 60, 40),
        ({"maxspeed": "60", "maxspeed:forward": "40"}, 50, 50),
        ({"highway": "secondary"}, 80, 80),
    ],
)
def test_max_speed(spark, tags, forward, backward):
    assert value(spark, lambda t: T.max_speed(t, True), tags) == forward
    assert value(spark, lambda t: T.max_speed(t, False), tags) == backward


def test_lanes_parking_and_rest(spark):
    assert value(spark, lambda t: T.num_lanes(t, True), {"lanes": "3;2"}) == 3
    assert value(spark, lambda t: T.num_lanes(t, False), {"lanes": "3;2"}) == 2
    assert value(spark, lambda t: T.num_lanes(t, True), {"lanes": "9"}) == 4
    assert value(spark, lambda t: T.num_lanes(t, True), {"lanes": "many"}) is None
    assert value(spark, T.street_parking, {"parking:lane:left": "no_stopping", "parking:lane:right": "parallel"}) == 0
    assert value(spark, T.passage, {"tunnel": "yes"}) == ord("t")
    assert value(spark, T.passage, {"tunnel": "yes", "bridge": "yes"}) == 1
    assert value(spark, T.duration_s, {"duration": "1:05:30"}) == 3930
    assert value(spark, T.duration_s, {"duration": "soon"}) is None
    assert value(spark, T.building_type, {"building": "yes", "office": "x"}) == "W"
    assert value(spark, T.building_height_m, {"height": "12 m"}) == 12.0
    assert value(spark, T.building_height_m, {"building:levels": "9"}) == T.LEVEL_M


def test_tag_codec_round_trip(spark):
    tags = {"highway": "path", "name": "A & B"}
    assert value(spark, lambda t: T.decode(T.encode(t)), tags) == tags
    assert value(spark, lambda t: T.decode(F.lit("")), tags) == {}


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Main St", "main street"),
        ("123 45 Main St N", "main street_north"),
        ("St Clair Ave & Yonge St", "saint clair avenue"),
        ("Old Mill", "old mill_?"),
        ("King Rd bridge", "king road"),
        ("North", "north"),
        ("12", ""),
        ("Elm Cres to Oak", "elm crescent"),
    ],
)
def test_street_names(spark, name, want):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(X.parse_street_name(F.col("name")).alias("v")).first()["v"] == want


def test_arrays(spark):
    df = spark.createDataFrame([([1, 1, 2, 3, 3],)], "a array<int>")
    r = df.select(A.without_repeats(F.col("a")).alias("w"), A.circular(F.col("a"), 2).alias("c"), A.sorted_unique(F.col("a")).alias("u")).first()
    assert (r["w"], r["c"], r["u"]) == ([1, 2, 3], [2, 3, 3, 1, 1], [1, 2, 3])
    lon, lat = A.to_degrees(*A.to_metres(F.lit(-63.1), F.lit(46.2), -63.0, 46.0), -63.0, 46.0)
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(r["lon"] + 63.1) < 1e-9 and abs(r["lat"] - 46.2) < 1e-9
