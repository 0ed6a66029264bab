"""Column functions that no query calls."""

from pyspark.sql import functions as F

from velonet.functions import tags as T

SPEEDS = {-1: 2.0, 0: 1.0, 1: 5.0, 2: 4.0, 3: 3.0, 4: 1.0}


def test_clean_numbers(spark):
    rows = [("30 mph;50",), ("walk",), (None,), ("12.5",)]
    got = [r.v for r in spark.createDataFrame(rows, "t string").select(T.clean_numbers(F.col("t")).alias("v")).collect()]
    assert [round(v, 3) for v in got[0]] == [round(30 * T.MPH_KPH, 3), 50.0] and got[1] == [None] and got[3] == [12.5]
    assert not got[2]


def test_drawn_values(spark):
    rows = [({"highway": "cycleway"}, 1), ({"highway": "residential"}, 2), ({"highway": "motorway"}, 4)]
    df = spark.createDataFrame(rows, "tags map<string,string>, lts int")
    got = df.select(T.draw_speed(F.col("tags"), F.col("lts"), SPEEDS).alias("speed"), T.draw_highway_type(F.col("tags")).alias("kind"), T.cycle_type(F.col("tags")).alias("ct")).collect()
    assert abs(got[0].speed - (5.0 - 0.001) / 5.0) < 1e-9 and got[0].speed < 1
    assert all(r.speed <= got[0].speed for r in got)
    for r in got:
        assert r.kind == (0.0 if r.ct == 1 else -1.0) if r.ct >= 0 else abs(r.kind + r.ct / 8.00001) < 1e-12
