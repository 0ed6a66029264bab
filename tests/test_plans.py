"""Projections, the stage pipeline, and registered queries on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from velonet.functions import projections as P
from velonet.plans import registry
from velonet.plans.pipeline import Pipeline, resolve

DATA = "/root/testdata/sf0.001"


def test_projections(spark):
    lon, lat = F.col("lon"), F.col("lat")
    df = spark.createDataFrame([(-123.0, 0.0), (-122.0, 49.25), (-120.5, 60.0)], "lon double, lat double")
    for forward, inverse in (
        (lambda: P.utm_forward(lon, lat, 10), lambda x, y: P.to_degrees(x, y, 26910)),
        (lambda: P.STATISTICS.forward(lon, lat), lambda x, y: P.to_degrees(x, y, 3347)),
        (lambda: P.web_forward(lon, lat), lambda x, y: P.to_degrees(x, y, 3857)),
    ):
        x, y = forward()
        back = inverse(x, y)
        for r in df.select("lon", "lat", back[0].alias("a"), back[1].alias("b")).collect():
            assert abs(r["a"] - r["lon"]) < 1e-7 and abs(r["b"] - r["lat"]) < 1e-7
    x, y = P.utm_forward(lon, lat, 10)
    r = df.select(x.alias("x"), y.alias("y")).collect()
    assert abs(r[0]["x"] - 500000) < 1e-6 and abs(r[0]["y"]) < 1e-6
    x, y = P.STATISTICS.forward(F.lit(P.STATISTICS.lon0), F.lit(P.STATISTICS.lat0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r["x"] - 6200000) < 1e-6 and abs(r["y"] - 3000000) < 1e-6


def test_pipeline_and_paths():
    p, ran = Pipeline(), []
    p.stage("b", "a")(lambda a: ran.append("b") or a + 1)
    p.stage("c", "b", "b")(lambda x, y: x * y)
    p.stage("off", when=lambda: False)(lambda: 1 / 0)
    assert p.run({"a": 2}, "c") == 9 and ran == ["b"] and p.run({}, "off") is None
    with pytest.raises(KeyError):
        p.run({}, "c")
    catalog = {"NWK": {"TRs": {"len": 1}, "TNs": 2}}
    assert resolve(catalog, "nwk>TRs>len") == 1 and resolve(catalog, "NWK>TRs<TNs") == 2
    assert resolve(catalog, "NWK>TNs,NWK>TRs>len") == [2, 1] and resolve(catalog, "NWK>zz?") is None
    with pytest.raises(KeyError):
        resolve(catalog, "NWK>T")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["c01_cycle_type", "g01_topo_nodes", "g04_stress", "x18_hex_population", "a01_weighted_mean", "w04_ranks", "t01_parse_street_name"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(tuple(None if v != v else round(float(v), 5) if isinstance(v, float) else v for v in r) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)
