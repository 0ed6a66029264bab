"""Queries of parsing and exporting functions on texts made from the driver tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from velonet.functions import tags as T
from velonet.sources import readers, writers

from . import adapters as D
from .road_queries import CYCLE_TYPE, HOUSES, SERVICE
from .network_queries import BASE, vertices


def config_lines(spark, sf):
    lines = D.read(spark, sf, "orders").select(F.concat(F.lit("  KEY_"), F.col("o_orderkey") % 50, F.lit(" path/of "), "o_orderkey").alias("value"))
    return readers.config(lines)


def json_props(spark, sf):
    return D.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def polylines(spark, sf):
    """Encode every way and decode it again."""
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct((p["x"] / 1e6).alias("x"), (-p["y"] / 1e6).alias("y")))
    coded = vertices(spark, sf).groupBy("way_id").agg(writers.polyline(pts).alias("code"))
    back = coded.select("way_id", writers.unpolyline(F.col("code")).alias("p"))
    return back.select("way_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["x"]).alias("sx"), F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["y"]).alias("sy"))


def bounds(spark, sf):
    head = F.concat(F.lit('<osm><bounds minlat="'), F.col("c_custkey") % 90, F.lit('.5" minlon="-'), F.col("c_custkey") % 180, F.lit('.25" maxlat="1" maxlon="2"/>'))
    b = D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), readers.osm_bounds(head).alias("b"))
    return b.select("id", F.col("b.minlat").alias("minlat"), F.col("b.minlon").alias("minlon"))


def cell_types(spark, sf):
    return D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), readers.typed(F.when(F.col("o_orderkey") % 3 == 0, "12").when(F.col("o_orderkey") % 3 == 1, "1.5").otherwise("x1")).alias("kind"))


def road_attributes(spark, sf):
    """The whole attribute table, summed up by cycling class."""
    t = T.road_attributes(D.ways(spark, sf))
    return t.groupBy("cycle_type").agg(F.count(F.lit(1)).alias("n"), F.sum("has_houses").alias("has_houses"), F.sum("is_service").alias("is_service"), F.sum("sidewalk").alias("sidewalk"))


QUERIES = {"s18_config_lines": config_lines, "s13_json_props": json_props, "k06_web_polylines": polylines, "s09_bounds_header": bounds, "s11_cell_types": cell_types, "r02_attribute_table": road_attributes}
ORACLES = {
    "r02_attribute_table": f"""WITH ways AS ({D.WAYS_SQL}) SELECT {CYCLE_TYPE} AS cycle_type, count(*) AS n, CAST(sum({HOUSES}) AS BIGINT) AS has_houses, CAST(sum({SERVICE}) AS BIGINT) AS is_service,
      CAST(sum(CAST("sidewalk:left" IS NOT NULL AS INTEGER)) AS BIGINT) AS sidewalk FROM ways GROUP BY 1""",
    "s18_config_lines": "SELECT 'KEY_' || (o_orderkey % 50) AS key, 'path/of ' || o_orderkey AS rest FROM orders",
    "s13_json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "k06_web_polylines": f"WITH {BASE} SELECT way_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(CASE WHEN y > 0 THEN 1 - y ELSE 0 END) AS BIGINT) AS sy FROM pts GROUP BY way_id",
    "s09_bounds_header": "SELECT c_custkey AS id, CAST(c_custkey % 90 + 0.5 AS DOUBLE) AS minlat, CAST(-(c_custkey % 180) - 0.25 AS DOUBLE) AS minlon FROM customer",
    "s11_cell_types": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'float' ELSE 'str' END AS kind FROM orders",
}
