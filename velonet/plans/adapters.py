"""Deterministic road networks, sites and samples made from the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Values by position, chosen with a key modulo their number; None is a missing tag.
TAGS: dict[str, tuple[int, tuple[str | None, ...]]] = {
    "highway": (1, ("residential", "primary", "tertiary", "motorway", "service", "path", "cycleway", "steps", "track", "construction", "living_street", "secondary_link", "unclassified", "odd", None, "trunk", "proposed")),
    "construction": (1, ("residential", None, "tertiary", "service", "primary")),
    "bicycle": (3, (None, "yes", None, "no", "designated", None, "dismount", "private", None, "use_sidepath", "lane", None, "permissive", "dangerous", "other")),
    "foot": (5, (None, "yes", "no", "private", "designated", "maybe")),
    "access": (2, (None, "private", None, "no", "permissive", None, None)),
    "motor_vehicle": (7, (None, None, "no", "yes", None, None, None, None, None, None, None)),
    "ferry": (11, (None,) * 18 + ("yes",)),
    "route": (13, (None,) * 15 + ("ferry", "bus")),
    "tunnel": (4, (None, "yes", "culvert", None, None, "no")),
    "bridge": (9, (None, None, "yes", "no")),
    "cycleway": (6, (None, "lane", "no", "track", None, "shared_lane", "weird", None, "opposite_track")),
    "cycleway:right": (8, (None, "lane", None, "no", "track", None, None)),
    "cycleway:left": (10, (None, None, "lane", "separate", None, "no_lane", None, None, None, None)),
    "cycleway:right:lane": (12, (None, None, None, "exclusive", None, "advisory", None, None, None, None, None)),
    "cycleway:left:oneway": (14, (None, None, "no", None, None)),
    "bicycle:conditional": (15, (None,) * 9 + ("no @ winter", "yes")),
    "shoulder:access:bicycle": (16, (None,) * 7 + ("yes",)),
    "oneway": (17, (None, "yes", "no", "-1", " TRUE ", None, "maybe")),
    "oneway:bicycle": (18, (None, "no", "yes", None, None)),
    "junction": (19, (None, "roundabout", None)),
    "maxspeed": (20, ("50", None, "30 mph", "national", "70", "120", "fast", None)),
    "maxspeed:forward": (21, (None, None, "40", None, "60")),
    "maxspeed:backward": (22, (None, "30", None, None, None, "80", None)),
    "lanes": (23, ("2", None, "1", "4", "3;2", "6", "two", None, "5")),
    "lanes:forward": (24, (None, None, None, "1", None, None, None)),
    "numlanes": (25, (None, "3")),
    "surface": (26, (None, "asphalt", "gravel", "sand", "marble", None, "sett")),
    "service": (27, (None, "alley", "driveway", "parking_aisle", "bay")),
    "parking": (28, (None, "yes", None, None, "no", None)),
    "parking:lane:both": (29, (None, "parallel", "no", "no_stopping", None)),
    "duration": (30, (None, None, "0:20", "PT10M", "1:05:30", None, "soon", None)),
    "area": (31, (None, "yes", "no")),
    "name": (32, (None, "123 Main St N", "Rue du Pont - Est", "st Clair Ave W bridge", "12 5 Oak", "A & B", "Elm Cres", "north", "bridge", "North")),
    "lit": (33, (None, "yes", "no", "limited")),
    "layer": (34, (None, "1", None)),
    "sidewalk:left": (35, (None, "yes", None, None)),
    "bicycle_road": (36, (None,) * 8 + ("yes",)),
}


def _pick(key: str, shift: int, values: tuple[str | None, ...]) -> str:
    """SQL for the value that (key // shift + key) modulo the number of values chooses; the same text in both engines."""
    case = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE CAST((floor({key} / {shift}) + {key}) AS BIGINT) % {len(values)} {case} END"


WAYS_SQL = "SELECT o_orderkey AS way_id, " + ", ".join(f'{_pick("o_orderkey", shift, values)} AS "{k}"' for k, (shift, values) in TAGS.items()) + " FROM orders"
WAY_NODES_SQL = """SELECT way_id, seq, CASE WHEN seq % 3 = 1 THEN l_partkey ELSE 1000000 + way_id * 100 + seq END AS node_id
FROM (SELECT l_orderkey AS way_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS seq FROM lineitem)"""
POINTS_SQL = """SELECT way_id, seq, node_id, (node_id * 7919) % 20011 AS x, (node_id * 104729) % 20021 AS y FROM way_nodes"""
HOMES_SQL = "SELECT c_custkey AS site_id, (c_custkey * 7919) % 20011 AS x, (c_custkey * 104729) % 20021 AS y, abs(c_acctbal) AS weight FROM customer"
WORKS_SQL = "SELECT s_suppkey AS site_id, (s_suppkey * 6007) % 20011 AS x, (s_suppkey * 90001) % 20021 AS y, abs(s_acctbal) AS weight FROM supplier"
SAMPLES_SQL = "SELECT user_id AS cell, CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v, CAST(1 + event_id % 5 AS DOUBLE) AS w FROM events"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chosen(key: Column, shift: int, values: tuple[str | None, ...]) -> Column:
    at = (F.floor(key / shift) + key).cast("long") % len(values)
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(at == i, v).otherwise(out)
    return out


def ways(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """(way_id, tags): one tagged way for each order; with ``only`` these tags and no others are made."""
    key = F.col("o_orderkey")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), _chosen(key, s, v).alias("value")) for k, (s, v) in TAGS.items() if not only or k in only])
    # dealt out ahead: the keys of many orders fit into one split, whose task would then work out all the rules
    keys = read(spark, sf_dir, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return keys.select(key.alias("way_id"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, seq, node_id): every third node of a way, from the first, is shared with other ways."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.row_number().over(w).cast("long").alias("seq"), "l_partkey")
    return rows.select("way_id", "seq", F.when(F.col("seq") % 3 == 1, F.col("l_partkey")).otherwise(1000000 + F.col("way_id") * 100 + F.col("seq")).alias("node_id"))


def placed(nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """With integer metres x, y mixed from the key."""
    return nodes.withColumns({"x": (F.col(key) * 7919) % 20011, "y": (F.col(key) * 104729) % 20021})


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.abs("c_acctbal").alias("weight"))
    return placed(c, "site_id").select("site_id", "x", "y", "weight")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(s.alias("site_id"), ((s * 6007) % 20011).alias("x"), ((s * 90001) % 20021).alias("y"), F.abs("s_acctbal").alias("weight"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.when(e % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"), (1 + e % 5).cast("double").alias("w"))
