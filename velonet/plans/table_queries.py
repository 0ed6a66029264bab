"""Queries of text, arithmetic, aggregation, window and table operators, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velonet.functions import arrays as A
from velonet.functions import tags as T
from velonet.functions import text as X
from velonet.operators import study as U
from velonet.params import SLOPE_PENALTY, WORK

from . import adapters as D
from .network_queries import BASE, LEGS, SEGS, segments, vertices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- text ---
NAME = "(o_orderkey || ' ' || CASE o_orderkey % 9 WHEN 0 THEN 'Main St N' WHEN 1 THEN 'st Clair Ave' WHEN 2 THEN 'King Rd & Queen Rd' WHEN 3 THEN 'Old Mill' WHEN 4 THEN 'Bay Bridge' WHEN 5 THEN 'Elm Cres SW' WHEN 6 THEN 'Rue A - Rue B' WHEN 7 THEN 'West' ELSE 'Pine Blvd to Oak' END)"


def _names(spark, sf):
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("Main St N", "st Clair Ave", "King Rd & Queen Rd", "Old Mill", "Bay Bridge", "Elm Cres SW", "Rue A - Rue B", "West", "Pine Blvd to Oak")))
    return D.read(spark, sf, "orders").select(k.alias("id"), F.concat(k.cast("string"), F.lit(" "), F.get(kinds, (k % 9).cast("int"))).alias("name"))


STREET = "CASE o_orderkey % 9 WHEN 0 THEN 'main street_north' WHEN 1 THEN 'saint clair avenue' WHEN 2 THEN 'king road' WHEN 3 THEN 'old mill_?' WHEN 4 THEN 'bay_?' WHEN 5 THEN 'elm crescent_southwest' WHEN 6 THEN 'rue a_?' WHEN 7 THEN 'west' ELSE 'pine boulevard' END"


@query("t01_parse_street_name", f"SELECT o_orderkey AS id, {STREET} AS street FROM orders")
def parse_street_name(spark, sf):
    return _names(spark, sf).select("id", X.parse_street_name(F.col("name")).alias("street"))


@query("t02_merge_street_names", f"""WITH s AS (SELECT o_custkey AS id, {STREET} AS street FROM orders)
  SELECT id, CASE WHEN count(DISTINCT CASE WHEN street NOT LIKE '%\\_?' ESCAPE '\\' THEN street END) = 1 THEN min(CASE WHEN street NOT LIKE '%\\_?' ESCAPE '\\' THEN street END) ELSE '?' END AS street FROM s GROUP BY id""")  # fmt: skip
def merge_street_names(spark, sf):
    named = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust")).join(_names(spark, sf), "id")
    return named.groupBy(F.col("cust").alias("id")).agg(X.merge_street_names(F.collect_set(X.parse_street_name(F.col("name")))).alias("street"))


@query("t03_pretty_street_name", """SELECT p_partkey AS id, array_to_string(list_transform(string_split(replace(replace(p_name, '_', ' '), '?', ' '), ' '), lambda x: upper(x[1]) || substring(x, 2)), ' ') AS pretty FROM part WHERE NOT regexp_matches(p_name, '[^a-zA-Z0-9 ]') AND NOT regexp_matches(p_name, '[0-9][a-z]')""")
def pretty_street_name(spark, sf):
    p = D.read(spark, sf, "part").filter(~F.col("p_name").rlike("[^a-zA-Z0-9 ]") & ~F.col("p_name").rlike("[0-9][a-z]"))
    return p.select(F.col("p_partkey").alias("id"), X.pretty_street_name(F.col("p_name")).alias("pretty"))


@query("t04_file_city_name", "SELECT n_nationkey AS id, translate('St. Jérôme-' || n_name, 'éèô ''.-', 'eeo____') AS city FROM nation")
def file_city_name(spark, sf):
    return D.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), X.file_city_name(F.concat(F.lit("St. Jérôme-"), "n_name")).alias("city"))


@query("t05_numbers", """SELECT event_id AS id, len(regexp_extract_all(props, '\\d+')) AS n, CAST(list_sum(list_transform(regexp_extract_all(props, '\\d+'), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM events""")
def numbers(spark, sf):
    ints = X.all_ints(F.col("props"))
    return D.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.size(ints).cast("long").alias("n"), F.when(F.size(ints) > 0, F.aggregate(ints, F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query("t06_vocabulary", """SELECT p_partkey AS id, CASE WHEN p_size IN (1, 2, 3) THEN 'small' WHEN p_size IN (4, 5) THEN 'medium' ELSE 'other' END AS size FROM part""")
def vocabulary(spark, sf):
    table = T.words_of({"small": "1 2 3", "medium": "4 5"})
    return D.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.coalesce(T.lookup(F.col("p_size").cast("string"), table), F.lit("other")).alias("size"))


@query("t07_similar_names", """WITH p AS (SELECT a.n_name AS asked, b.n_name AS found, CAST(round(100 * (1 - levenshtein(lower(a.n_name), lower(b.n_name)) / CAST(greatest(length(a.n_name), length(b.n_name)) AS DOUBLE))) AS INTEGER) AS score
  FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey) SELECT asked, max(score) AS score FROM p WHERE score > 49 GROUP BY asked""")  # fmt: skip
def similar_names(spark, sf):
    """Best suggestion for each name among the others of the (bounded) list of nations."""
    n = D.read(spark, sf, "nation")
    a, b = n.select(F.col("n_name").alias("asked")), n.select(F.col("n_name").alias("found"))
    return a.join(F.broadcast(b), F.col("asked") != F.col("found")).withColumn("score", X.similarity(F.col("asked"), F.col("found"))).filter("score > 49").groupBy("asked").agg(F.max("score").alias("score"))


@query("t08_base36", """WITH RECURSIVE d AS (SELECT o_orderkey * 977 AS v, o_orderkey AS id, '' AS s FROM orders UNION ALL
  SELECT v // 36, id, substring('0123456789abcdefghijklmnopqrstuvwxyz', CAST(v % 36 AS INTEGER) + 1, 1) || s FROM d WHERE v > 0) SELECT id, CASE WHEN s = '' THEN '0' ELSE s END AS code FROM d WHERE v = 0""")  # fmt: skip
def base36(spark, sf):
    return D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.base36(F.col("o_orderkey") * 977).alias("code"))


@query("t09_runs", """WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
  SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM o GROUP BY user_id, event_type, g""")  # fmt: skip
def runs(spark, sf):
    """Run lengths of equal values in order."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = D.read(spark, sf, "events").withColumn("new", F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return e.groupBy("user_id", "event_type", "run").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("run")


@query("t10_lonlat_label", """SELECT c_custkey AS id, format('{:.3f}', abs(c_acctbal / 1000)) || '°' || CASE WHEN c_acctbal < 0 THEN 'S' ELSE 'N' END || ' ' || format('{:.3f}', abs((c_custkey % 360 - 180) / 1.0)) || '°' || CASE WHEN c_custkey % 360 - 180 < 0 THEN 'W' ELSE 'E' END AS label FROM customer""")
def lonlat(spark, sf):
    c = D.read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), X.lonlat_label((F.col("c_custkey") % 360 - 180).cast("double"), F.col("c_acctbal") / 1000, 3).alias("label"))


@query("t11_character_profile", """SELECT p, count(*) AS n, max(length(props)) AS longest FROM (SELECT props, CASE WHEN regexp_matches(props, '[0-9]') THEN 'd' ELSE '' END || CASE WHEN regexp_matches(props, '[a-z]') THEN 'l' ELSE '' END || CASE WHEN regexp_matches(props, '[A-Z]') THEN 'u' ELSE '' END || CASE WHEN regexp_matches(props, '\\s') THEN 's' ELSE '' END || CASE WHEN regexp_matches(props, '[^0-9a-zA-Z\\s]') THEN 'p' ELSE '' END AS p FROM events) GROUP BY p""")
def character_profile(spark, sf):
    return D.read(spark, sf, "events").groupBy(X.character_profile(F.col("props")).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("props")).alias("longest"))


@query("k11_coordinate_code", """SELECT c_custkey AS id, chr(CAST(48 + c % 64 AS INTEGER)) || chr(CAST(48 + (c // 64) % 64 AS INTEGER)) || chr(CAST(48 + (c // 4096) % 64 AS INTEGER)) || chr(CAST(48 + (c // 262144) % 64 AS INTEGER)) AS code FROM (SELECT c_custkey, (c_custkey * 104729) % 16000000 AS c FROM customer)""")
def coordinate_code(spark, sf):
    return D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.chars64((F.col("c_custkey") * 104729) % 16000000).alias("code"))


@query("c23_clean_values", """SELECT o_orderkey AS id, array_to_string(list_transform(string_split(replace(replace(lower('Asphalt_;' || o_orderstatus || '/unpved'), ';', ','), '/', ','), ','), lambda x: CASE trim(trim(x), '_') WHEN 'unpved' THEN 'unpaved' ELSE trim(trim(x), '_') END), ',') AS vals FROM orders""")
def clean_values(spark, sf):
    return D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(T.clean_values(F.concat(F.lit("Asphalt_;"), "o_orderstatus", F.lit("/unpved")), {"unpved": "unpaved"}), ",").alias("vals"))


@query("c20_building_type", f"""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'R' WHEN 1 THEN 'C' WHEN 2 THEN 'P' WHEN 3 THEN 'R' WHEN 4 THEN '?' WHEN 5 THEN 'X' WHEN 6 THEN 'W' ELSE 'C' END AS kind,
  CASE p_partkey % 8 WHEN 0 THEN 'R' WHEN 3 THEN 'R' WHEN 4 THEN '?' WHEN 5 THEN '?' ELSE 'W' END AS use FROM part""")  # fmt: skip
def building_type(spark, sf):
    k = F.col("p_partkey") % 8
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), k.cast("int"))
    entries = F.array(F.struct(F.lit("building").alias("key"), pick("house", "yes", "school", "yes", "castle", "no", "yes", "shop").alias("value")), F.struct(F.lit("amenity").alias("key"), pick(None, "pub", None, None, None, None, None, None).alias("value")), F.struct(F.lit("office").alias("key"), pick(None, None, None, None, None, None, "y", None).alias("value")))
    tags = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    kind = T.building_type(tags)
    return D.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), T.building_use(kind).alias("use"))


@query("c21_building_height", """SELECT p_partkey AS id, CAST(round(CASE p_partkey % 4 WHEN 0 THEN 3.2 WHEN 1 THEN greatest(3.2, p_size) WHEN 2 THEN greatest(3.2, p_size * 0.304) ELSE greatest(3.2, p_size + 0.5) END, 4) AS DOUBLE) AS height FROM part""")
def building_height(spark, sf):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    h = F.when(k == 1, F.concat(s, F.lit(" m"))).when(k == 2, F.concat(s, F.lit("'"))).when(k == 3, F.concat(s, F.lit(".5")))
    tags = F.map_from_entries(F.filter(F.array(F.struct(F.lit("height").alias("key"), h.alias("value")), F.struct(F.lit("building:levels").alias("key"), s.alias("value"))), lambda e: e["value"].isNotNull()))
    return D.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(T.building_height_m(tags), 4).alias("height"))


@query("c22_building_volume", "SELECT p_partkey AS id, round(p_retailprice * CASE WHEN p_size > 10 THEN p_size ELSE 3.2 END, 3) AS volume FROM part")
def building_volume(spark, sf):
    h = F.when(F.col("p_size") > 10, F.col("p_size").cast("double"))
    return D.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * F.coalesce(h, F.lit(T.LEVEL_M)), 3).alias("volume"))


@query("s04_tag_codec", """SELECT o_orderkey AS id, '|highway|' || lower(o_orderstatus) || '|ref|' || o_custkey AS text, lower(o_orderstatus) AS highway FROM orders""")
def tag_codec(spark, sf):
    tags = F.create_map(F.lit("highway"), F.lower("o_orderstatus"), F.lit("ref"), F.col("o_custkey").cast("string"))
    return D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.encode(tags, "|").alias("text")).withColumn("highway", T.tag(T.decode(F.col("text")), "highway"))


@query("s08_tag_values", f"WITH ways AS ({D.WAYS_SQL}) SELECT 'surface' AS key, surface AS value, count(*) AS n FROM ways WHERE surface IS NOT NULL GROUP BY surface UNION ALL SELECT 'lanes', lanes, count(*) FROM ways WHERE lanes IS NOT NULL GROUP BY lanes")
def tag_values(spark, sf):
    return D.ways(spark, sf).select(F.explode("tags").alias("key", "value")).filter(F.col("key").isin("surface", "lanes")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query("s07_theme_extract", f"WITH {BASE}, n AS (SELECT node_id, count(*) AS uses FROM way_nodes GROUP BY node_id) SELECT node_id, uses FROM n WHERE uses >= 3")
def theme_extract(spark, sf):
    """Intersections: nodes that streets use three times or more."""
    return D.way_nodes(spark, sf).groupBy("node_id").agg(F.count(F.lit(1)).alias("uses")).filter("uses >= 3")


@query("s19_profiles", "SELECT profile, lts, CAST(kph AS DOUBLE) AS kph FROM (VALUES ('Work', -1, 10.0), ('Work', 0, 6.0), ('Work', 1, 18.0), ('Work', 2, 15.0), ('Work', 3, 10.0), ('Work', 4, 4.0)) t(profile, lts, kph)")
def profiles(spark, sf):
    return spark.createDataFrame([(WORK.name, k, float(v)) for k, v in WORK.kph.items()], "profile string, lts int, kph double")


@query("s20_sheet_code", """SELECT c_custkey AS id, CAST(floor(lon * 4) AS BIGINT) AS col, CAST(floor(lat * 4) AS BIGINT) AS row_, 1 + CASE WHEN CAST(floor(lat * 4) AS BIGINT) % 4 % 2 = 0 THEN 3 - CAST(floor(lon * 4) AS BIGINT) % 4 ELSE CAST(floor(lon * 4) AS BIGINT) % 4 END + 4 * (CAST(floor(lat * 4) AS BIGINT) % 4) AS sheet
  FROM (SELECT c_custkey, (c_custkey % 977) / 10.0 AS lon, (c_custkey % 463) / 10.0 AS lat FROM customer)""")  # fmt: skip
def sheet_code(spark, sf):
    """Quarter-degree sheets numbered in a snake within their degree: odd rows eastwards, even rows westwards."""
    lon, lat = (F.col("c_custkey") % 977) / 10.0, (F.col("c_custkey") % 463) / 10.0
    c, r = F.floor(lon * 4).cast("long"), F.floor(lat * 4).cast("long")
    snake = F.when(r % 4 % 2 == 0, 3 - c % 4).otherwise(c % 4)
    return D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), c.alias("col"), r.alias("row_"), (1 + snake + 4 * (r % 4)).alias("sheet"))


# --- arithmetic ---
@query("m01_projection", """SELECT c_custkey AS id, round((lon - 5) * 40075017.0 / 360 * cos(radians(lat)), 3) AS x, round((lat - 45) * 40007860.0 / 360, 3) AS y FROM (SELECT c_custkey, (c_custkey % 1000) / 100.0 AS lon, 40 + (c_custkey % 700) / 70.0 AS lat FROM customer)""")
def projection(spark, sf):
    x, y = A.to_metres((F.col("c_custkey") % 1000) / 100.0, 40 + (F.col("c_custkey") % 700) / 70.0, 5.0, 45.0)
    return D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("m01_earth_distance", """SELECT id, round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 45) / 2), 2) + cos(radians(45.0)) * cos(radians(lat)) * pow(sin(radians(lon - 5) / 2), 2)))), 1) AS metres FROM (SELECT c_custkey AS id, (c_custkey % 1000) / 100.0 AS lon, 40 + (c_custkey % 700) / 70.0 AS lat FROM customer)""")
def earth_distance(spark, sf):
    d = A.earth_distance(F.lit(5.0), F.lit(45.0), (F.col("c_custkey") % 1000) / 100.0, 40 + (F.col("c_custkey") % 700) / 70.0)
    return D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(d, 1).alias("metres"))


@query("m01_mercator", """SELECT c_custkey AS id, round(((c_custkey % 1000) / 100.0 + 180) / 360, 8) AS x, round(0.5 - ln(tan(pi() / 4 + radians(40 + (c_custkey % 700) / 70.0) / 2)) / (2 * pi()), 8) AS y FROM customer""")
def mercator(spark, sf):
    x, y = A.mercator((F.col("c_custkey") % 1000) / 100.0, 40 + (F.col("c_custkey") % 700) / 70.0)
    return D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(x, 8).alias("x"), F.round(y, 8).alias("y"))


@query("m01_mercator_inverse", """SELECT c_custkey AS id, round(greatest(-180, least(180, c_acctbal / 50)), 6) AS lon, round(CAST(c_custkey % 160 - 80 AS DOUBLE), 6) AS lat FROM customer""")
def mercator_inverse(spark, sf):
    """There and back again."""
    c = D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.greatest(F.lit(-180.0), F.least(F.lit(180.0), F.col("c_acctbal") / 50)).alias("lon"), (F.col("c_custkey") % 160 - 80).cast("double").alias("lat"))
    x, y = A.mercator(F.col("lon"), F.col("lat"))
    lon, lat = A.mercator_inverse(F.col("x"), F.col("y"))
    return c.select("id", x.alias("x"), y.alias("y")).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("m07_heat_colour", """SELECT event_id AS id, CAST(trunc(greatest(0, least(1, 2 * v - 1)) * 255) AS INTEGER) AS r, CAST(trunc(greatest(0, least(1, 1 - abs(2 * v - 1))) * 255) AS INTEGER) AS g, CAST(trunc(greatest(0, least(1, 1 - 2 * v)) * 255) AS INTEGER) AS b
  FROM (SELECT event_id, least(greatest(value / 100, 0.0), 1.0) AS v FROM events)""")  # fmt: skip
def heat_colour(spark, sf):
    e = D.read(spark, sf, "events").select(F.col("event_id").alias("id"), A.heat_colour(F.col("value") / 100).alias("c"))
    return e.select("id", *[F.get("c", F.lit(i)).alias(k) for i, k in enumerate("rgb")])


@query("t05_all_floats", """SELECT p_partkey AS id, len(regexp_extract_all(t, '[-+]?[0-9]*\\.[0-9]+|[0-9]+')) AS n, round(list_sum(list_transform(regexp_extract_all(t, '[-+]?[0-9]*\\.[0-9]+|[0-9]+'), lambda x: CAST(x AS DOUBLE))), 3) AS total
  FROM (SELECT p_partkey, p_name || ' -' || (p_size * 100 + 25) // 100 || '.' || (p_partkey % 90 + 10) || ' m, ' || p_size || ' x .5' AS t FROM part)""")  # fmt: skip
def all_floats(spark, sf):
    t = F.concat("p_name", F.lit(" -"), F.floor((F.col("p_size") * 100 + 25) / 100).cast("string"), F.lit("."), (F.col("p_partkey") % 90 + 10).cast("string"), F.lit(" m, "), F.col("p_size").cast("string"), F.lit(" x .5"))
    v = D.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.all_floats(t).alias("v"))
    return v.select("id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("m03_way_boxes", f"WITH {BASE} SELECT way_id, min(x) AS l, max(x) AS r, min(y) AS b, max(y) AS t, round(sqrt(max(pow(x - cx, 2) + pow(y - cy, 2))), 4) AS radius FROM (SELECT *, (min(x) OVER (PARTITION BY way_id) + max(x) OVER (PARTITION BY way_id)) / 2.0 AS cx, (min(y) OVER (PARTITION BY way_id) + max(y) OVER (PARTITION BY way_id)) / 2.0 AS cy FROM pts) GROUP BY way_id")
def way_boxes(spark, sf):
    p = vertices(spark, sf).groupBy("way_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    _, _, r = A.circumscribed(F.col("xs"), F.col("ys"))
    return p.select("way_id", F.array_min("xs").alias("l"), F.array_max("xs").alias("r"), F.array_min("ys").alias("b"), F.array_max("ys").alias("t"), F.round(r, 4).alias("radius"))


@query("m05_array_tools", """SELECT o_custkey AS id, array_to_string(list_sort(list_distinct(list(o_orderkey % 7))), ',') AS uniq, count(*) AS n FROM orders GROUP BY o_custkey""")
def array_tools(spark, sf):
    return D.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(A.sorted_unique(F.collect_list(F.col("o_orderkey") % 7)).cast("array<string>"), ",").alias("uniq"), F.count(F.lit(1)).alias("n"))


@query("m06_mean_std", f"WITH s AS ({D.SAMPLES_SQL}) SELECT cell, round(avg(CASE WHEN NOT isnan(v) THEN v END), 6) AS mean, round(stddev_pop(CASE WHEN NOT isnan(v) THEN v END), 5) AS std FROM s GROUP BY cell")
def mean_std(spark, sf):
    v = A.finite(F.col("v"))
    return D.samples(spark, sf).groupBy("cell").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 5).alias("std"))


@query("m08_line_angle", f"""WITH {BASE}, {LEGS}, {SEGS}, a AS (SELECT line, seg, CASE WHEN x1 = x2 THEN pi() / 2 ELSE atan(CAST(y2 - y1 AS DOUBLE) / (x2 - x1)) END AS a FROM segs)
  SELECT line, round(max(least(abs(a - 0.5), abs(pi() + a - 0.5), abs(-pi() + a - 0.5))), 6) AS turn FROM a GROUP BY line""")  # fmt: skip
def line_angle(spark, sf):
    s = segments(spark, sf).withColumn("a", A.line_angle((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")))
    return s.groupBy("line").agg(F.round(F.max(A.angle_between(F.col("a"), F.lit(0.5))), 6).alias("turn"))


@query("m09_turns", f"""WITH {BASE}, {LEGS}, {SEGS}, v AS (SELECT line, seg, x2 - x1 AS dx, y2 - y1 AS dy, lead(x2 - x1) OVER w AS ex, lead(y2 - y1) OVER w AS ey FROM segs WINDOW w AS (PARTITION BY line ORDER BY seg))
  SELECT line, CAST(sum(dx * ey - dy * ex) AS BIGINT) AS crossed, CAST(sum(dx * ex + dy * ey) AS BIGINT) AS dotted FROM v WHERE ex IS NOT NULL GROUP BY line""")  # fmt: skip
def turns(spark, sf):
    w = W.partitionBy("line").orderBy("seg")
    v = segments(spark, sf).select("line", "seg", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    v = v.withColumns({"ex": F.lead("dx").over(w), "ey": F.lead("dy").over(w)}).filter("ex is not null")
    return v.groupBy("line").agg(F.sum(A.cross(*map(F.col, ("dx", "dy", "ex", "ey")))).alias("crossed"), F.sum(A.dot(*map(F.col, ("dx", "dy", "ex", "ey")))).alias("dotted"))


@query("m10_slope_codes", f"""SELECT o_orderkey AS id, CASE WHEN rise IS NULL THEN -127 ELSE CAST(trunc(greatest(-6.5, least(6.5, 100 * rise / run))) AS INTEGER) END AS percent,
  CAST(CASE WHEN rise IS NOT NULL THEN ({list(SLOPE_PENALTY)!r})[12 + CAST(trunc(greatest(-11.0, least(11.0, 100 * rise / run))) AS INTEGER)] END AS DOUBLE) AS penalty
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 31 - 15 AS DOUBLE) END AS rise, CAST(80 + o_orderkey % 50 AS DOUBLE) AS run FROM orders)""")  # fmt: skip
def slope_codes(spark, sf):
    k = F.col("o_orderkey")
    rise, run = F.when(k % 13 != 0, (k % 31 - 15).cast("double")), (80 + k % 50).cast("double")
    return D.read(spark, sf, "orders").select(k.alias("id"), A.slope_percent(rise, run).alias("percent"), F.when(rise.isNotNull(), A.slope_penalty(rise, run, SLOPE_PENALTY)).cast("double").alias("penalty"))


@query("m11_clock_seconds", "SELECT o_orderkey AS id, 3600 * (o_orderkey % 30) + 60 * (o_orderkey % 60) + o_orderkey % 59 AS secs FROM orders")
def clock_seconds(spark, sf):
    k = F.col("o_orderkey")
    return D.read(spark, sf, "orders").select(k.alias("id"), A.clock_seconds(F.concat_ws(":", (k % 30).cast("string"), (k % 60).cast("string"), (k % 59).cast("string"))).cast("long").alias("secs"))


# --- aggregation ---
@query("a01_weighted_mean", f"""WITH s AS ({D.SAMPLES_SQL}) SELECT cell, round(sum(CASE WHEN NOT isnan(v) THEN v * w END) / nullif(sum(CASE WHEN NOT isnan(v) THEN w END), 0), 6) AS mean, coalesce(sum(CASE WHEN NOT isnan(v) THEN w END), 0) AS weight FROM s GROUP BY cell""")
def weighted_mean(spark, sf):
    return U.weighted_mean(D.samples(spark, sf), ["cell"], "v", "w").withColumn("mean", F.round("mean", 6))


@query("a02_grand_mean", f"""WITH s AS ({D.SAMPLES_SQL}) SELECT round(sum(CASE WHEN NOT isnan(v) THEN v * w END) / sum(CASE WHEN NOT isnan(v) THEN w END), 6) AS mean, count(DISTINCT cell) AS cells FROM s""")
def grand_mean(spark, sf):
    v = A.finite(F.col("v"))
    return D.samples(spark, sf).agg(F.round(F.sum(v * F.col("w")) / F.sum(F.when(v.isNotNull(), F.col("w"))), 6).alias("mean"), F.count_distinct("cell").alias("cells"))


@query("a03_histogram", "SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def histogram(spark, sf):
    return U.histogram(D.read(spark, sf, "events"), "event_type").withColumn("percent", F.round("percent", 6))


@query("a04_ordered_lists", "SELECT l_orderkey AS shape, array_to_string(list(CAST(l_partkey AS VARCHAR) ORDER BY l_shipdate, l_partkey), ',') AS points FROM lineitem GROUP BY l_orderkey")
def ordered_lists(spark, sf):
    pts = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_partkey")))
    return D.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("shape")).agg(F.array_join(F.transform(pts, lambda p: p["l_partkey"].cast("string")), ",").alias("points"))


@query("s17_gtfs_shapes", "SELECT l_orderkey AS shape_id, count(*) AS n, arg_min(l_partkey, (epoch_us(l_shipdate) // 1000000) * 10000 + l_partkey) AS first_point FROM lineitem GROUP BY l_orderkey")
def gtfs_shapes(spark, sf):
    return D.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("shape_id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("l_shipdate", "l_partkey"))["l_partkey"].alias("first_point"))


@query("a05_distinct_sets", "SELECT user_id, CASE WHEN count(DISTINCT event_id % 60) > 50 THEN 'MANY' ELSE CAST(count(DISTINCT event_id % 60) AS VARCHAR) END AS distinct_values FROM events GROUP BY user_id")
def distinct_sets(spark, sf):
    n = F.size(F.collect_set(F.col("event_id") % 60))
    return D.read(spark, sf, "events").groupBy("user_id").agg(F.when(n > 50, "MANY").otherwise(n.cast("string")).alias("distinct_values"))


@query("a06_most_frequent", """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1""")
def most_frequent(spark, sf):
    return U.most_frequent(D.read(spark, sf, "events"), "user_id", "event_type")


@query("a07_ragged_stats", "SELECT vec_id, round(list_min(embedding), 5) AS low, round(list_max(embedding), 5) AS high, round(list_sum(embedding) / len(embedding), 5) AS mean FROM embeddings")
def ragged_stats(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return D.read(spark, sf, "embeddings").select("vec_id", F.round(F.array_min(e), 5).alias("low"), F.round(F.array_max(e), 5).alias("high"), F.round(A.total(e) / F.size(e), 5).alias("mean"))


@query("a08_table_summary", "SELECT count(DISTINCT c_mktsegment) AS segments, min(c_acctbal) AS low, max(c_acctbal) AS high, array_to_string(list_sort(list_distinct(list(c_mktsegment)))[1:10], ',') AS values_ FROM customer")
def table_summary(spark, sf):
    s = F.array_join(F.slice(F.array_sort(F.collect_set("c_mktsegment")), 1, 10), ",")
    return D.read(spark, sf, "customer").agg(F.count_distinct("c_mktsegment").alias("segments"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), s.alias("values_"))


@query("a09_prefix_sums", "SELECT c_nationkey, round(sum(CASE WHEN r <= 63 THEN c_acctbal END), 2) AS first_63, round(sum(c_acctbal), 2) AS whole FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) GROUP BY c_nationkey")
def prefix_sums(spark, sf):
    c = D.read(spark, sf, "customer").withColumn("r", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")))
    return c.groupBy("c_nationkey").agg(F.round(F.sum(F.when(F.col("r") <= 63, F.col("c_acctbal"))), 2).alias("first_63"), F.round(F.sum("c_acctbal"), 2).alias("whole"))


@query("a10_bin_offsets", "SELECT cell, n, CAST(coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_at FROM (SELECT l_suppkey AS cell, count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def bin_offsets(spark, sf):
    """Offsets over the bins; the running sum sees one row for each bin."""
    n = D.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("first_at", F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


@query("a11_values_by_level", f"WITH ways AS ({D.WAYS_SQL}) SELECT o.lts, count(DISTINCT surface) AS surfaces FROM (SELECT *, way_id % 6 AS lts FROM ways) o GROUP BY o.lts")
def values_by_level(spark, sf):
    return D.ways(spark, sf).groupBy((F.col("way_id") % 6).alias("lts")).agg(F.count_distinct(T.tag(F.col("tags"), "surface")).alias("surfaces"))


@query("a12_extent", f"WITH {BASE} SELECT min(x) AS l, max(x) AS r, min(y) AS b, max(y) AS t FROM pts")
def extent(spark, sf):
    return vertices(spark, sf).agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("b"), F.max("y").alias("t"))


@query("a13_outer_product", "SELECT n_nationkey AS o_id, r_regionkey AS d_id, CAST((1 + n_nationkey) * (2 + r_regionkey) AS BIGINT) AS weight FROM nation CROSS JOIN region")
def outer_product(spark, sf):
    n = D.read(spark, sf, "nation").select(F.col("n_nationkey").alias("o_id"), (1 + F.col("n_nationkey")).alias("w"))
    r = D.read(spark, sf, "region").select(F.col("r_regionkey").alias("d_id"), (2 + F.col("r_regionkey")).alias("v"))
    return n.join(F.broadcast(r)).select("o_id", "d_id", (F.col("w") * F.col("v")).cast("long").alias("weight"))


# --- windows, sorts, sets ---
@query("w01_differences", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events")
def differences(spark, sf):
    return D.read(spark, sf, "events").select("event_id", (F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))).alias("step"))


@query("w02_running_sums", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS so_far FROM events")
def running_sums(spark, sf):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return D.read(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("so_far"))


@query("w03_shares", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders")
def shares(spark, sf):
    return D.read(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(W.partitionBy("o_custkey")), 8).alias("share"))


@query("w04_ranks", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS rank FROM orders")
def ranks(spark, sf):
    return D.read(spark, sf, "orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).alias("rank"))


@query("w06_without_repeats", "SELECT user_id, count(*) AS n FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type GROUP BY user_id")
def without_repeats(spark, sf):
    seq = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: e["event_type"])
    return D.read(spark, sf, "events").groupBy("user_id").agg(F.size(A.without_repeats(seq)).cast("long").alias("n"))


@query("w07_nearest_two", "SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders) WHERE r <= 2")
def nearest_two(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return D.read(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("o_custkey", "o_orderkey", "rank")


@query("w08_closest_incidents", f"WITH homes AS ({D.HOMES_SQL}) SELECT site_id, round(sqrt(CAST((x - 10000) * (x - 10000) + (y - 10000) * (y - 10000) AS DOUBLE)), 4) AS dist FROM homes ORDER BY (x - 10000) * (x - 10000) + (y - 10000) * (y - 10000), site_id LIMIT 20")
def closest(spark, sf):
    """The twenty incidents nearest to a place (a top-k report)."""
    x, y = F.col("x") - 10000, F.col("y") - 10000
    return D.homes(spark, sf).withColumn("d2", x * x + y * y).orderBy("d2", "site_id").limit(20).select("site_id", F.round(F.sqrt("d2"), 4).alias("dist"))


@query("w09_selection", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice > 1000 AND o_orderstatus <> 'F'")
def selection(spark, sf):
    return D.read(spark, sf, "orders").filter((F.col("o_orderkey") % 2 == 0) & (F.col("o_totalprice") > 1000) & (F.col("o_orderstatus") != "F")).select("o_orderkey")


@query("w10_set_operations", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL
  SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'any', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")  # fmt: skip
def set_operations(spark, sf):
    o, c = D.read(spark, sf, "orders").select("o_custkey"), D.read(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey")
    n = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(o.intersect(c), "both").union(n(c.subtract(o), "only")).union(n(o.union(c).distinct(), "any"))


@query("j01_lookup_join", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def lookup_join(spark, sf):
    li = D.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return li.join(D.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("j02_all_match", "SELECT l_orderkey AS way_id, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 45) ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(p_partkey) = count(*)")
def all_match(spark, sf):
    """Ways all of whose nodes are present."""
    p = D.read(spark, sf, "part").filter("p_size < 45").select("p_partkey")
    j = D.read(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.count(F.lit(1)).alias("n"), F.count("p_partkey").alias("found")).filter("n = found").drop("found")


@query("j09_semi_joins", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def semi_joins(spark, sf):
    o = D.read(spark, sf, "orders")
    c = D.read(spark, sf, "customer").select("c_custkey")
    for s in ("F", "O"):
        c = c.join(o.filter(F.col("o_orderstatus") == s).select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c


@query("j11_paired", "SELECT c_custkey AS pair, abs((c_custkey * 7) % 101 - (s_suppkey * 11) % 101) AS gap FROM customer JOIN supplier ON s_suppkey = c_custkey")
def paired(spark, sf):
    c, s = D.read(spark, sf, "customer"), D.read(spark, sf, "supplier")
    return c.join(s, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("pair"), F.abs((F.col("c_custkey") * 7) % 101 - (F.col("s_suppkey") * 11) % 101).alias("gap"))


# --- exports ---
@query("k05_json_rows", """SELECT c_custkey AS id, '{"id":' || c_custkey || ',"x":' || (c_custkey * 7919) % 20011 || ',"y":' || (c_custkey * 104729) % 20021 || '}' AS json FROM customer""")
def json_rows(spark, sf):
    return D.homes(spark, sf).select(F.col("site_id").alias("id"), F.to_json(F.struct(F.col("site_id").alias("id"), "x", "y")).alias("json"))


@query("k07_density_byte", "SELECT c_custkey AS id, printf('%02x', CAST(floor(sqrt(least(abs(c_acctbal) * 4 / 30000, 1)) * 255) AS INTEGER)) AS code FROM customer")
def density_byte(spark, sf):
    v = F.floor(F.sqrt(F.least(F.abs("c_acctbal") * 4 / 30000, F.lit(1.0))) * 255).cast("int")
    return D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.lpad(F.hex(v.cast("long")), 2, "0")).alias("code"))


@query("k06_dictionary", "SELECT p_brand AS word, CAST(row_number() OVER (ORDER BY first_key, p_brand) - 1 AS INTEGER) AS code FROM (SELECT p_brand, min(p_partkey) AS first_key FROM part GROUP BY p_brand)")
def dictionary(spark, sf):
    """Words coded in order of their first appearance; the window runs over distinct words only."""
    words = D.read(spark, sf, "part").groupBy(F.col("p_brand").alias("word")).agg(F.min("p_partkey").alias("first"))
    return words.select("word", (F.row_number().over(W.orderBy("first", "word")) - 1).alias("code"))
