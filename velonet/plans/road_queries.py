"""Queries of the road classification rules, with SQL twins over plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet.functions import tags as T

from .adapters import WAYS_SQL, ways


def _case(col: str, table: dict, other: str = "NULL") -> str:
    by: dict = {}
    for k, v in table.items():
        by.setdefault(v, []).append(k)
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {col} IN ({', '.join(lit(k) for k in keys)}) THEN {lit(v)}" for v, keys in by.items()) + f" ELSE {other} END"


CW = ['"cycleway"', '"cycleway:right"', '"cycleway:left"', '"cycleway:right:lane"', '"cycleway:left:oneway"']
TRACK = f"(coalesce(bicycle = 'use_sidepath', false) OR {' OR '.join(f'''coalesce({c} IN ('track', 'opposite_track'), false)''' for c in CW)})"
LANE = f"(coalesce(\"shoulder:access:bicycle\" = 'yes', false) OR coalesce(bicycle LIKE 'lane%', false) OR {' OR '.join(f'''coalesce({c} <> 'no' AND {c} NOT LIKE 'no\\_%' ESCAPE '\\', false)''' for c in CW)})"
KIND = "CASE WHEN highway = 'construction' THEN construction ELSE highway END"
KEYS = f"(CASE WHEN cycleway IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN access IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN foot IS NOT NULL THEN 1 ELSE 0 END)"
ROAD = f"""(CASE WHEN highway IS NULL THEN CASE WHEN {KEYS} <> 1 THEN -1 WHEN cycleway IS NOT NULL THEN 1 WHEN access IS NOT NULL THEN 2 ELSE 0 END
 WHEN highway = 'construction' AND construction IS NULL THEN 5 ELSE {_case(f"({KIND})", T.words_of(T.HIGHWAY_CLASS), "-1")} END)"""
CYCLE_TYPE = f"""(CASE WHEN ferry IS NOT NULL THEN 0 WHEN motor_vehicle = 'no' THEN 1 WHEN {TRACK} THEN 1
 WHEN bicycle IS NULL THEN CASE WHEN access IN ('no', 'private') THEN 5 ELSE {ROAD} END
 WHEN bicycle IN ('unknown', 'use_sidepath', 'lane', 'lanes') THEN {ROAD}
 WHEN bicycle IN ('yes', 'permissive') THEN CASE {ROAD} WHEN 5 THEN 4 WHEN 0 THEN 1 ELSE {ROAD} END
 WHEN bicycle = 'designated' THEN 1 WHEN bicycle = 'dismount' THEN 0 WHEN bicycle IN ('private', 'dangerous') THEN 5
 WHEN bicycle = 'no' THEN CASE {ROAD} WHEN 1 THEN 0 ELSE {ROAD} END ELSE -1 END)"""
ACCESS = f"""(CASE WHEN {CYCLE_TYPE} = 5 THEN 2 WHEN bicycle = 'dismount' THEN 1 WHEN bicycle IN ('yes', 'designated') THEN 3
 WHEN bicycle = 'no' THEN CASE WHEN foot IS NULL OR foot IN ('yes', 'designated') THEN 1 WHEN foot = 'no' THEN 2 ELSE 0 END
 WHEN bicycle = 'private' THEN CASE WHEN foot = 'private' THEN 2 ELSE 1 END ELSE 0 END)"""
SERVICE = f"(CASE WHEN ({KIND}) = 'service' AND service IN ('alley', 'parking_aisle', 'driveway') THEN 1 ELSE 0 END)"
HOUSES = f"(CASE WHEN ({KIND}) IN ('residential', 'living_street', 'tertiary', 'tertiary_link') THEN 1 ELSE 0 END)"
RESIDENTIAL = f"(CASE WHEN ({KIND}) IN ('residential', 'living_streets') THEN 1 ELSE 0 END)"
DISMOUNT = "(CASE WHEN bicycle IN ('no', 'dismount') OR \"bicycle:conditional\" = 'no' OR \"bicycle:conditional\" LIKE 'no %' THEN 1 ELSE 0 END)"
REAL = {"tunnel": "tunnel NOT IN ('no', 'culvert', 'flooded')", "ferry": "ferry <> 'no'", "bridge": "bridge <> 'no'"}
N_REAL = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in REAL.values())
PASSAGE = f"(CASE WHEN route = 'ferry' THEN 102 WHEN {N_REAL} = 0 THEN 0 WHEN {N_REAL} > 1 THEN 1 WHEN {REAL['tunnel']} THEN 116 WHEN {REAL['ferry']} THEN 102 ELSE 98 END)"
CLAMP = f"least(100, CASE WHEN highway LIKE 'parking%' THEN 10 ELSE coalesce({_case('highway', T.HIGHWAY_KPH)}, 100) END, coalesce({_case('surface', T.SURFACE_KPH)}, 100))"
DURATION = "(CASE WHEN duration IS NULL THEN 0 WHEN duration = 'PT10M' THEN 600 WHEN duration = '0:20' THEN 1200 WHEN duration = '1:05:30' THEN 3930 END)"
ONEWAY = "(CASE WHEN oneway IS NULL THEN CASE WHEN junction = 'roundabout' THEN 1 ELSE 0 END WHEN lower(trim(oneway)) IN ('true', 'yes') THEN 1 WHEN oneway = '-1' THEN -1 ELSE 0 END)"
PARKING = "(CASE WHEN parking = 'yes' THEN 1 WHEN \"parking:lane:both\" IS NULL OR \"parking:lane:both\" = 'no' OR \"parking:lane:both\" LIKE 'no\\_%' ESCAPE '\\' THEN 0 ELSE 1 END)"


def _number(col: str) -> str:
    return f"CASE WHEN {col} LIKE '%mph%' THEN CAST(floor(TRY_CAST(trim(replace({col}, 'mph', '')) AS INTEGER) * 1.609) AS INTEGER) ELSE TRY_CAST({col} AS INTEGER) END"


def _speed(source: str) -> str:
    return f"CAST(coalesce(CASE WHEN ({_number(source)}) > 100 THEN 100 ELSE {_number(source)} END, 50) AS DOUBLE)"


DEFAULT_SPEED = "CAST(CASE WHEN highway LIKE 'motorway%' THEN 100 WHEN highway LIKE 'trunk%' THEN 60 WHEN highway LIKE 'primary%' OR highway LIKE 'secondary%' THEN 80 ELSE 50 END AS DOUBLE)"
_P, _A, _B = "maxspeed IS NOT NULL", '"maxspeed:forward" IS NOT NULL', '"maxspeed:backward" IS NOT NULL'
SPEED = {
    True: f"""(CASE WHEN {_P} AND {_A} THEN 50.0 WHEN {_P} THEN {_speed('maxspeed')} WHEN {_A} THEN {_speed('"maxspeed:forward"')} ELSE {DEFAULT_SPEED} END)""",
    False: f"""(CASE WHEN {_P} AND {_A} THEN 50.0 WHEN {_B} THEN {_speed('"maxspeed:backward"')} WHEN {_P} THEN {_speed('maxspeed')} ELSE {DEFAULT_SPEED} END)""",
}
LANES = {
    True: """(CASE WHEN "lanes:forward" IS NOT NULL THEN least(4.0, TRY_CAST("lanes:forward" AS DOUBLE)) WHEN lanes = '3;2' THEN 3.0 WHEN lanes = 'two' THEN NULL
      WHEN lanes IS NOT NULL THEN least(4.0, TRY_CAST(lanes AS DOUBLE)) WHEN numlanes IS NOT NULL THEN least(4.0, TRY_CAST(numlanes AS DOUBLE)) ELSE 2.0 END)""",
    False: """(CASE WHEN lanes = '3;2' THEN 2.0 WHEN lanes = 'two' THEN NULL WHEN lanes IS NOT NULL THEN least(4.0, TRY_CAST(lanes AS DOUBLE))
      WHEN numlanes IS NOT NULL THEN least(4.0, TRY_CAST(numlanes AS DOUBLE)) ELSE 2.0 END)""",
}
INFRA = T.words_of(T.INFRA_CLASS)
_BOTH = "CASE WHEN cycleway <> 'no' THEN cycleway END"
_OTHER_NO = "\"cycleway:left:oneway\" = 'no'"
_RIGHT, _RLANE, _LEFT = "CASE WHEN \"cycleway:right\" <> 'no' THEN \"cycleway:right\" END", '"cycleway:right:lane"', "CASE WHEN \"cycleway:left\" <> 'no' THEN \"cycleway:left\" END"
OSM_INFRA = {
    True: f"""(CASE WHEN {_RIGHT} IS NOT NULL AND {_RLANE} IS NOT NULL THEN {_case(f"({_RIGHT} || '=' || {_RLANE})", INFRA, "1")}
      WHEN {_RIGHT} IS NOT NULL THEN {_case(f"({_RIGHT})", INFRA, "1")}
      WHEN {_RLANE} IS NOT NULL THEN {_case(f"('lane=' || {_RLANE})", INFRA, "1")}
      WHEN {_BOTH} IS NOT NULL THEN {_case(f"({_BOTH})", INFRA, "1")}
      WHEN {_OTHER_NO} AND {_LEFT} IS NOT NULL THEN {_case(f"({_LEFT})", INFRA, "1")} ELSE 0 END)""",
    False: f"""(CASE WHEN {_LEFT} IS NOT NULL THEN {_case(f"({_LEFT})", INFRA, "1")} WHEN {_OTHER_NO} THEN 0
      WHEN {_BOTH} IS NOT NULL THEN {_case(f"({_BOTH})", INFRA, "1")} ELSE 0 END)""",
}


def _core(ct: str, infra: str, speed: str, lanes: str, parking: str, residential: str) -> str:
    h, ps = f"({infra}) = 3", f"({speed} + 10 * {parking})"
    return f"""(CASE WHEN ({infra}) = 4 THEN 1 WHEN {ct} NOT IN (2, 3, 4) THEN {ct}
      WHEN ({h} AND {ps} > 65) OR (NOT ({h}) AND ({lanes} > 5 OR ({lanes} > 3 AND {speed} <= 50) OR {speed} > 50)) THEN 4
      WHEN {h} AND {ps} <= 40 AND {residential} = 1 THEN 1
      WHEN {h} THEN CASE WHEN {lanes} > 2 OR {residential} = 0 OR {speed} > 50 THEN 3 ELSE 2 END
      WHEN {speed} <= 50 THEN CASE WHEN {lanes} < 3 AND {residential} = 1 THEN 2 ELSE 3 END ELSE -1 END)"""


def lts_sql(forward: bool, infra: str | None = None) -> str:
    """Stress level of a way in one direction; ``infra`` replaces the tagged infrastructure."""
    bi = infra or OSM_INFRA[forward]
    core = _core("ct", "bi", "sp", "coalesce(la, 2.0)", "pk", "rs")
    return f"""(SELECT CASE WHEN ba = 2 THEN 5 WHEN pt = 102 THEN 10 ELSE CASE lv WHEN -1 THEN 3 ELSE lv END END FROM (
      SELECT *, CASE WHEN up = 1 AND (dm = 1 OR ba = 1) THEN 0 ELSE up END AS lv FROM (
      SELECT *, CASE WHEN c0 = 0 AND (bi > 0 OR ba = 3) THEN 1 ELSE c0 END AS up FROM (
      SELECT *, {core} AS c0 FROM (SELECT {CYCLE_TYPE} AS ct, {bi} AS bi, {SPEED[forward]} AS sp, {LANES[forward]} AS la, {PARKING} AS pk, {RESIDENTIAL} AS rs,
      {ACCESS} AS ba, {PASSAGE} AS pt, {DISMOUNT} AS dm)))))"""



#: Query name -> (columns built from the tag map, the same in SQL).
Rule = tuple[dict[str, Callable[[Column], Column]], dict[str, str]]
RULES: dict[str, Rule] = {
    "c01_cycle_type": ({"cycle_type": T.cycle_type}, {"cycle_type": CYCLE_TYPE}),
    "c02_bike_access": ({"bike_access": T.bike_access}, {"bike_access": ACCESS}),
    "c03_bike_infra": ({"fwd_infra": lambda t: T.bike_infra(t, True), "bwd_infra": lambda t: T.bike_infra(t, False)}, {"fwd_infra": OSM_INFRA[True], "bwd_infra": OSM_INFRA[False]}),
    "c04_cycle_infra": (
        {"lane": lambda t: T.flag(T.has_cycle_lane(t)), "track": lambda t: T.flag(T.has_cycle_track(t)), "infra": T.cycle_infra},
        {"lane": f"CAST({LANE} AS INTEGER)", "track": f"CAST({TRACK} AS INTEGER)", "infra": f"CAST({LANE} AS INTEGER) + 2 * CAST({TRACK} AS INTEGER)"},
    ),
    "c05_force_dismount": ({"force_dismount": T.force_dismount}, {"force_dismount": DISMOUNT}),
    "c06_motor_allowed": ({"motor_allowed": T.motor_allowed}, {"motor_allowed": f"CASE WHEN {CYCLE_TYPE} IN (0, 1) THEN 0 ELSE 1 END"}),
    "c07_oneway": ({"oneway": T.oneway}, {"oneway": ONEWAY}),
    "c08_bikeway_oneway": (
        {"bikeway_oneway": T.bikeway_oneway},
        {"bikeway_oneway": "CASE WHEN \"oneway:bicycle\" = 'no' THEN 2 WHEN \"oneway:bicycle\" = 'yes' THEN 1 WHEN oneway = 'yes' THEN 1 WHEN oneway = 'no' THEN 2 ELSE -111 END"},
    ),
    "c09_duration_s": ({"duration_s": T.duration_s}, {"duration_s": DURATION}),
    "c10_passage": ({"passage": T.passage}, {"passage": PASSAGE}),
    "c11_clamp_speed": ({"clamp_mps": lambda t: F.round(T.clamp_speed(t), 6)}, {"clamp_mps": f"round({CLAMP} / 3.6, 6)"}),
    "c12_max_speed": ({"fwd_kph": lambda t: T.max_speed(t, True), "bwd_kph": lambda t: T.max_speed(t, False)}, {"fwd_kph": f"CAST({SPEED[True]} AS DOUBLE)", "bwd_kph": f"CAST({SPEED[False]} AS DOUBLE)"}),
    "c13_num_lanes": ({"fwd_lanes": lambda t: T.num_lanes(t, True), "bwd_lanes": lambda t: T.num_lanes(t, False)}, {"fwd_lanes": f"CAST({LANES[True]} AS DOUBLE)", "bwd_lanes": f"CAST({LANES[False]} AS DOUBLE)"}),
    "c14_street_parking": ({"street_parking": T.street_parking}, {"street_parking": PARKING}),
    "c15_street_class": (
        {"has_houses": T.has_houses, "is_residential": T.is_residential, "is_service": T.is_service, "is_upgradeable": T.is_upgradeable},
        {"has_houses": HOUSES, "is_residential": RESIDENTIAL, "is_service": SERVICE,
         "is_upgradeable": f"CASE WHEN highway IN ('service', 'track', 'steps') OR route = 'ferry' OR {SERVICE} = 1 OR {ACCESS} = 2 THEN 0 ELSE 1 END"},
    ),
    "c16_flags": (
        {"has_name": T.has_name, "is_area": T.is_area, "sidewalk": T.sidewalk, "bicycle_road": T.bicycle_road},
        {"has_name": "CAST(name IS NOT NULL AS INTEGER)", "is_area": "CAST(coalesce(area = 'yes', false) AS INTEGER)", "sidewalk": 'CAST("sidewalk:left" IS NOT NULL AS INTEGER)', "bicycle_road": "CAST(bicycle_road IS NOT NULL AS INTEGER)"},
    ),
    "c18_stress_from_tags": (
        {"lts": T.stress_from_tags},
        {"lts": f"""(CASE WHEN {CYCLE_TYPE} NOT IN (2, 3, 4) THEN {CYCLE_TYPE}
          WHEN ({LANE} AND {SPEED[True]} + 10 * {PARKING} > 65) OR (NOT {LANE} AND (coalesce({LANES[True]}, 2.0) > 5 OR (coalesce({LANES[True]}, 2.0) > 3 AND {SPEED[True]} <= 50) OR {SPEED[True]} > 50)) THEN 4
          WHEN {LANE} AND {SPEED[True]} + 10 * {PARKING} <= 40 AND {RESIDENTIAL} = 1 THEN 1
          WHEN {LANE} THEN CASE WHEN coalesce({LANES[True]}, 2.0) > 2 OR {RESIDENTIAL} = 0 OR {SPEED[True]} > 50 THEN 3 ELSE 2 END
          WHEN {SERVICE} = 1 THEN 2 ELSE CASE WHEN coalesce({LANES[True]}, 2.0) < 3 AND {RESIDENTIAL} = 1 THEN 2 ELSE 3 END END)"""},
    ),
    "c19_bike_speed": (
        {"work_mps": lambda t: F.round(T.bike_speed(T.cycle_type(t), T.clamp_speed(t), {0: 6 / 3.6, 1: 5.0, 2: 15 / 3.6, 3: 10 / 3.6, 4: 4 / 3.6, 5: 0.0, -1: 0.0}), 6)},
        {"work_mps": f"round(least({_case(CYCLE_TYPE, {0: 6 / 3.6, 1: 5.0, 2: 15 / 3.6, 3: 10 / 3.6, 4: 4 / 3.6, 5: 0.0, -1: 0.0})}, {CLAMP} / 3.6), 6)"},
    ),
    "c24_directed": (
        {f"{p}_{n}": (lambda t, n=n, i=i: T.both_ways(t, n)[i]) for n in ("speed_limit_kph", "street_parking") for i, p in enumerate(("fwd", "bwd", "equ", "vis"))},
        {"fwd_speed_limit_kph": f"CAST({SPEED[True]} AS DOUBLE)", "bwd_speed_limit_kph": f"CAST({SPEED[False]} AS DOUBLE)",
         "equ_speed_limit_kph": f"CASE WHEN {SPEED[True]} = {SPEED[False]} THEN 1 ELSE 0 END", "vis_speed_limit_kph": f"CASE WHEN {SPEED[True]} = {SPEED[False]} THEN CAST({SPEED[True]} AS DOUBLE) ELSE -128.0 END",
         "fwd_street_parking": PARKING, "bwd_street_parking": PARKING, "equ_street_parking": "1", "vis_street_parking": PARKING},
    ),
    "c27_lit_layer": ({"lit": T.lit, "layered": T.layered}, {"lit": "CASE WHEN lit IS NULL THEN -111 WHEN lit = 'yes' THEN 2 WHEN lit = 'no' THEN 1 END", "layered": "CASE WHEN layer IS NULL THEN -1 ELSE 100 END"}),
}


def _query(build: dict[str, Callable[[Column], Column]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ways(spark, sf_dir).select("way_id", *[b(F.col("tags")).alias(n) for n, b in build.items()])

    return run


QUERIES = {name: _query(build) for name, (build, _) in RULES.items()}
ORACLES = {name: f"WITH ways AS ({WAYS_SQL}) SELECT way_id, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM ways" for name, (_, sql) in RULES.items()}
