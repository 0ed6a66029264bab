"""Row-wise classification of tagged roads and buildings: column builders over a ``map<string,string>`` of tags.

Every builder takes the tag map and gives one column; missing tags are null. All of them stay inside the JVM's generated
code or its array functions, so a table of roads is classified in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let

# Classes of ways by the highway tag.
HIGHWAY_CLASS = {
    5: "proposed planned abandoned disused motorway motorway_link bus_guideway escape raceway bridleway highway",
    4: "trunk trunk_link primary primary_link secondary secondary_link bus_stop corridor",
    3: "tertiary tertiary_link",
    2: "residential living_street service services",
    1: "cycleway track",
    0: "path pedestrian footway steps elevator platform rest_area",
    -1: "access road unclassified",
}
# Classes by the presence of a key where there is no highway tag.
KEY_CLASS = {"cycleway": 1, "access": 2, "foot": 0}
# Kinds of cycling infrastructure.
INFRA_CLASS = {
    0: "no none share_sidewalk",
    1: "share_lane shared shared_lane share_busway opposite_share_busway lane=pictogram shared_lane=pictogram lane=advisory",
    2: "lane=permissive shoulder",
    3: "yes Yes separate designated lane opposite_lane lane=exclusive",
    4: "track opposite_track segregated",
    5: "crossing",
}
# Speed limits in km/h by surface, and by kind of highway.
SURFACE_KPH = {
    "ice": 0, "wood": 10, "metal": 10, "cobblestone:flattened": 10, "paving_stones": 10, "compacted": 10, "cobblestone": 7,
    "unpaved": 6, "fine_gravel": 10, "gravel": 6, "pebblestone": 6, "grass_paver": 6, "ground": 10, "dirt": 8, "earth": 6,
    "grass": 6, "mud": 3, "sand": 3, "woodchips": 3, "sett": 9,
    "asphalt": 100, "chipseal": 100, "paved": 100, "concrete": 100, "concrete_lanes": 100,
}
HIGHWAY_KPH = {"track": 12, "path": 12, "steps": 2, "pier": 6}
# Values that do not make a passage.
PASSAGE_NOT = {"tunnel": ("no", "culvert", "flooded"), "ferry": ("no",), "bridge": ("no",)}
# Building classes.
BUILDING_CLASS = {
    "R": "nursing_home townhouse retirement_home houseboat shelter_type boathouse shelter mcmansion apartments dormitory residential terrace house detached detatched semi-detached static_caravan cabin bungalow block semidetached_house",
    "W": "fire_station research_centre townhall factory research_institute government industrial farm office farm_auxiliary radio_station manufacture",
    "C": "fuel funeral_hall vehicle_inspection pub cinema pharmacy bank mall car_wash post_office marketplace diner food_court cafe fast_food bar studio casino nightclub pottery_studio car_rental concession_stand crematorium delivery cuisine club brand restaurant shop retail commercial supermarket art_and_craft_store kiosk",
    "P": "dentist museum doctors arts_centre sports clinic courthouse theatre public_building recreational music_school stadium library events_venue animal_shelter culture_center police veterinary conference_centre toilets childcare community_centre tourism takeaway sport social_facility social_facility:for leisure healthcare:speciality healthcare public_library gallery sports_centre recreation_centre gym public school university civic hospital hotel college kindergarten social_facility prison social_centre motel train_station",
    "S": "post_depot bicycle_parking gatehouse recycling waste_transfer_station aeroway storage utility railway_station hangar warehouse shed service barn parking greenhouse garage bleachers bunker hut stable storage_tank pavilion transportation construction garages gazebo silo",
    "0": "shrine place_of_worship parish_hall monastery denomination church convent mosque cathedral roof military embassy temple canopy synagogue chapel",
    "?": "carport porch patio bandstand tower riding_hall ter3 grandstand religious",
    "X": "no vacant portable abandoned collapsed ruins construction recreation_ground quarry reservoir allotments landfill churchyard railway garages",
}
FEET_M, LEVEL_M, MPH_KPH = 0.304, 3.2, 1.609


def words_of(vocab: dict) -> dict:
    """{value: "key key"} turned into {key: value}; a key named twice has its last value."""
    return {k: v for v, keys in vocab.items() for k in keys.split()}


def lookup(col: Column, table: dict) -> Column:
    """Value of ``col`` in a literal table; null where there is none. One set test for each value."""
    keys: dict = {}
    for k, v in table.items():
        keys.setdefault(v, []).append(k)
    out = None
    for v, ks in keys.items():
        out = F.when(col.isin(*ks), v) if out is None else out.when(col.isin(*ks), v)
    return out


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def has(tags: Column, key: str) -> Column:
    return F.map_contains_key(tags, key)


def starting(tags: Column, prefix: str) -> Column:
    """Entries (key, value) whose key begins with ``prefix``, in tag order."""
    return F.filter(F.map_entries(tags), lambda e: e["key"].startswith(prefix))


def is_in(col: Column, *values: str) -> Column:
    return F.coalesce(col.isin(*values), F.lit(False))


def eq(col: Column, value: str) -> Column:
    return F.coalesce(col == value, F.lit(False))


def flag(cond: Column) -> Column:
    return cond.cast("int")


def has_cycle_track(tags: Column) -> Column:
    return eq(tag(tags, "bicycle"), "use_sidepath") | F.exists(starting(tags, "cycleway"), lambda e: e["value"].isin("track", "opposite_track"))


def has_cycle_lane(tags: Column) -> Column:
    return (
        eq(tag(tags, "shoulder:access:bicycle"), "yes")
        | F.exists(starting(tags, "cycleway"), lambda e: (e["value"] != "no") & ~e["value"].startswith("no_"))
        | F.coalesce(F.lower(tag(tags, "bicycle")).startswith("lane"), F.lit(False))
    )


def cycle_infra(tags: Column) -> Column:
    return flag(has_cycle_lane(tags)) + 2 * flag(has_cycle_track(tags))


def _road_class(tags: Column) -> Column:
    hw = tag(tags, "highway")
    under = tag(tags, "construction")
    kind = F.when(hw == "construction", under).otherwise(hw)
    present = sum((flag(has(tags, k)) for k in KEY_CLASS), F.lit(0))
    by_key = F.lit(-1)
    for k, v in KEY_CLASS.items():
        by_key = F.when(has(tags, k), v).otherwise(by_key)
    return (
        F.when(hw.isNull(), F.when(present == 1, by_key).otherwise(-1))
        .when((hw == "construction") & under.isNull(), 5)
        .otherwise(F.coalesce(lookup(kind, words_of(HIGHWAY_CLASS)), F.lit(-1)))
    )


def cycle_type(tags: Column) -> Column:
    """-1 unclear, 0 foot, 1 cycling, 2 to 4 streets of rising class, 5 closed."""
    b, rt = tag(tags, "bicycle"), _road_class(tags)
    return (
        F.when(F.coalesce(tag(tags, "ferry") != "", F.lit(False)), 0)
        .when(eq(tag(tags, "motor_vehicle"), "no"), 1)
        .when(has_cycle_track(tags), 1)
        .when(b.isNull(), F.when(is_in(tag(tags, "access"), "no", "private"), 5).otherwise(rt))
        .when(b.isin("unknown", "use_sidepath", "lane", "lanes"), rt)
        .when(b.isin("yes", "permissive"), F.when(rt == 5, 4).when(rt == 0, 1).otherwise(rt))
        .when(b == "designated", 1)
        .when(b == "dismount", 0)
        .when(b.isin("private", "dangerous"), 5)
        .when(b == "no", F.when(rt == 1, 0).otherwise(rt))
        .otherwise(-1)
    )


def bike_access(tags: Column, kind: Column | None = None) -> Column:
    """0 neutral, 1 dismount, 2 forbidden, 3 allowed. ``kind`` is the cycle_type() of the row, if it is at hand."""
    b, f = tag(tags, "bicycle"), tag(tags, "foot")
    return (
        F.when((cycle_type(tags) if kind is None else kind) == 5, 2)
        .when(b == "dismount", 1)
        .when(b.isin("yes", "designated"), 3)
        .when(b == "no", F.when(f.isNull() | f.isin("yes", "designated"), 1).when(f == "no", 2).otherwise(0))
        .when(b == "private", F.when(eq(f, "private"), 2).otherwise(1))
        .otherwise(0)
    )


def bike_infra(tags: Column, forward: bool) -> Column:
    """Class of the infrastructure on the right side (forward) or the left one; unclear descriptions are class 1.

    The usual keys are looked up one by one; only ways with other cycleway keys are parsed key by key.
    """
    usual = [f"cycleway{side}{part}" for side in ("", ":left", ":right", ":both") for part in ("", ":oneway", ":lane")]
    odd = F.exists(F.map_keys(tags), lambda k: k.startswith("cycleway") & ~k.isin(*usual))
    doubled = F.lit(False)
    for part in ("", ":oneway", ":lane"):
        doubled = doubled | (has(tags, f"cycleway{part}") & has(tags, f"cycleway:both{part}"))

    def of(side: str) -> tuple[Column, Column, Column]:
        get = lambda part: F.coalesce(tag(tags, f"cycleway:{side}{part}"), tag(tags, f"cycleway{part}")) if side == "both" else tag(tags, f"cycleway:{side}{part}")
        plain = get("")
        return F.when(plain != "no", plain), F.concat(F.lit("oneway="), get(":oneway")), get(":lane")

    right, left, both = of("right"), of("left"), of("both")
    own, other = (right, left) if forward else (left, right)
    some = lambda s: F.coalesce(*s).isNotNull()
    pack = lambda s: F.struct(s[0].alias("plain"), F.when(s[1] != "oneway=no", s[1]).alias("way"), s[2].alias("lane"))
    chosen = F.when(some(own), pack(own)).when(some(both), pack(both)).when(eq(other[1], "oneway=no"), pack(other))

    def named(s: Column) -> Column:
        base, lane = F.coalesce(s["plain"], s["way"]), s["lane"]
        return F.when(s["plain"].isNotNull() & s["way"].isNotNull(), "?").when(lane.isNull(), base).otherwise(F.coalesce(F.concat(base, F.lit("="), lane), F.concat(F.lit("lane="), lane)))

    fast = let(let(chosen, named), lambda k: F.when(k.isNull(), 0).otherwise(F.coalesce(lookup(k, words_of(INFRA_CLASS)), F.lit(1))))
    return F.when(~odd & ~doubled, fast).otherwise(_parsed_infra(tags, forward))


def _parsed_infra(tags: Column, forward: bool) -> Column:
    """bike_infra() for any cycleway keys, whatever the order of their parts."""

    def parse(e: Column) -> Column:
        parts = F.array_distinct(F.split(e["key"], ":"))
        rest = F.array_except(parts, F.array(F.lit("cycleway")))
        side = F.when(F.array_contains(rest, "both"), "both").when(F.array_contains(rest, "left"), "left").when(F.array_contains(rest, "right"), "right").otherwise("both")
        rest = F.array_except(rest, F.array(side))
        word = F.when(F.array_contains(rest, "oneway"), "oneway").when(F.array_contains(rest, "lane"), "lane")
        plain = (F.size(rest) == 0) & (e["value"] != "no")
        item = F.when(plain, e["value"]).when((F.size(rest) > 0) & word.isNotNull(), F.concat(word, F.lit("="), e["value"]))
        left_over = F.size(rest) > F.when(word.isNotNull(), 1).otherwise(0)
        known = F.array_contains(parts, "cycleway")
        return F.struct(side.alias("side"), item.alias("item"), (left_over | ~known).alias("bad"))

    def choose(parsed: Column) -> Column:
        of = lambda side: F.filter(F.transform(F.filter(parsed, lambda p: p["side"] == side), lambda p: p["item"]), lambda x: x.isNotNull())
        right, left, both = of("right"), of("left"), of("both")
        own, other = (right, left) if forward else (left, right)
        items = F.when(F.size(own) > 0, own).when(F.size(both) > 0, both).when(F.array_contains(other, "oneway=no"), other).otherwise(F.array().cast("array<string>"))
        return F.when(F.exists(parsed, lambda p: p["bad"]), 1).otherwise(let(F.array_remove(F.array_distinct(items), "oneway=no"), value))

    def value(items: Column) -> Column:
        lanes = F.filter(items, lambda x: x.startswith("lane="))
        base = F.filter(items, lambda x: ~x.startswith("lane="))
        kind = F.when(F.size(items) == 1, F.get(items, 0)).when((F.size(items) == 2) & (F.size(lanes) == 1), F.concat(F.get(base, 0), F.lit("="), F.substring(F.get(lanes, 0), 6, 100)))
        return F.when(F.size(items) == 0, 0).otherwise(F.coalesce(lookup(kind, words_of(INFRA_CLASS)), F.lit(1)))

    entries = starting(tags, "cycleway")
    return F.when(F.size(entries) == 0, 0).otherwise(let(F.transform(entries, parse), choose))


def force_dismount(tags: Column) -> Column:
    c = tag(tags, "bicycle:conditional")
    return flag(is_in(tag(tags, "bicycle"), "no", "dismount") | F.coalesce((c == "no") | c.startswith("no "), F.lit(False)))


def motor_allowed(tags: Column, kind: Column | None = None) -> Column:
    return flag(~(cycle_type(tags) if kind is None else kind).isin(0, 1))


def oneway(tags: Column) -> Column:
    v = F.lower(F.trim(tag(tags, "oneway")))
    return F.when(v.isNull(), flag(eq(tag(tags, "junction"), "roundabout"))).when(v.isin("true", "yes"), 1).when(v == "-1", -1).otherwise(0)


def bikeway_oneway(tags: Column) -> Column:
    """2 two-way, 1 one-way, -111 unknown."""
    b, c = tag(tags, "oneway:bicycle"), tag(tags, "oneway")
    return F.when(b == "no", 2).when(b == "yes", 1).when(c == "yes", 1).when(c == "no", 2).otherwise(-111)


def duration_s(tags: Column) -> Column:
    """Seconds of a ferry's H:M[:S]; 0 without one, null where it cannot be read."""
    d = F.trim(tag(tags, "duration"))
    part = lambda i: F.get(F.split(d, ":"), i).try_cast("int")
    n = F.size(F.split(d, ":"))
    total = 3600 * part(0) + 60 * part(1) + F.when(n == 3, part(2)).otherwise(0)
    return F.when(d.isNull(), 0).when(d == "PT10M", 600).when(n.isin(2, 3) & (total > 0), total)


def passage(tags: Column) -> Column:
    """Code point of t, f or b for a tunnel, ferry or bridge; 1 for several at once, 0 for none."""
    real = {k: F.coalesce((tag(tags, k) != "") & ~tag(tags, k).isin(*no), F.lit(False)) for k, no in PASSAGE_NOT.items()}
    n = sum((flag(c) for c in real.values()), F.lit(0))
    one = F.lit(0)
    for k, c in real.items():
        one = F.when(c, ord(k[0])).otherwise(one)
    return F.when(eq(tag(tags, "route"), "ferry"), ord("f")).when(n == 0, 0).when(n > 1, 1).otherwise(one)


def clamp_kph(tags: Column) -> Column:
    hw = tag(tags, "highway")
    by_road = F.when(hw.startswith("parking"), 10).otherwise(lookup(hw, HIGHWAY_KPH))
    return F.least(F.lit(100), F.coalesce(by_road, F.lit(100)), F.coalesce(lookup(tag(tags, "surface"), SURFACE_KPH), F.lit(100)))


def clamp_speed(tags: Column) -> Column:
    """Metres a second that the surface and the kind of road allow."""
    return clamp_kph(tags) / 3.6


def max_speed(tags: Column, forward: bool) -> Column:
    """km/h; 50 where the tags conflict or cannot be read."""
    plain, ahead, back = (tag(tags, "maxspeed" + s) for s in ("", ":forward", ":backward"))
    form = F.concat(*[flag(c.isNotNull()).cast("string") for c in (plain, ahead, back)])
    source = F.when(form == "100", plain)
    if forward:
        source = source.when(form.isin("011", "010"), ahead).when(form == "101", plain)
    else:
        source = source.when(form.isin("011", "101", "001"), back)
    hw = tag(tags, "highway")
    default = F.when(hw.startswith("motorway"), 100).when(hw.startswith("trunk"), 60).when(hw.startswith("primary") | hw.startswith("secondary"), 80).otherwise(50)
    low = F.lower(source)
    mph = (F.trim(F.regexp_replace(low, "mph", "")).try_cast("int") * MPH_KPH).cast("int")
    # a bare "national" fails to parse and ends in the fallback
    number = F.when(low.contains("mph"), mph).otherwise(F.trim(low).try_cast("int"))
    read = F.when(number > 100, 100).otherwise(number)
    return F.when(form.isin("110", "111"), 50).when(source.isNotNull(), F.coalesce(read, F.lit(50))).otherwise(F.coalesce(default, F.lit(50))).cast("double")


def num_lanes(tags: Column, forward: bool) -> Column:
    """Lanes, 4 at most, 2 by default; of "a;b" the part of the direction. Null where it cannot be read."""
    own = tag(tags, "lanes:forward" if forward else "lanes:backward")
    text = F.coalesce(own, tag(tags, "lanes"), tag(tags, "numlanes"))
    pair = F.split(text, ";")
    value = F.when(F.size(pair) == 1, F.trim(text)).when(own.isNull() & (F.size(pair) == 2), F.trim(F.get(pair, 0 if forward else 1)))
    return F.when(text.isNull(), 2.0).otherwise(F.when(value.try_cast("double") > 4, 4.0).otherwise(value.try_cast("double")))


def street_parking(tags: Column) -> Column:
    """1 with parking at the kerb; the first parking:lane key decides."""
    first = F.get(starting(tags, "parking:lane"), 0)["value"]
    return F.when(eq(tag(tags, "parking"), "yes"), 1).when(first.isNull(), 0).otherwise(flag((first != "no") & ~first.startswith("no_")))


def _kind_in(tags: Column, *kinds: str) -> Column:
    hw = tag(tags, "highway")
    return is_in(hw, *kinds) | (eq(hw, "construction") & is_in(tag(tags, "construction"), *kinds))


def has_houses(tags: Column) -> Column:
    return flag(_kind_in(tags, "residential", "living_street", "tertiary", "tertiary_link"))


def is_residential(tags: Column) -> Column:
    return flag(_kind_in(tags, "residential", "living_streets"))


def is_service(tags: Column) -> Column:
    return flag(_kind_in(tags, "service") & is_in(tag(tags, "service"), "alley", "parking_aisle", "driveway"))


def is_upgradeable(tags: Column, access: Column | None = None) -> Column:
    hw = tag(tags, "highway")
    return flag(~(is_in(hw, "service", "track", "steps") | eq(tag(tags, "route"), "ferry") | (is_service(tags) == 1) | ((bike_access(tags) if access is None else access) == 2)))


def sidewalk(tags: Column) -> Column:
    return flag(F.exists(F.map_keys(tags), lambda k: k.contains("sidewalk")))


def bicycle_road(tags: Column) -> Column:
    return flag(has(tags, "bicycle_road"))


def has_name(tags: Column) -> Column:
    return flag(has(tags, "name"))


def is_area(tags: Column) -> Column:
    return flag(eq(tag(tags, "area"), "yes"))


def lit(tags: Column) -> Column:
    return F.when(tag(tags, "lit").isNull(), -111).when(tag(tags, "lit") == "yes", 2).when(tag(tags, "lit") == "no", 1)


def layered(tags: Column) -> Column:
    return F.when(has(tags, "layer"), 100).otherwise(-1)


def building_type(tags: Column) -> Column:
    table = words_of(BUILDING_CLASS) | {"user defined": "?"}
    bt = F.lower(F.coalesce(tag(tags, "building"), tag(tags, "building:part"), F.lit("no")))
    amenity = F.nullif(tag(tags, "amenity"), F.lit(""))
    classes = F.array_distinct(F.filter(F.transform(F.map_keys(tags), lambda k: lookup(k, table)), lambda c: c.isNotNull()))
    by_keys = F.when(F.size(classes) == 1, F.get(classes, 0)).when(F.size(classes) == 0, "R").otherwise("?")
    kind = F.when((bt == "yes") & amenity.isNotNull(), amenity).otherwise(bt)
    return F.when(bt == "no", "X").when((bt == "yes") & amenity.isNull(), by_keys).otherwise(F.coalesce(lookup(kind, table), F.lit("?")))


def building_use(kind: Column) -> Column:
    """Homes, workplaces (also shops and public buildings), or neither."""
    return F.when(kind == "R", "R").when(kind.isin("W", "C", "P"), "W").otherwise("?")


def building_height_m(tags: Column) -> Column:
    """Metres, LEVEL_M at least; the number of levels never raises a building (its minimum with 0 is taken)."""
    h = F.regexp_replace(F.coalesce(tag(tags, "height"), tag(tags, "building:height"), F.lit("")), " ", "")
    metres = F.when(h.endswith("m"), F.regexp_replace(h, "m$", "").try_cast("double")).when(h.endswith("'"), FEET_M * F.regexp_replace(h, "'$", "").try_cast("double")).otherwise(h.try_cast("double"))
    return F.greatest(F.lit(LEVEL_M), F.coalesce(metres, F.lit(0.0)))


def bike_speed(lts: Column, clamp_mps: Column, speeds: dict[int, float]) -> Column:
    """Slower of what a profile rides at a stress level and what the road allows."""
    return F.least(lookup(lts, speeds), clamp_mps)


def clean_values(col: Column, typos: dict[str, str] | None = None) -> Column:
    """Lower-cased list of values cut at ; / \\ and commas, stripped of spaces and underscores, known typos mended."""
    parts = F.transform(F.split(F.lower(col), r"[;/\\,]"), lambda x: F.regexp_replace(F.trim(x), "^_+|_+$", ""))
    return F.transform(parts, lambda x: F.coalesce(lookup(x, typos), x)) if typos else parts


def clean_numbers(col: Column) -> Column:
    """The same list as km/h: mph converted, null for what is no number."""
    return F.transform(clean_values(col), lambda x: F.when(x.contains("mph"), F.trim(F.regexp_replace(x, "mph", "")).try_cast("double") * MPH_KPH).otherwise(x.try_cast("double")))


def decode(text: Column) -> Column:
    """Tag map of a string whose first character separates keys and values alternately; repeated keys: the last."""
    parts = F.split(F.substring(text, 2, 1 << 30), F.concat(F.lit("\\Q"), F.substring(text, 1, 1), F.lit("\\E")))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.get(parts, 2 * i), F.get(parts, 2 * i + 1)))
    return F.when(F.length(text) > 1, F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<string,string>"))


def encode(tags: Column, separator: str = "\0") -> Column:
    """Inverse of decode()."""
    flat = F.flatten(F.transform(F.map_entries(tags), lambda e: F.array(e["key"], e["value"])))
    return F.concat(F.lit(separator), F.array_join(flat, separator))


#: Name -> builder of the properties that do not depend on direction: the surface for user-defined rules.
RULES: dict[str, Callable[[Column], Column]] = {
    "has_name": has_name, "passage_type": passage, "clamp_mps": clamp_speed, "clamp_kph": lambda t: clamp_kph(t).cast("double"),
    "vis_clamp": lambda t: F.least(F.lit(5), ((clamp_kph(t) + 1) / 3).cast("int")), "has_houses": has_houses,
    "is_residential": is_residential, "is_service": is_service, "has_duration": lambda t: flag(F.coalesce(duration_s(t) > 0, F.lit(False))),
    "oneway": oneway, "bicycle_road": bicycle_road, "sidewalk": sidewalk, "bike_access": bike_access, "motor_allowed": motor_allowed,
    "cycle_type": cycle_type, "is_area": is_area, "is_upgradeable": is_upgradeable, "dur_s": duration_s,
}
#: Name -> (builder of (tags, forward), what the combined column shows where the directions differ).
DIRECTED: dict[str, tuple[Callable[[Column, bool], Column], float]] = {
    "speed_limit_kph": (max_speed, -128.0), "num_lanes": (num_lanes, -128.0), "force_dismount": (lambda t, f: force_dismount(t), -128),
    "osm_infra": (bike_infra, -128), "street_parking": (lambda t, f: street_parking(t), -128),
}


def both_ways(tags: Column, name: str) -> list[Column]:
    """fwd_, bwd_, equ_ and vis_ columns of a directed property."""
    build, differ = DIRECTED[name]
    f, b = build(tags, True), build(tags, False)
    same = f.eqNullSafe(b)
    return [f.alias(f"fwd_{name}"), b.alias(f"bwd_{name}"), flag(same).alias(f"equ_{name}"), F.when(same, f).otherwise(differ).alias(f"vis_{name}")]


def road_attributes(roads: DataFrame, tags: str = "tags") -> DataFrame:
    """``roads`` with all properties of RULES and DIRECTED in place of its tag map.

    Three projections, so that what others build on is computed once: directed values and the cycling class, then
    access and the comparisons of directions, then what depends on access.
    """
    t = F.col(tags)
    later = {"bike_access": lambda t: bike_access(t, F.col("cycle_type")), "motor_allowed": lambda t: motor_allowed(t, F.col("cycle_type"))}
    first = {n: b(t) for n, b in RULES.items() if n not in later and n != "is_upgradeable"}
    first |= {f"{d}_{n}": b(t, d == "fwd") for n, (b, _) in DIRECTED.items() for d in ("fwd", "bwd")}
    out = roads.withColumns(first)
    second = {n: b(t) for n, b in later.items()}
    for n, (_, differ) in DIRECTED.items():
        f, b = F.col(f"fwd_{n}"), F.col(f"bwd_{n}")
        second |= {f"equ_{n}": flag(f.eqNullSafe(b)), f"vis_{n}": F.when(f.eqNullSafe(b), f).otherwise(differ)}
    return out.withColumns(second).withColumn("is_upgradeable", is_upgradeable(t, F.col("bike_access"))).drop(tags)


def draw_speed(tags: Column, lts: Column, speeds: dict[int, float]) -> Column:
    """Share of the top speed at a stress level, just under 1 where the road does not slow a rider down."""
    return (bike_speed(lts, clamp_speed(tags), speeds) - 0.001) / speeds[1]


def draw_highway_type(tags: Column) -> Column:
    """Colour value of the cycling class: 0 for cycling, shares for unclear ways, -1 for the rest."""
    ct = cycle_type(tags)
    return F.when(ct < 0, -ct / 8.00001).when(ct == 1, 0.0).otherwise(-1.0)


def stress_from_tags(tags: Column) -> Column:
    """Stress level straight from the tags, without imported infrastructure; service ways of mixed traffic are level 2."""
    ct, ms, la = cycle_type(tags), max_speed(tags, True), F.coalesce(num_lanes(tags, True), F.lit(2.0))
    lane, home = has_cycle_lane(tags), is_residential(tags) == 1
    ps = ms + 10 * street_parking(tags)
    return (
        F.when(~ct.isin(2, 3, 4), ct)
        .when((lane & (ps > 65)) | (~lane & ((la > 5) | ((la > 3) & (ms <= 50)) | (ms > 50))), 4)
        .when(lane & (ps <= 40) & home, 1)
        .when(lane, F.when((la > 2) | ~home | (ms > 50), 3).otherwise(2))
        .when(is_service(tags) == 1, 2)
        .otherwise(F.when((la < 3) & home, 2).otherwise(3))
    )
