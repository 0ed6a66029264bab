"""Text column builders: street names, number extraction, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Expansions of street suffixes.
SUFFIXES = {
    "ave": "avenue", "av": "avenue", "blvd": "boulevard", "cres": "crescent", "crt": "court", "dr": "drive", "hwy": "highway", "ln": "lane",
    "pkwy": "parkway", "pl": "place", "priv": "private", "rd": "road", "st": "street", "terr": "terrace", "way": "way",
}
#: Fixed values.
CONJUNCTIONS = (" & ", " - ", " to ")
STRUCTURES = ("bridge", "tunnel", "underpass", "overpass")
DIRECTIONS = {"s": "south", "n": "north", "w": "west", "e": "east", "sw": "southwest", "se": "southeast", "nw": "northwest", "ne": "northeast"}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def parse_street_name(name: Column) -> Column:
    """Canonical name: the first of several joined names, no number or structure, long suffix, direction behind a _.

    A name without a known suffix ends in ``_?``.
    """
    s = F.lower(name)
    for c in CONJUNCTIONS:
        s = F.substring_index(s, c, 1)
    s = F.regexp_replace(F.trim(s), r"^(?:[0-9]+(?:\s+|$))+", "")
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    pop = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))

    def ended(w: Column) -> Column:
        return let(F.when(F.coalesce(last(w).isin(*STRUCTURES), F.lit(False)), pop(w)).otherwise(w), directed)

    def directed(w: Column) -> Column:
        d = F.try_element_at(_table(DIRECTIONS | {v: v for v in DIRECTIONS.values()}), F.coalesce(last(w), F.lit("")))
        return let(F.struct(d.alias("d"), F.when(d.isNotNull(), pop(w)).otherwise(w).alias("w")), named)

    def named(p: Column) -> Column:
        w, d = p["w"], p["d"]
        n = F.size(w)
        first = F.when((n > 1) & (F.get(w, 0) == "st"), "saint").otherwise(F.get(w, 0))
        end = F.coalesce(F.try_element_at(_table(SUFFIXES), last(w)), last(w))
        known = end.isin(*sorted(set(SUFFIXES.values())))
        whole = F.when(n == 1, end).otherwise(F.array_join(F.concat(F.array(first), F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))), F.array(end)), " "))
        out = F.concat(whole, F.coalesce(F.concat(F.lit("_"), d), F.lit("")), F.when(known, "").otherwise("_?"))
        return F.when(n == 0, F.coalesce(d, F.lit(""))).otherwise(out)

    return F.when(name.isNotNull(), let(words, ended))


def merge_street_names(names: Column) -> Column:
    """The one valid name of several, else ``?``."""
    valid = F.array_distinct(F.filter(names, lambda n: ~n.endswith("_?")))
    return let(valid, lambda v: F.when(F.size(v) == 1, F.get(v, 0)).otherwise("?"))


def pretty_street_name(name: Column) -> Column:
    """For display: nothing after @, no k=v words, capitals after whatever is no letter; names with ! are dropped."""
    s = F.substring_index(name, "@", 1)
    s = F.translate(s, "_?’–", "  '_")
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: (w != "") & ~w.contains("="))
    joined = F.array_join(words, " ")
    capital = lambda s: F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(F.split(s, ""), i - 1), F.lit(" ")).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")
    return F.when(name.contains("!"), "").otherwise(let(joined, capital))


def file_city_name(name: Column) -> Column:
    """Accents folded, separators as underscores."""
    folded = F.translate(name, "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
    folded = F.replace(F.replace(F.replace(F.replace(folded, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")), F.lit("Œ"), F.lit("OE")), F.lit("Æ"), F.lit("AE"))
    return F.translate(folded, " .'-", "____")


def all_ints(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))


def all_floats(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?\d*\.\d+|\d+"), F.lit(0)), lambda x: x.try_cast("double"))


def base36(n: Column) -> Column:
    """Signed base 36 in lower case."""
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lower(F.conv(F.abs(n).cast("string"), 10, 36)))


def chars64(n: Column, length: int = 4) -> Column:
    """``length`` characters of six bits each, lowest first, from the code point of 0 on."""
    return F.concat(*[F.char(F.lit(48) + F.pmod(F.shiftright(n, 6 * k), F.lit(64))) for k in range(length)])


def coordinate_code(degrees: Column) -> Column:
    """A coordinate offset by eight degrees in steps of a millionth, as four characters."""
    return chars64(F.floor((degrees + 8) * 1000000).cast("long"))


def fixed(v: Column, places: int) -> Column:
    """|v| with so many decimals (v below 2**43), rounded by its exact binary value as C does, of two equally near to the even one.

    format_string would round the shortest decimal that stands for v. The product v * 10**places is taken in two doubles.
    """
    v, scale = F.abs(v), float(10**places)
    high = v * 134217729.0
    head = high - (high - v)
    p = v * scale
    low = (head * scale - p) + (v - head) * scale
    whole = F.floor(p)
    over = (p - whole - 0.5) + low
    n = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / int(scale)).cast("string"), *([F.lit("."), F.lpad((n % int(scale)).cast("string"), places, "0")] if places else []))


def lonlat_label(lon: Column, lat: Column, places: int = 5) -> Column:
    """Degrees with a hemisphere letter each, latitude first."""
    one = lambda v, a, b: F.concat(fixed(v, places), F.lit("°"), F.when(v < 0, b).otherwise(a))
    return F.concat(one(lat, "N", "S"), F.lit(" "), one(lon, "E", "W"))


def similarity(a: Column, b: Column) -> Column:
    """0 to 100 by edit distance, without regard to case."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 100).otherwise(F.round(100 * (1 - F.levenshtein(F.lower(a), F.lower(b)) / n)).cast("int"))


def character_profile(text: Column) -> Column:
    """Which kinds of characters a value has: d digit, l lower, u upper, s space, p other."""
    has = lambda p, c: F.when(text.rlike(p), c).otherwise("")
    return F.concat(has("[0-9]", "d"), has("[a-z]", "l"), has("[A-Z]", "u"), has(r"\s", "s"), has(r"[^0-9a-zA-Z\s]", "p"))
