"""Relations of both street-map formats, and the rings that their ways form."""

import struct
import zlib

from test_sources import _field, _varint, _zig

from velonet.operators import rings
from velonet.sources import readers as R

XML = """<osm>
<relation id="5"><member type="way" ref="1" role="outer"/><member type="way" ref="2" role=""/><member type="node" ref="9" role="label"/><member type="way" ref="3" role="inner"/><tag k="type" v="multipolygon"/><tag k="name" v="Lake"/></relation>
<relation id="6"><member type="way" ref="1" role="outer"/><tag k="type" v="route"/></relation>
<relation id="7"><tag k="type" v="boundary"/></relation></osm>"""
WANT = {5: ([("way", 1, "outer"), ("way", 2, ""), ("node", 9, "label"), ("way", 3, "inner")], {"type": "multipolygon", "name": "Lake"}), 6: ([("way", 1, "outer")], {"type": "route"}), 7: ([], {"type": "boundary"})}


def read(df):
    return {r.relation_id: ([tuple(m) for m in r.members], r.tags) for r in df.collect()}


def test_xml(spark, tmp_path):
    (tmp_path / "m.osm").write_text(XML)
    got = R.osm_xml_relations(spark, str(tmp_path / "m.osm"))
    assert read(got) == WANT
    assert sorted(tuple(r) for r in R.member_ways(got).collect()) == [(5, 1, "outer"), (5, 2, ""), (5, 3, "inner")]


def test_pbf(spark, tmp_path):
    words = ["", "outer", "label", "inner", "type", "multipolygon", "name", "Lake", "route", "boundary"]
    kinds = ("node", "way", "relation")
    groups = b""
    for i, (members, tags) in WANT.items():
        ids, last = b"", 0
        for _, ref, _ in members:
            ids, last = ids + _zig(ref - last), ref
        f = _field(1, i) + _field(2, bytes(words.index(k) for k in tags)) + _field(3, bytes(words.index(v) for v in tags.values()))
        f += _field(8, b"".join(_varint(words.index(m[2])) for m in members)) + _field(9, ids) + _field(10, bytes(kinds.index(m[0]) for m in members))
        groups += _field(2, _field(4, f))
    block = _field(1, b"".join(_field(1, w.encode()) for w in words)) + groups
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    head = _field(1, b"OSMData") + _field(3, len(blob))
    (tmp_path / "m.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob)
    assert read(R.osm_pbf_relations(spark, str(tmp_path / "m.pbf"))) == WANT


def test_rings_of_relations(spark):
    ways = {1: [1, 2, 3], 2: [5, 4, 3], 3: [5, 1], 4: [11, 12, 13, 11], 5: [21, 22], 6: [22, 23], 7: [30, 31, 32], 8: [32, 33, 30], 9: [40]}
    members = [(100, w) for w in (2, 1, 3, 4, 99, 4)] + [(200, w) for w in (5, 6, 1, 9)] + [(300, w) for w in (7, 8)] + [(400, w) for w in (1, 2)]
    got = rings.joined_ways(spark.createDataFrame(members, "relation_id long, way_id long"), spark.createDataFrame(list(ways.items()), "way_id long, refs array<long>")).collect()
    turn = lambda refs: min(tuple(seq[k:] + seq[:k]) for seq in (list(refs), list(refs)[::-1]) for k in range(len(refs)))
    assert sorted((r.relation_id, turn(r.refs)) for r in got) == [(100, (1, 2, 3, 4, 5)), (100, (11, 12, 13)), (300, (30, 31, 32, 33))]
    none = spark.createDataFrame([], "relation_id long, way_id long")
    assert rings.joined_ways(none, spark.createDataFrame(list(ways.items()), "way_id long, refs array<long>")).collect() == []


def test_multipolygons(spark):
    """An outline of three ways around a hole with an island; a ring with a node that has no place is left out."""
    at = {1: (0, 0), 2: (30, 0), 3: (30, 30), 4: (0, 30), 11: (5, 5), 12: (20, 5), 13: (20, 20), 14: (5, 20), 21: (8, 8), 22: (12, 8), 23: (8, 12), 31: (50, 50), 32: (60, 50)}
    ways = {1: [1, 2], 2: [4, 3, 2], 3: [1, 4], 4: [11, 12, 13], 5: [11, 14, 13], 6: [21, 22, 23, 21], 7: [31, 32, 33, 31]}
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in at.items()], "node_id long, x double, y double")
    got = rings.multipolygons(spark.createDataFrame([(8, w) for w in ways], "relation_id long, way_id long"), spark.createDataFrame(list(ways.items()), "way_id long, refs array<long>"), nodes, 25.0).collect()
    by = {r.depth: r for r in got}
    assert len(got) == 3 and by[1].parent == by[0].ring and by[2].parent == by[1].ring and by[0].parent is None
    assert {len(r.xs) for r in got} == {3, 4}
