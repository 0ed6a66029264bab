"""Queries and their SQL twins on small tables made for a case that the driver tables hold at large sizes only."""

import pytest

from velonet.plans import registry


def at(node):
    return (node * 7919) % 20011, (node * 104729) % 20021


def same_rows(spark, folder, name, lines, suppliers=()):
    """Ways (key -> part of each line) as tables; the query's rows, which are to be those of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    made = {
        "lineitem": ([(k, p, i + 1) for k, parts in lines.items() for i, p in enumerate(parts)], "l_orderkey long, l_partkey long, l_linenumber long"),
        "supplier": ([(k,) for k in suppliers], "s_suppkey long"),
    }
    for t, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rows = registry.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted(map(tuple, rows.collect()), key=key)
    assert got == sorted(want, key=key)
    return got


@pytest.mark.parametrize("name", ["g08_dijkstra", "g13_tree_loads"])
def test_arcs_without_cost_have_no_predecessor(spark, tmp_path, name):
    # way 3 runs from node 20 to a node over 600 s away, where a second way leaves for a node one metre off in x and y
    way = 10
    x, y = at(1000002 + way * 100)
    a, b = (x + 1) * pow(7919, -1, 20011), (y + 1) * pow(104729, -1, 20021)
    there = (a * 20021 * pow(20021, -1, 20011) + b * 20011 * pow(20011, -1, 20021)) % (20011 * 20021)
    assert at(there) == (x + 1, y + 1)
    got = same_rows(spark, tmp_path, name, {3: [20, 1, 1, there], way: [there, 1]}, [1])
    assert got if name == "g13_tree_loads" else (20, 1000002 + way * 100, None) in [(r[0], r[1], r[3]) for r in got]


def test_vertical_segments(spark, tmp_path):
    # part and last node of a way at the same x and at least 1 km apart in y
    way, part = next((w, p) for w in range(3000) for p in [(1000002 + w * 100) % 20011] if p and abs(at(p)[1] - at(1000002 + w * 100)[1]) > 1000)
    assert at(part)[0] == at(1000002 + way * 100)[0]
    assert same_rows(spark, tmp_path, "x03_hash_segments", {way: [part, 1], way + 1: [5, 6, 7]})[0] == (way, 1)
