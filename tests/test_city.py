"""City assembly and slopes on small cases."""

from velonet.operators import city as C
from velonet.operators import spatial as S
from velonet.params import SLOPE_PENALTY


def box(x, y, w=10.0, h=10.0):
    return [float(v) for v in (x, x + w, x + w, x)], [float(v) for v in (y, y, y + h, y + h)]


def test_pairs_within(spark):
    rows = [(1, *box(0, 0)), (2, *box(10, 0)), (3, *box(24, 0)), (4, *box(2, 2, 3.0, 3.0)), (5, *box(-5, 4, 40.0, 2.0)), (6, [], []), (7, None, None)]
    df = spark.createDataFrame(rows, "poly long, xs array<double>, ys array<double>")
    got = {tuple(r) for r in C.polygons_within(df, df, 0.0, 7.0).filter("a < b").collect()}
    assert got == {(1, 2), (1, 4), (1, 5), (2, 5), (3, 5), (4, 5)}
    near = {tuple(r) for r in C.polygons_within(df, df, 4.0, 7.0).filter("a < b").collect()}
    assert near == got | {(2, 3)}
    small = C.polygons_within(df.filter("poly = 4"), df.filter("poly = 1"), 0.5, 100.0).collect()
    assert [tuple(r) for r in small] == [(4, 1)]


def test_city_parcels(spark):
    rows = [(1, "A", *box(0, 0)), (2, "A", *box(10, 0)), (3, "A", *box(100, 0, 15.0)), (4, "B", *box(20, 0)), (5, None, *box(25, 12)), (6, "B", *box(500, 500)), (7, None, *box(110, 12)), (8, "C", [], [])]
    df = spark.createDataFrame(rows, "poly long, city string, xs array<double>, ys array<double>")
    got = {tuple(r) for r in C.city_parcels(df, 6.0, 8.0).collect()}
    # equal parts: the one with the smaller parcel; 2 and 4 touch but belong to two cities
    assert got == {("A", 1, "main"), ("A", 2, "main"), ("A", 3, "detached"), ("A", 4, "around"), ("A", 5, "around"), ("B", 4, "main"), ("B", 6, "detached"), ("B", 2, "around"), ("B", 5, "around")}


def test_slopes(spark):
    rows = [(1, k, 10.0, h, False) for k, h in enumerate((0.0, 0.4, 0.4, -0.6))] + [(2, 0, 10.0, 0.0, True), (2, 1, 10.0, None, True), (3, 0, 10.0, 1.0, False), (3, 1, 10.0, None, False), (4, 0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "line long, k long, gap double, h double, passage boolean")
    got = {r["line"]: r for r in S.slopes(df, SLOPE_PENALTY).collect()}
    flat = SLOPE_PENALTY[11]
    assert set(got) == {1, 2, 3}
    assert (got[1]["abs_slope_min"], got[1]["abs_slope_max"], got[1]["abs_slope_avg"]) == (0, 6, 4)
    up = (SLOPE_PENALTY[15] + flat + SLOPE_PENALTY[1]) / 3, (SLOPE_PENALTY[7] + flat + SLOPE_PENALTY[21]) / 3
    assert abs(got[1]["fwd_climb"] - up[0]) < 1e-9 and abs(got[1]["bwd_climb"] - up[1]) < 1e-9
    assert got[2]["abs_slope_max"] == 0 and got[3]["abs_slope_max"] == -127 and got[3]["fwd_climb"] == flat


def test_dense_cities_meet_by_cell(spark, monkeypatch):
    import random

    rng = random.Random(5)
    near = [(k, "AB"[k % 2], *box(rng.uniform(0, 60), rng.uniform(0, 60), 4.0, 3.0)) for k in range(200)]
    far = [(200 + k, "C", *box(rng.uniform(0, 200), rng.uniform(0, 200), 4.0, 3.0)) for k in range(40)]
    df = spark.createDataFrame(near + far, "poly long, city string, xs array<double>, ys array<double>")
    gap = lambda p, q: (max(p[2][0] - q[2][1], q[2][0] - p[2][1], 0) ** 2 + max(p[3][0] - q[3][2], q[3][0] - p[3][2], 0) ** 2) ** 0.5
    expected = {(p[1], q[0]) for p in near for q in near + far if gap(p, q) <= 25.0}
    asked = []
    plain = C.polygons_within

    def counted(these, those, *more):
        asked.append(those.count())
        return plain(these, those, *more)

    monkeypatch.setattr(C, "polygons_within", counted)
    got = C.groups_within(df.filter("city < 'C'"), df, 25.0, 20.0)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    # corners in a common cell settle all pairs of the dense cities; the edges of only a few others are compared
    assert len(asked) == 1 and asked[0] < 60
