"""Outlines of cities (F9): areas of rings are made once, not anew for every corner by a filter that moves down."""

from velonet.operators import city as C


def test_the_area_of_a_ring_is_filtered_behind_its_making(spark):
    steps = [(1, 7, [float(x) for x in (0, 10, 10, 0)], [0.0, 0.0, 10.0, 10.0])] + [(k + 1, 7, [float(v) for v in (10 * k, 10 * k + 12, 10 * k + 12, 10 * k)], [0.0, 0.0, 10.0 + k, 10.0 + k]) for k in range(1, 40)]
    parcels = spark.createDataFrame(steps, "poly long, city long, xs array<double>, ys array<double>")
    out = C.outlines(parcels, C.city_parcels(parcels, 0.0, 100.0), 100.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "lambda" in line for line in plan.splitlines())
    row = out.collect()[0]
    # each box reaches 2 m into the next one, which is 1 m higher; the last one ends 2 m further
    assert (row["l"], row["r"], row["b"], row["t"]) == (0.0, 402.0, 0.0, 49.0) and abs(row["area"] - (sum(10 * (10 + k) for k in range(40)) + 2 * 49)) < 1e-6
