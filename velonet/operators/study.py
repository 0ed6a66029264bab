"""Study operators: stress levels, accessibility by cell, load classes, upgrade threads and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velonet.functions import arrays as A


def core_stress(cycle_type: Column, infra: Column, kph: Column, lanes: Column, parking: Column, residential: Column) -> Column:
    """Stress level from infrastructure, speed, lanes, parking and the kind of street; -1 where nothing applies."""
    lane = infra == 3
    perceived = kph + 10 * parking
    return (
        F.when(infra == 4, 1)
        .when(~cycle_type.isin(2, 3, 4), cycle_type)
        .when((lane & (perceived > 65)) | (~lane & ((lanes > 5) | ((lanes > 3) & (kph <= 50)) | (kph > 50))), 4)
        .when(lane & (perceived <= 40) & (residential == 1), 1)
        .when(lane, F.when((lanes > 2) | (residential == 0) | (kph > 50), 3).otherwise(2))
        .when(kph <= 50, F.when((lanes < 3) & (residential == 1), 2).otherwise(3))
        .otherwise(-1)
    )


def raised(core: Column, infra: Column, access: Column) -> Column:
    """A path with infrastructure or express access is ridden, not walked."""
    return F.when((core == 0) & ((infra > 0) | (access == 3)), 1).otherwise(core)


def settled(level: Column, access: Column, passage: Column, dismount: Column) -> Column:
    """Dismounting turns riding into walking; closed ways, ferries and unclear cases have levels of their own."""
    return F.when(access == 2, 5).when(passage == ord("f"), 10).when((level == 1) & ((dismount == 1) | (access == 1)), 0).when(level == -1, 3).otherwise(level)


def stress(access: Column, passage: Column, cycle_type: Column, infra: Column, kph: Column, lanes: Column, parking: Column, residential: Column, dismount: Column) -> Column:
    """Level of traffic stress: 0 on foot, 1 to 4, 5 closed, 10 ferry."""
    return settled(raised(core_stress(cycle_type, infra, kph, lanes, parking, residential), infra, access), access, passage, dismount)


def stress_table(roads: DataFrame) -> DataFrame:
    """Levels now and with a painted lane, by direction, and which upgrades would help.

    ``roads`` has the columns of tags.road_attributes() and fwd_best_infra, bwd_best_infra.
    """
    c = F.col

    def levels(df: DataFrame, infra: dict[str, Column]) -> DataFrame:
        """Columns of stress levels, in projections of their own, so that each step is computed once."""
        core = {n: core_stress(c("cycle_type"), i, c(f"{n[:3]}_speed_limit_kph"), F.coalesce(c(f"{n[:3]}_num_lanes"), F.lit(2.0)), c(f"{n[:3]}_street_parking"), c("is_residential")) for n, i in infra.items()}
        df = df.withColumns(core)
        df = df.withColumns({n: raised(c(n), i, c("bike_access")) for n, i in infra.items()})
        return df.withColumns({n: settled(c(n), c("bike_access"), c("passage_type"), c(f"{n[:3]}_force_dismount")) for n in infra})

    out = levels(roads, {f"{d}_lts": c(f"{d}_best_infra") for d in ("fwd", "bwd")})
    out = levels(out, {f"{d}_lts_lane": F.greatest(F.lit(3), c(f"{d}_best_infra")) for d in ("fwd", "bwd")})
    out = out.withColumns({f"{d}_lts_lane": F.when(c(f"{d}_lts") == 0, 1).when(c(f"{d}_lts").isin(2, 3, 4), c(f"{d}_lts_lane")).otherwise(c(f"{d}_lts")) for d in ("fwd", "bwd")})
    for d in ("fwd", "bwd"):
        now, lane = c(f"{d}_lts"), c(f"{d}_lts_lane")
        out = out.withColumns({
            f"{d}_candidate_lane": (((now > 2) & (lane < 3)) | ((now == 0) & (lane == 1))).cast("int"),
            f"{d}_candidate_track": ((now == 3) | ((now == 4) & (lane > 2))).cast("int"),
        })
        out = out.withColumn(f"{d}_candidate_infra", F.when(c(f"{d}_candidate_track") == 1, 2).otherwise(c(f"{d}_candidate_lane")))
    f, b = c("fwd_lts"), c("bwd_lts")
    return out.withColumns({
        "equ_lts": (f == b).cast("int"),
        "vis_lts": F.greatest(f, F.when(f == b, -127).otherwise(127)),
        "lane_makes_worse": (((c("fwd_lts_lane") > f) & (f > 0)) | ((c("bwd_lts_lane") > b) & (b > 0))).cast("int"),
        "equ_candidate_infra": (c("fwd_candidate_infra") == c("bwd_candidate_infra")).cast("int"),
        "vis_candidate_infra": F.greatest("fwd_candidate_infra", "bwd_candidate_infra"),
    })


def best_infra(own: Column, imported: Column) -> Column:
    """Imported infrastructure, where there is any, replaces the tagged one."""
    return F.coalesce(imported, own)


def bikeability(work_s: Column, super_s: Column, min_s: float, max_s: float) -> Column:
    """How much longer the way takes than on a network without stress; null outside the limits."""
    return F.when((super_s > min_s) & (super_s < max_s) & (work_s < max_s), work_s / super_s - 1)


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, mean, weight) over finite values only; a partial aggregate merges before the shuffle."""
    v = A.finite(F.col(value))
    w = F.sum(F.when(v.isNotNull(), F.col(weight)))
    s = F.sum(v * F.col(weight))
    return df.groupBy(*keys).agg((s / F.nullif(w, F.lit(0.0))).alias("mean"), F.coalesce(w, F.lit(0.0)).alias("weight"))


def histogram(df: DataFrame, key: str) -> DataFrame:
    """(key, n, percent): counts and their share of all rows."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(key, "n", (100 * F.col("n") / F.col("total")).alias("percent"))  # one row


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value, of equals the largest."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.max(F.struct("n", value)).alias("m")).select(key, f"m.{value}", "m.n")


def load_classes(loads: DataFrame) -> DataFrame:
    """``loads`` (tr_id, fwd_load, bwd_load, fwd_lts, bwd_lts) with class and priority by direction.

    Classes are decades below the largest load of both directions, 0 to 7, none where the level is 1 or 2; a class over
    4 is the priority, and the code of a quiet street is added to it.
    """
    most = loads.agg(F.log10(F.greatest(F.max("fwd_load"), F.max("bwd_load")) + 1e-20).alias("most"))
    out = loads.crossJoin(F.broadcast(most))  # one row
    for d in ("fwd", "bwd"):
        lts = F.col(f"{d}_lts")
        v = F.bround(F.log10(F.col(f"{d}_load") + 1e-20) + 7.5 - F.col("most")).cast("int")
        k = F.when(lts.isin(1, 2), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(7), v)))
        out = out.withColumn(f"{d}_class", k).withColumn(f"{d}_priority", F.when(k > 4, k).otherwise(0) + F.when(lts.isin(1, 2), lts).otherwise(0))
    return out.withColumn("vis_priority", F.greatest("fwd_priority", "bwd_priority")).drop("most")


def thread_links(candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) of candidates (tr_id, start_node, end_node, priority) that continue each other.

    They meet at a node with exactly two candidate ends and have equal priority.
    """
    ends = candidates.select("tr_id", "priority", F.explode(F.array("start_node", "end_node")).alias("node"))
    two = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("tr_id").alias("a"), F.max("tr_id").alias("b"), F.min("priority").alias("lo"), F.max("priority").alias("hi"))
    return two.filter("n = 2 and a <> b and lo = hi").select("a", "b").distinct()


def cell_baseline(cells: DataFrame) -> DataFrame:
    """One row (total): population times mean by cell, over cells that have both."""
    ok = (F.col("pop") != 0) & (F.col("mean") != 0)
    return cells.agg(F.sum(F.when(ok, F.col("pop") * F.col("mean"))).alias("total"))


def gain_curve(scores: DataFrame, partition: str | None = None) -> DataFrame:
    """``scores`` (thread, len_m, gain) in order of gain by metre: running length and gain, and both as shares."""
    w = W.partitionBy(*([partition] if partition else [])).orderBy(F.desc(F.col("gain") / F.col("len_m")), "thread").rowsBetween(W.unboundedPreceding, 0)
    out = scores.withColumns({"sum_len": F.sum("len_m").over(w), "sum_gain": F.sum("gain").over(w)})
    whole = W.partitionBy(*([partition] if partition else []))
    return out.withColumns({"share_len": F.col("sum_len") / F.sum("len_m").over(whole), "share_gain": F.col("sum_gain") / F.sum("gain").over(whole)})


def tiers(scores: DataFrame, by: str, len_col: str, partition: str) -> DataFrame:
    """Priority 7 for the first 10 % of the length in order of score, 6 up to 30 %, else 5; the crossing thread counts to the lower share."""
    w = W.partitionBy(partition).orderBy(F.desc(by), "thread")
    before = F.coalesce(F.sum(len_col).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(len_col).over(W.partitionBy(partition))
    return scores.withColumn("tier", F.when(before <= 0.1 * total, 7).when(before <= 0.3 * total, 6).otherwise(5))


def what_if(base: DataFrame, scenarios: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``base`` for each scenario (scenario, key): rows named by the scenario have ``column`` replaced by ``value``.

    Only rows that a scenario changes are repeated for it; join the rest of ``base`` once.
    """
    return scenarios.join(base, key).withColumn(column, value)
