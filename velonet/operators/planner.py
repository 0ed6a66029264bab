"""Which upgrades to build first: what each thread gains alone, and cumulative curves of the gain in a few iterations.

Scenarios are a column. What each thread gains alone comes from one search over all scenarios (network.improved_paths), the
curve of an order from one search over all its prefixes (network.prefix_paths); the driver loops over iterations only. The
study counts in whole numbers, ratios in millionths, lengths in millimetres, so that sums are exact in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import network as N

#: Ranks in a block of running sums.
BLOCK = 4096


@dataclass(frozen=True)
class Study:
    """What stays the same between scenarios.

    ``origins`` and ``destinations`` have anchors (site_id, node, secs); ``cells`` (site_id, cell, pop) of the origins, pop
    whole; ``weights`` (site_id, w) of the destinations, w whole; times in seconds.
    """

    origins: DataFrame
    destinations: DataFrame
    cells: DataFrame
    weights: DataFrame
    min_s: float = 600.0
    max_s: float = 1800.0

    def trees(self, graph: DataFrame, whole: bool = True) -> DataFrame:
        """Trees (source, node, cost) from the destinations; unless ``whole``, the ways to the origins only."""
        sources = self.destinations.select(F.col("node").alias("source")).distinct()
        return N.settle(N.paths(graph, sources, self.max_s, None if whole else self.origins).select("source", "node", "cost"))

    def ways(self, tree: DataFrame, *keys: str) -> DataFrame:
        """(keys, o_id, d_id, secs) of all pairs of anchors that ``tree`` (keys, source, node, cost) joins."""
        d = self.destinations.select(F.col("site_id").alias("d_id"), F.col("node").alias("source"), F.col("secs").alias("d_s"))
        o = self.origins.select(F.col("site_id").alias("o_id"), "node", F.col("secs").alias("o_s"))
        met = tree.join(d, "source").join(o, "node")
        return met.groupBy(*keys, "o_id", "d_id").agg(F.min(F.col("o_s") + F.col("cost") + F.col("d_s")).alias("secs"))

    def share(self, secs: Column) -> tuple[Column, Column]:
        """(ratio times weight, weight) that a pair of ``free_s`` adds to its cell when its way takes ``secs``; else zeros."""
        counts = secs.isNotNull() & (secs < self.max_s)
        ratio = F.floor(1e6 * (secs / F.col("free_s") - 1)).cast("long")
        return F.when(counts, ratio * F.col("w")).otherwise(0), F.when(counts, F.col("w")).otherwise(0)


def worth(pop: Column, num: Column, den: Column) -> Column:
    """Population times mean ratio of a cell, in whole millionths; cells without trips count 0."""
    return F.when(den > 0, F.floor(pop * num / den)).otherwise(0).cast("long")


@dataclass(frozen=True)
class Baseline:
    """The study as it is: graph, trees, pairs (o_id, d_id, secs, free_s, w, cell) and cells (cell, pop, num, den)."""

    study: Study
    graph: DataFrame
    tree: DataFrame
    pairs: DataFrame
    cells: DataFrame

    def total(self) -> DataFrame:
        """One row (total): population times mean detour over all cells; the smaller, the better the network serves."""
        return self.cells.agg(F.sum(worth(F.col("pop"), F.col("num"), F.col("den"))).alias("total"))


def arcs_of(edges: DataFrame, forward: str, backward: str) -> DataFrame:
    return N.arcs(edges.select("start_node", "end_node", F.col(forward).alias("fwd_s"), F.col(backward).alias("bwd_s")), "min").withColumn("cost", F.col("cost").cast("double"))


def baseline(study: Study, edges: DataFrame) -> Baseline:
    """``edges`` (tr_id, start_node, end_node, work_fwd, work_bwd, super_fwd, super_bwd): seconds with and without stress."""
    graph = N.settle(arcs_of(edges, "work_fwd", "work_bwd"))
    tree = study.trees(graph)
    free = study.ways(study.trees(N.settle(arcs_of(edges, "super_fwd", "super_bwd")), whole=False)).withColumnRenamed("secs", "free_s")
    free = free.filter((F.col("free_s") > study.min_s) & (F.col("free_s") < study.max_s))
    rated = free.join(study.ways(tree), ["o_id", "d_id"], "left").join(study.weights.select(F.col("site_id").alias("d_id"), "w"), "d_id").join(study.cells.select(F.col("site_id").alias("o_id"), "cell"), "o_id")
    pairs = N.settle(rated.select("o_id", "d_id", "secs", "free_s", "w", "cell"))
    num, den = study.share(F.col("secs"))
    pop = study.cells.groupBy("cell").agg(F.sum("pop").alias("pop"))
    cells = pop.join(pairs.groupBy("cell").agg(F.sum(num).alias("num"), F.sum(den).alias("den")), "cell")
    return Baseline(study, graph, tree, pairs, N.settle(cells))


def changes(base: Baseline, edges: DataFrame, threads: DataFrame, key: str) -> DataFrame:
    """Arcs (key, src, dst, cost) that get cheaper when the ``threads`` (key, tr_id) are ridden without stress."""
    some = arcs_by(edges.join(threads.select(key, "tr_id"), "tr_id"), key)
    were = base.graph.withColumnRenamed("cost", "was")
    return N.settle(some.join(were, ["src", "dst"]).filter("cost < was").select(key, "src", "dst", "cost"))


def arcs_by(edges: DataFrame, key: str) -> DataFrame:
    f = edges.select(key, F.col("start_node").alias("src"), F.col("end_node").alias("dst"), F.col("super_fwd").alias("cost"))
    b = edges.select(key, F.col("end_node").alias("src"), F.col("start_node").alias("dst"), F.col("super_bwd").alias("cost"))
    return f.union(b).groupBy(key, "src", "dst").agg(F.min("cost").cast("double").alias("cost"))


def marginal_gains(base: Baseline, edges: DataFrame, threads: DataFrame) -> DataFrame:
    """Rows (thread, len_mm, gain, score) of ``threads`` (thread, tr_id, len_mm): what each gains when it is built alone."""
    length = threads.groupBy("thread").agg(F.sum("len_mm").alias("len_mm"))
    some = changes(base, edges, threads, "thread").withColumnRenamed("thread", "scenario")
    nearer = N.improved_paths(base.graph, base.tree, some, base.study.max_s)
    quicker = base.study.ways(nearer, "scenario").withColumnRenamed("secs", "new").join(base.pairs, ["o_id", "d_id"]).filter(F.col("secs").isNull() | (F.col("new") < F.col("secs")))
    (n1, d1), (n0, d0) = base.study.share(F.col("new")), base.study.share(F.col("secs"))
    moved = quicker.groupBy("scenario", "cell").agg(F.sum(n1 - n0).alias("dn"), F.sum(d1 - d0).alias("dd")).join(base.cells, "cell")
    pop, num, den = F.col("pop"), F.col("num"), F.col("den")
    gain = moved.groupBy(F.col("scenario").alias("thread")).agg(F.sum(worth(pop, num, den) - worth(pop, num + F.col("dn"), den + F.col("dd"))).alias("gain"))
    return length.join(gain, "thread", "left").withColumn("gain", F.coalesce("gain", F.lit(0)).cast("long")).withColumn("score", F.col("gain") / F.col("len_mm"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their ``rank`` in the order, from 1: sorted by ranges, then numbered range by range."""
    placed = N.settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each partition
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn("rank", F.col("_ahead") + within + 1).drop("_at", "_part", "_ahead")


def running(rows: DataFrame, **sums: str) -> DataFrame:
    """``rows`` (rank, ..) with running sums (name = column) by rank: within blocks of ranks, and of the blocks before."""
    rows = rows.withColumn("_block", F.floor(F.col("rank") / BLOCK))
    totals = rows.groupBy("_block").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row for each BLOCK ranks
    totals = totals.select("_block", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    within = W.partitionBy("_block").orderBy("rank")
    return rows.join(totals, "_block").withColumns({name: F.sum(c).over(within) + F.col(f"_{name}") for name, c in sums.items()}).drop("_block", *[f"_{name}" for name in sums])


def curve(base: Baseline, edges: DataFrame, threads: DataFrame, order: DataFrame) -> DataFrame:
    """Rows (rank, thread, len_mm, sum_mm, sum_gain, score): the threads built in the ``order`` (thread, rank, len_mm).

    ``score`` is what a thread adds to those before it, by length.
    """
    some = changes(base, edges, threads.join(order.select("thread", "rank"), "thread"), "rank")
    labels = N.prefix_paths(base.graph, base.tree, some, base.study.max_s).filter("rank > 0")
    later = base.study.ways(labels, "rank").join(base.pairs.drop("secs"), ["o_id", "d_id"])
    columns = ["o_id", "d_id", "free_s", "w", "cell", "rank", "secs"]
    steps = N.stepped(base.pairs.withColumn("rank", F.lit(0).cast("long")).filter("secs IS NOT NULL").select(columns).union(later.select(columns)), ["o_id", "d_id"], "secs")
    steps = steps.withColumn("was", F.lag("secs").over(W.partitionBy("o_id", "d_id").orderBy("rank"))).filter("rank > 0")
    (n1, d1), (n0, d0) = base.study.share(F.col("secs")), base.study.share(F.col("was"))
    moved = steps.groupBy("cell", "rank").agg(F.sum(n1 - n0).alias("dn"), F.sum(d1 - d0).alias("dd")).join(base.cells, "cell")
    upto = W.partitionBy("cell").orderBy("rank")
    num, den, pop = F.col("num") + F.sum("dn").over(upto), F.col("den") + F.sum("dd").over(upto), F.col("pop")
    moved = moved.select("rank", "dn", "dd", "pop", num.alias("num"), den.alias("den"))
    added = moved.groupBy("rank").agg(F.sum(worth(pop, F.col("num") - F.col("dn"), F.col("den") - F.col("dd")) - worth(pop, F.col("num"), F.col("den"))).alias("added"))
    rows = order.select("rank", "thread", "len_mm").join(added, "rank", "left").withColumn("added", F.coalesce("added", F.lit(0)).cast("long"))
    out = running(rows, sum_mm="len_mm", sum_gain="added")
    return out.select("rank", "thread", "len_mm", "sum_mm", "sum_gain", (F.col("added") / F.col("len_mm")).alias("score"))


def plan(base: Baseline, edges: DataFrame, threads: DataFrame, iterations: int = 3) -> DataFrame:
    """Rows (iteration, rank, thread, len_mm, sum_mm, sum_gain, score): the curves of each iteration.

    The first order is by what each thread gains alone, by length; the next ones by what a thread added to those before it.
    Of equal scores the smaller thread comes first. ``iterations`` counts the first evaluation, so there is one curve less.
    """
    scores, out = marginal_gains(base, edges, threads), None
    for k in range(1, iterations):
        order = N.settle(ranked(scores.select("thread", "len_mm", "score"), F.desc("score"), F.asc("thread")))
        scores = N.settle(curve(base, edges, threads, order))
        rows = scores.select(F.lit(k).alias("iteration"), "rank", "thread", "len_mm", "sum_mm", "sum_gain", "score")
        out = rows if out is None else out.union(rows)
    return out
