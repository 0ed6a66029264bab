"""Operator 8, quality rules: base rules, then an isolation forest on the rule statistics.

Documents that random splits isolate after few steps are anomalous. The forest is grown on a bounded sample of documents
labelled as good, and the cut is calibrated on all labelled rows so that at most MISS of the good ones would go. Rows that
held_out() sets aside take no part in either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text_stats

FEATURES = text_stats.RATIOS
#: Labelled rows that the forest is grown on, at most; the cut takes all of them.
MOST_ROWS = 20_000
TREES, SUBSAMPLE, SEED = 100, 256, 5
#: How far beyond the rows at a node a split may fall, in widths of their range, and the depth this adds.
MARGIN, DEEPER = 1.0, 10
MISS = 0.005
#: Base rules (fixed values): fewer words than this, or more than this share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20


@dataclass(frozen=True)
class Forest:
    """Arrays [tree, node]: feature (-1 at a leaf), threshold, left and right child, path length at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    length: np.ndarray
    unit: float
    cut: float


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray) -> Forest:
    rng = np.random.default_rng(SEED)
    size = min(SUBSAMPLE, len(x))
    limit = int(np.ceil(np.log2(max(size, 2)))) + DEEPER
    trees = []
    for _ in range(TREES):
        rows = x[rng.choice(len(x), size, replace=False)]
        spread = rows.max(axis=0) - rows.min(axis=0)
        spread[spread == 0] = 0.05
        nodes: list[list] = []

        def build(part: np.ndarray, depth: int, nodes=nodes, spread=spread) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + average_path(len(part))])
            if len(part) > 1 and depth < limit:
                f = int(rng.integers(part.shape[1]))
                lo, hi = part[:, f].min(), part[:, f].max()
                reach = MARGIN * ((hi - lo) or spread[f])
                # splits reach past the sample: what lies outside it meets an empty side early
                t = float(rng.uniform(lo - reach, hi + reach))
                right = part[:, f] > t
                nodes[at][0], nodes[at][1] = f, t
                nodes[at][2] = build(part[~right], depth + 1)
                nodes[at][3] = build(part[right], depth + 1)
            return at

        build(rows, 0)
        trees.append(nodes)
    most = max(map(len, trees))
    full = np.array([t + [[-1, 0.0, 0, 0, 0.0]] * (most - len(t)) for t in trees])
    return Forest(full[:, :, 0].astype(np.int64), full[:, :, 1], full[:, :, 2:4].astype(np.int64), full[:, :, 4], average_path(size) or 1.0, np.inf)


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path length / expected length): near 1 for rows that are isolated at once."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, child, length in zip(forest.feature, forest.threshold, forest.child, forest.length, strict=True):
        at = np.zeros(len(x), np.int64)
        open_ = rows
        while len(open_):
            f = feature[at[open_]]
            open_, f = open_[f >= 0], f[f >= 0]
            here = at[open_]
            at[open_] = child[here, (x[open_, f] > threshold[here]).astype(np.int64)]
        total += length[at]
    return 2.0 ** (-total / len(forest.feature) / forest.unit)


def failed(df: DataFrame | pd.DataFrame):
    """Whether the base rules reject a row of statistics."""
    return (df["n_words"] < LEAST_WORDS) | (100 * df["n_repeat_words"] > MOST_REPEATED_PERCENT * df["n_words"])


def ranked(rows: DataFrame, column: str, rank: int, bins: int = 4096, rounds: int = 4) -> float:
    """The value of a column of numbers from 0 to 1 that has ``rank`` rows below it: counts in ever finer bins, no sort."""
    low, width = 0.0, 1.0
    for _ in range(rounds):
        inside = rows.filter((F.col(column) >= low) & (F.col(column) < low + width) if low + width < 1 else F.col(column) >= low)
        place = F.least(F.floor((F.col(column) - low) / (width / bins)), F.lit(bins - 1)).cast("int")
        for k, n in sorted((r["k"], r["n"]) for r in inside.groupBy(place.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if rank < n:
                break
            rank -= n
        low, width = low + k * (width / bins), width / bins
    return rows.filter(F.col(column) >= low).agg(F.min(column)).first()[0]


def calibrate(seen: DataFrame) -> float:
    """The cut above which documents go, from labelled rows (quality, anomaly): the lowest that at most MISS of the good rows
    exceed; inf without good rows.

    From there it rises as long as no further bad row is let through, to the middle of the gap below the next one.
    """
    good, bad = seen.filter("quality = 1"), seen.filter("quality = 0")
    n = good.count()
    if not n:
        return float("inf")
    low = ranked(good, "anomaly", max(0, int(np.ceil(n * (1 - MISS))) - 1))
    above = bad.filter(F.col("anomaly") > low).agg(F.min("anomaly")).first()[0]
    if above is None:
        return low
    return (max(low, good.filter(F.col("anomaly") < above).agg(F.max("anomaly")).first()[0] or low) + above) / 2


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Forest | None:
    """Forest from a bounded sample of labelled rows, cut from all of them; None without rows labelled as good."""
    rows = text_stats.sample(docs, labels, most)
    good = rows[(rows["quality"] == 1) & ~failed(rows)]
    if not len(good):
        return None
    forest = grow(good[list(FEATURES)].to_numpy(np.float64))
    known = text_stats.labelled(labels)
    some = common.flagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.col("doc_id"), known, "doc_id", "_may").filter("_may")
    seen = judged(some, forest).filter("not base_failed").select("doc_id", "anomaly").join(known, "doc_id")
    return replace(forest, cut=calibrate(common.materialize(seen.select("quality", "anomaly"))))


def judged(docs: DataFrame, forest: Forest | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*carry, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept).

    One for each row of ``docs``. Null and empty texts have no words and fail the base rules; null ids and repeated rows
    are judged like others; without a forest (no labelled rows) the base rules decide; an empty table gives no rows. The
    forest is of fixed size and goes to the tasks with the function. No shuffle.
    """
    names = [*carry, *text_stats.COUNTS]

    def rate(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[names].copy()
        out["anomaly"] = anomaly(forest, rows[list(FEATURES)].to_numpy(np.float64)) if forest is not None else 0.0
        return out

    got = text_stats.measured(docs, carry, rate, ", ".join([*(f"{c} long" for c in text_stats.COUNTS), "anomaly double"]))
    cut = float(forest.cut) if forest is not None else float("inf")
    bad = failed(got)
    return got.select(*names, bad.alias("base_failed"), "anomaly", (~bad & (F.col("anomaly") <= F.lit(cut))).alias("kept"))


def filtered(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are. Only the texts pass through Python.

    Null and empty texts have no words and go; null ids and repeated rows are judged like others; an empty table stays empty.
    """

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = common.WordHashes()
        for batch in batches:
            rows = pd.DataFrame([text_stats.of_text(raw, hashes) for raw in batch], columns=[*text_stats.COUNTS, *text_stats.RATIOS])
            bad = failed(rows)
            if forest is not None:
                bad |= anomaly(forest, rows[list(FEATURES)].to_numpy(np.float64)) > forest.cut
            yield ~bad

    common.small_batches(docs)
    return docs.filter(keep(common.raw_text()))
