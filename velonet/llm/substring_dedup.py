"""Operator 2, substring dedup: difference-cover anchors.

A perfect difference cover D modulo a period v holds, for any two offsets, one shift after which both fall on D. So when a
document repeats ``window`` words of another, one run of window - v + 1 words starts at a covered position in both: an
anchor. Only anchors are exchanged; where an anchor is shared by two different texts, the windows around it are extended
to their full length and matched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Perfect difference sets: period -> residues (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover_positions(n: int, period: int) -> np.ndarray:
    """Positions below n whose residue lies in the cover."""
    if n <= 0:
        return np.empty(0, np.int64)
    base = np.arange(0, n, period, dtype=np.int64)[:, None] + np.array(COVERS[period], np.int64)
    flat = base.ravel()
    return flat[flat < n]


def pick_period(window: int) -> int:
    """The longest period that leaves anchors of at least two fifths of the window."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= 2 * window / 5 - 1)


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct positions as (start, length) of runs."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    start = np.r_[0, cut]
    return at[start], np.diff(np.r_[start, len(at)])


def _anchor_rows(window: int, period: int):
    """Documents -> (k, t, doc, pos): anchor hash, hash of the whole word sequence, document, position.

    Within a batch, an anchor that stands in two texts is already known to be shared: its rows come out as settled
    (k spread by document and place, t = 0) and only two rows go to its group as evidence (pos = -1). So the rows of a very
    common passage that meet in one task are two for each batch, however many documents hold it.
    """
    size = window - period + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = common.WordHashes()
        for batch in common.chunks(batches, "raw", 12_000_000):
            ks, ts, ds, ps = [], [], [], []
            for doc, raw in zip(batch["doc_id"].to_numpy(), batch["raw"], strict=True):
                words = raw.split()
                if len(words) < window:
                    continue
                h = hashes.of(words)
                at = cover_positions(len(h) - size + 1, period)
                k = common.window_hashes(h, size)[at]
                ks.append(k)
                ts.append(np.full(len(k), common.window_hashes(h, len(h))[0] | np.uint64(1), np.uint64))
                ds.append(np.full(len(k), doc, np.int64))
                ps.append(at)
            if not ks:
                continue
            k, t, d, p = np.concatenate(ks), np.concatenate(ts), np.concatenate(ds), np.concatenate(ps)
            order = np.lexsort((t, k))
            k, t = k[order], t[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            last = np.r_[first[1:], len(k)] - 1
            shared = t[first] != t[last]
            evidence = np.sort(order[np.r_[first[shared], last[shared]]])
            # back to document order, in which neighbouring rows compress well
            settled = np.empty(len(k), bool)
            settled[order] = np.repeat(shared, last - first + 1)
            k, t, d, p = np.concatenate(ks), np.concatenate(ts), np.concatenate(ds), np.concatenate(ps)
            known = common.mix(d[settled].astype(np.uint64) * np.uint64(common.BASES[0]) + p[settled].astype(np.uint64))
            yield pd.DataFrame({
                "k": np.r_[k[~settled], known, k[evidence]].view(np.int64),
                "t": np.r_[t[~settled], np.zeros(len(known), np.uint64), t[evidence]].view(np.int64),
                "doc": np.r_[d[~settled], d[settled], d[evidence]],
                "pos": np.r_[p[~settled], p[settled], np.full(len(evidence), -1)].astype(np.int32),
            })

    return run


def _shared_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (k, t) -> (doc, pos) of settled anchors and of anchors that stand in two texts.

    A group is held back only while all its rows are of one text, which one document and its exact copies share; after a
    limit such rows are passed on as if shared, which costs their windows a comparison and changes no result.
    """
    limit = 200_000
    k, t, d, p = (np.empty(0, x) for x in (np.int64, np.int64, np.int64, np.int32))
    open_key = None  # its group is known to be shared, or was passed on

    def out(d, p):
        own = p >= 0
        if own.any():
            yield pd.DataFrame({"doc": d[own], "pos": p[own]})

    def close(k, t, d, p):
        if not len(k):
            return
        settled = t == 0
        yield from out(d[settled], p[settled])
        k, t, d, p = k[~settled], t[~settled], d[~settled], p[~settled]
        if not len(k):
            return
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[first, len(k)])
        low, high = np.minimum.reduceat(t, first), np.maximum.reduceat(t, first)
        yield from out(*(x[np.repeat((low != high) | (k[first] == (open_key if open_key is not None else k[first] + 1)), size)] for x in (d, p)))

    for batch in batches:
        if not len(batch):
            continue
        k, t, d, p = np.r_[k, batch["k"].to_numpy()], np.r_[t, batch["t"].to_numpy()], np.r_[d, batch["doc"].to_numpy()], np.r_[p, batch["pos"].to_numpy()]
        last = int(np.searchsorted(k, k[-1], "left"))
        if last:
            yield from close(k[:last], t[:last], d[:last], p[:last])
            if open_key is not None and k[last] != open_key:
                open_key = None
            k, t, d, p = k[last:], t[last:], d[last:], p[last:]
        if len(k) > limit:
            if open_key != k[0]:
                open_key = k[0]
            yield from close(k, t, d, p)
            k, t, d, p = k[:0], t[:0], d[:0], p[:0]
    yield from close(k, t, d, p)


def _window_rows(window: int, period: int):
    """Documents with their shared anchors -> (a, b, doc, pos, len, more): candidate windows to match, and settled runs.

    Of equal windows in one batch all but those of the smallest document are removed at once: they come out as settled
    runs (a spread by document and place, len > 0); the rest go to their group with len 0. Hashes have 96 bits.
    """
    reach = period - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = common.WordHashes()
        for batch in common.chunks(batches, "raw", 6_000_000):
            a_, b_, d_, p_ = [], [], [], []
            for doc, raw, at in zip(batch["doc_id"].to_numpy(), batch["raw"], batch["at"], strict=True):
                h = hashes.of(raw.split())
                n = len(h) - window + 1
                if n <= 0:
                    continue
                edge = np.zeros(n + 1, np.int32)
                at = np.minimum(np.asarray(at, np.int64), n - 1 + reach)
                np.add.at(edge, np.maximum(at - reach, 0), 1)
                np.add.at(edge, np.minimum(at + 1, n), -1)
                start = np.flatnonzero(np.cumsum(edge[:n]))
                if len(start):
                    a_.append(common.window_hashes(h, window, common.BASES[0], start))
                    b_.append((common.window_hashes(h, window, common.BASES[1], start) >> np.uint64(32)).astype(np.uint32))
                    d_.append(np.full(len(start), doc, np.int64))
                    p_.append(start)
            if not a_:
                continue
            a, b, d, p = (np.concatenate(x) for x in (a_, b_, d_, p_))
            order = np.lexsort((p, d, b, a))
            a, b = a[order], b[order]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            low = np.empty(len(d), np.int64)
            low[order] = d[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
            a, b = np.concatenate(a_), np.concatenate(b_)
            gone = d > low
            # of equal windows of one document only the first is a row, which holds the places of the others
            held = order[~gone[order]]
            again = np.zeros(len(held), bool)
            again[1:] = (a[held][1:] == a[held][:-1]) & (b[held][1:] == b[held][:-1]) & (d[held][1:] == d[held][:-1])
            more = np.full(len(d), None, object)
            first = np.flatnonzero(~again)
            for i, n in zip(first.tolist(), np.diff(np.r_[first, len(held)]).tolist(), strict=True) if again.any() else ():
                if n > 1:
                    more[held[i]] = p[held[i + 1 : i + n]].astype(np.int32)
            keep = np.sort(held[first])
            yield pd.DataFrame({"a": a[keep].view(np.int64), "b": b[keep].view(np.int32), "doc": d[keep], "pos": p[keep].astype(np.int32), "len": np.zeros(len(keep), np.int32), "more": more[keep]})
            if gone.any():
                d, p = d[gone], p[gone]
                order = np.lexsort((p, d))
                d, p = d[order], p[order]
                cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
                yield pd.DataFrame({"a": common.mix(d[cut].astype(np.uint64) * np.uint64(common.BASES[0]) + p[cut].astype(np.uint64)).view(np.int64), "b": np.zeros(len(cut), np.int32), "doc": d[cut], "pos": p[cut].astype(np.int32), "len": np.diff(np.r_[cut, len(d)]).astype(np.int32), "more": None})

    return run


def _later_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (a, b, doc) -> (doc, pos, len): settled runs, and windows whose group has a smaller document."""
    tail = None  # a, b and smallest document of the group that is still open
    for batch in batches:
        if not len(batch):
            continue
        a, b, d, p, n, more = (batch[c].to_numpy() for c in ("a", "b", "doc", "pos", "len", "more"))
        run = n > 0
        if run.any():
            yield pd.DataFrame({"doc": d[run], "pos": p[run], "len": n[run]})
            a, b, d, p, more = a[~run], b[~run], d[~run], p[~run], more[~run]
        if not len(a):
            continue
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        low = d[np.flatnonzero(first)]
        if tail is not None and tail[:2] == (a[0], b[0]):
            low[0] = tail[2]
        low = low[np.cumsum(first) - 1]
        tail = (a[-1], b[-1], low[-1])
        later = d > low
        if later.any():
            yield pd.DataFrame({"doc": d[later], "pos": p[later], "len": np.ones(int(later.sum()), np.int32)})
            for doc, places in zip(d[later].tolist(), more[later], strict=True):
                if places is not None:
                    yield pd.DataFrame({"doc": doc, "pos": np.asarray(places, np.int32), "len": np.ones(len(places), np.int32)})


def _digest(words: list[bytes]) -> tuple[bytes, str]:
    joined = b" ".join(words)
    return joined, hashlib.sha256(joined).hexdigest()


def _identity(words: list[bytes]) -> tuple[int, int]:
    """128-bit hash of a word sequence as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(b" ".join(words))
    a, b = np.array(divmod(h, 1 << 64), np.uint64).view(np.int64).tolist()
    return a, b


def _whole(texts: bool):
    """Documents -> their identity and what they are when nothing is removed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch["raw"]:
                words = raw.split()
                joined, digest = _digest(words)
                rows.append((*_identity(words), len(words), digest, joined.decode() if texts else None))
            out = pd.DataFrame(rows, columns=["t1", "t2", "n_words", "sha", "kept"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return run


def _kept(window: int, texts: bool):
    """Documents with runs of repeated windows -> identity, words removed, and what is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.chunks(batches, "raw", 12_000_000):
            rows = []
            for raw, at, runs in zip(batch["raw"], batch["runs_at"], batch["runs"], strict=True):
                words = raw.split()
                n = len(words)
                edge = np.zeros(n + 1, np.int64)
                at, runs = np.asarray(at, np.int64), np.asarray(runs, np.int64)
                np.add.at(edge, np.minimum(at, n), 1)
                np.add.at(edge, np.minimum(at + runs + window - 1, n), -1)
                left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                joined, digest = _digest(left)
                rows.append((*_identity(words), n - len(left), digest, joined.decode() if texts else None))
            out = pd.DataFrame(rows, columns=["t1", "t2", "gone", "cut_sha", "cut"])
            out.insert(0, "doc", batch["doc_id"].to_numpy())
            yield out

    return run


def dedup(docs: DataFrame, window: int = 50, texts: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256[, kept_text]), one for each row of ``docs`` (doc_id, text).

    Words are cut at ASCII white space. Each word under a window of ``window`` words that also starts in a document with
    a smaller doc_id is removed; windows are judged on the input. Null or empty texts, and texts shorter than the
    window, keep all their words. Rows with a null doc_id have no order: they keep all words and remove none. Repeated
    rows stay and get equal results; should one doc_id carry different texts, none of them is the smaller document, and
    word positions found repeated in one are removed from each. An empty table gives no rows; further columns are
    ignored.

    Only texts with a shared anchor cross the network, to meet their anchors; a filter of fixed size lets the others stay.
    """
    period = pick_period(window)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.raw_text().alias("raw"))
    named = rows.filter("doc_id is not null")
    anchors = named.mapInPandas(_anchor_rows(window, period), "k long, t long, doc long, pos int").repartition(n, "k").sortWithinPartitions("k")
    shared = common.materialize(anchors.mapInPandas(_shared_anchors, "doc long, pos int").groupBy("doc").agg(F.collect_list("pos").alias("at")))
    moved = common.flagged(named, F.col("doc_id"), shared, "doc", "_may").filter("_may")
    near = common.materialize(moved.join(shared.hint("shuffle_merge"), moved["doc_id"] == shared["doc"]).select("doc_id", "raw", "at"))
    cut = near.mapInPandas(_window_rows(window, period), "a long, b int, doc long, pos int, len int, more array<int>")
    cut = cut.repartition(n, "a", "b").sortWithinPartitions("a", "b", "doc")
    gone = cut.mapInPandas(_later_windows, "doc long, pos int, len int").groupBy("doc").agg(F.collect_list("pos").alias("runs_at"), F.collect_list("len").alias("runs"))
    parted = near.join(gone.hint("shuffle_merge"), near["doc_id"] == gone["doc"]).select("doc_id", "raw", "runs_at", "runs")
    parted = parted.mapInPandas(_kept(window, texts), "doc long, t1 long, t2 long, gone long, cut_sha string, cut string").distinct()
    whole = common.materialize(rows.mapInPandas(_whole(texts), "doc_id long, t1 long, t2 long, n_words long, sha string, kept string"))
    least = whole.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"))
    found = whole.join(least, ["t1", "t2"]).join(parted, (F.col("doc_id") == F.col("doc")) & (whole["t1"] == parted["t1"]) & (whole["t2"] == parted["t2"]), "left")
    copy = F.coalesce((F.col("least") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False))
    out = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    return found.select(*out, *([F.when(copy, "").otherwise(F.coalesce("cut", "kept")).alias("kept_text")] if texts else []))
