"""Operator 5, benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

The CGK embedding walks through a word sequence: at step j it writes the current word and moves on or stays by a random
bit of (j, word). Sequences a few word edits apart fall into step again, so edit distance becomes Hamming distance, and
keys made of a few sampled steps collide for near windows with good probability. Every word of every document starts a
window; an item gives keys from several of its sections, so that edits in one do not hide the others. A colliding window
of the item's size is then verified by exact edit distance.

A short item leaves a walk too few words to fall into step. It is cut into one piece more than the edits it tolerates
instead: an edit spoils one piece at most, so one is in the text word for word, and none of its places is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits tolerated, as a share of an item's words; items of fewer words than WALKED are sought by pieces, not by walks.
RATE, WALKED = 0.2, 20
#: Walks, keys of each, steps sampled for a key, steps of a walk, sections of an item.
WALKS, KEYS, SAMPLES, STEPS, SECTIONS, SEED = 2, 5, 4, 20, 4, 17
#: What one pass over the documents carries to the tasks, at most; a larger benchmark takes several passes.
MOST_ITEMS, MOST_BYTES = 20_000, 32_000_000
#: Words embedded in one go, to stay in cache.
SLICE = 1 << 15
MARKS = b"\"'`.,;:!?()[]{}<>*_-"


class Folded(common.WordHashes):
    """word -> hash of the word in lower case without marks around it (of the word itself if nothing is left)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= common.CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.lower().strip(MARKS) or word, 7) or 1
        return h


def _draw() -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """For every walk and step the (key, coefficient) pairs that sample it; the walks' seeds."""
    rng = np.random.default_rng(SEED)
    plan = [[[] for _ in range(STEPS)] for _ in range(WALKS)]
    for w in range(WALKS):
        for k in range(KEYS):
            for j in rng.choice(STEPS, SAMPLES, replace=False).tolist():
                plan[w][j].append((w * KEYS + k, int(rng.integers(1, 1 << 63)) * 2 + 1))
    return plan, rng.integers(1, 1 << 63, WALKS).astype(np.uint64)


PLAN, SEEDS = _draw()


def keys_of(h: np.ndarray, n: int) -> np.ndarray:
    """(WALKS * KEYS, n) keys of the windows that start at words 0..n-1 of h, which must go on for STEPS beyond n."""
    out = np.zeros((WALKS * KEYS, n), np.uint64)
    for w in range(WALKS):
        bits = common.mix(h ^ SEEDS[w])
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            part, walk = h[a : b + STEPS], bits[a : b + STEPS]
            at = np.arange(b - a)
            for j in range(STEPS):
                if PLAN[w][j]:
                    x = part[at]
                    for k, c in PLAN[w][j]:
                        out[k, a:b] += x * np.uint64(c)
                at += ((walk[at] >> np.uint64(j)) & np.uint64(1)).view(np.int64)
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn ``item`` into some run of ``text``: (edits, start, end) of the first such run that ends."""
    m = len(text)
    col = np.arange(m + 1)
    row, start = np.zeros(m + 1, np.int64), col.copy()
    # start positions ride along: costs are scaled so that among equal costs the later start, the shorter run, wins
    scale = np.int64(m + 2)
    cost = row * scale - start
    for w in item:
        change = np.r_[np.int64(1 << 40), cost[:-1] + scale * (text != w)]
        best = np.minimum(change, cost + scale)
        cost = np.minimum.accumulate(best - scale * col) + scale * col
    k = int(np.argmin(-(-cost // scale)))
    edits = int(-(-cost[k] // scale))
    return edits, int(edits * scale - cost[k]), k


@dataclass(frozen=True)
class Index:
    """Items and their keys, sorted; ``gate`` tells by a key's upper bits whether to look it up at all.

    ``pieces`` holds keys, owners and offsets of the short items' pieces by their width, with a gate for each.
    """

    ids: np.ndarray
    words: list[np.ndarray]
    sets: list[frozenset[int]]
    keys: list[np.ndarray]
    owner: list[np.ndarray]
    offset: list[np.ndarray]
    gate: np.ndarray
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


GATE_BITS = 20


def _ordered(keys: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], owner[order], offset[order]


def _pieces(i: int, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(width, key, item, offset) of each piece of a short item."""
    n = int(RATE * len(h)) + 1
    edges = [len(h) * k // n for k in range(n + 1)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield b - a, int(common.window_hashes(h[a:b], b - a)[0]), i, a


def build(items: pd.DataFrame) -> Index:
    hashes = Folded()
    ids, words = [], []
    for item, raw in zip(items["item_id"], items["raw"], strict=True):
        h = hashes.of(raw.split())
        if len(h):
            ids.append(item)
            words.append(h)
    keys: list[list[int]] = [[] for _ in range(WALKS * KEYS)]
    owner: list[int] = []
    offset: list[int] = []
    short: list[tuple[int, int, int, int]] = []
    for i, h in enumerate(words):
        if len(h) < WALKED:
            short += _pieces(i, h)
            continue
        last = max(0, len(h) - STEPS // 2 - 2)
        for at in sorted({round(last * s / max(1, SECTIONS - 1)) for s in range(SECTIONS)}):
            got = keys_of(np.r_[h[at:], np.zeros(STEPS + 1, np.uint64)], 1)[:, 0].tolist()
            for k, x in enumerate(got):
                keys[k].append(x)
            owner.append(i)
            offset.append(at)
    own, off = np.array(owner, np.int64), np.array(offset, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gate = np.zeros(1 << GATE_BITS, bool)
    for k in keys:
        a = common.mix(np.array(k, np.uint64))
        out.append(_ordered(a, own, off))
        gate[a >> np.uint64(64 - GATE_BITS)] = True
    pieces = {}
    for width in sorted({x[0] for x in short}):
        mine = [x[1:] for x in short if x[0] == width]
        found = _ordered(np.array([x[0] for x in mine], np.uint64), np.array([x[1] for x in mine]), np.array([x[2] for x in mine]))
        own_gate = np.zeros(1 << GATE_BITS, bool)
        own_gate[found[0] >> np.uint64(64 - GATE_BITS)] = True
        pieces[width] = (*found, own_gate)
    return Index(np.array(ids, np.int64), words, [frozenset(h.tolist()) for h in words], [x[0] for x in out], [x[1] for x in out], [x[2] for x in out], gate, pieces)


def search(index: Index, h: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Matches in documents laid end to end: (row, item, first word, last word + 1, edits), the best place of each pair.

    ``start`` and ``size`` give every document's words in h; between documents lie at least STEPS + 1 zeros.
    """
    tables = []
    if len(index.keys[0]):
        keys = keys_of(h, len(h) - STEPS - 1)
        tables = [(common.mix(keys[k]), index.keys[k], index.owner[k], index.offset[k], index.gate) for k in range(WALKS * KEYS)]
    tables += [(common.window_hashes(h, width), *table) for width, table in index.pieces.items()]
    seen: dict[tuple[int, int], list] = {}
    tried: set[tuple[int, int, int]] = set()
    for a, known, owner, offset, gate in tables:
        at = np.flatnonzero(gate[a >> np.uint64(64 - GATE_BITS)])
        lo, hi = np.searchsorted(known, a[at], "left"), np.searchsorted(known, a[at], "right")
        hit = hi > lo
        for p, x, y in zip(at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True):
            row = int(np.searchsorted(start, p, "right")) - 1
            if p >= start[row] + size[row]:
                continue
            for i, off in zip(owner[x:y].tolist(), offset[x:y].tolist(), strict=True):
                begin = p - int(start[row]) - off
                if (row, i, begin) in tried:
                    continue
                tried.add((row, i, begin))
                item = index.words[i]
                most = int(RATE * len(item))
                best = seen.get((row, i))
                if best is not None and best[2] == 0:
                    continue
                slack = 2 * most + 1
                a0, a1 = max(0, begin - slack), min(int(size[row]), begin + len(item) + slack)
                if a1 - a0 < len(item) - most:
                    continue
                text = h[start[row] + a0 : start[row] + a1]
                # every different word of the item that the place lacks is an edit
                if len(index.sets[i].difference(text.tolist())) > most:
                    continue
                edits, s, e = edit_distance(item, text)
                if edits <= most and (best is None or (edits, a0 + s) < (best[2], best[0])):
                    seen[row, i] = [a0 + s, a0 + e, edits]
    for (row, i), (s, e, edits) in sorted(seen.items()):
        yield row, int(index.ids[i]), s, e, edits


def _blocks(spark, benchmark: DataFrame) -> Iterator[pd.DataFrame]:
    """The benchmark in blocks of bounded size, each collected by itself."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), common.raw_text().alias("raw"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()
    parts = max(1, -(-n // MOST_ITEMS), -(-size // MOST_BYTES))
    for part in range(parts if n else 0):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("raw", "item_id"), F.lit(parts)) == part)
        yield mine.orderBy("item_id", "raw").toPandas()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, first_word, end_word, edits): items found in each row of ``docs`` within RATE of their words.

    Words are compared in lower case without marks around them. One row for each document row and item, its place of
    fewest edits; a document without a find has no row. Null and empty texts have no finds; null ids and repeated rows
    are searched like others; items that are null or without words find nothing; empty tables give no rows;
    further columns are ignored. No shuffle: the index of a block of items, of bounded size, goes to the tasks.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.raw_text().alias("raw"))
    schema = "doc_id long, item_id long, first_word long, end_word long, edits int"
    out = None
    for block in _blocks(spark, benchmark):
        index = build(block)
        if not len(index.ids):
            continue
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            hashes = Folded()
            index = sent.value
            pad = np.zeros(STEPS + 1, np.uint64)
            for batch in common.chunks(batches, "raw", 3_000_000):
                parts, start, size, n = [], [], [], 0
                for raw in batch["raw"]:
                    h = hashes.of(raw.split())
                    start.append(n)
                    size.append(len(h))
                    parts += [h, pad]
                    n += len(h) + len(pad)
                found = list(search(index, np.concatenate(parts), np.array(start), np.array(size)))
                if found:
                    rows, items, s, e, d = zip(*found, strict=True)
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[list(rows)].astype("Int64").to_numpy(dtype=object), "item_id": items, "first_word": s, "end_word": e, "edits": d}).astype({"doc_id": "Int64", "edits": "int32"})

        got = source.mapInPandas(run, schema)
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], schema)


def _free(sent):
    """Vectorised function: texts -> whether no item of the broadcast index is found in them."""

    @F.pandas_udf("boolean")
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = Folded()
        pad = np.zeros(STEPS + 1, np.uint64)
        for batch in batches:
            verdict = np.ones(len(batch), bool)
            at = 0
            for piece in common.chunks(iter([batch.to_frame("raw")]), "raw", 3_000_000):
                parts = [x for raw in piece["raw"] for x in (hashes.of(raw.split()), pad)]
                size = np.array([len(x) for x in parts[::2]])
                start = np.cumsum(np.r_[0, size[:-1] + len(pad)])
                for row, *_ in search(sent.value, np.concatenate(parts), start, size):
                    verdict[at + row] = False
                at += len(piece)
            yield pd.Series(verdict)

    return free


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are. Only texts pass through Python.

    Null and empty texts stay; null ids and repeated rows are searched like others; an empty table stays empty, an empty
    benchmark finds nothing.
    """
    common.small_batches(docs)
    out = docs
    for block in _blocks(docs.sparkSession, benchmark):
        index = build(block)
        if len(index.ids):
            out = out.filter(_free(docs.sparkSession.sparkContext.broadcast(index))(common.raw_text()))
    return out
