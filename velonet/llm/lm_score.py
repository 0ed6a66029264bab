"""Operator 10, LM scoring: cross-entropy difference of matched target and background bigram models.

Both models share one vocabulary, order and smoothing; the single-word part of the larger side is scaled down to the smaller
side's tokens (the bigram part is a ratio, which scaling leaves as it is), so neither is the smoother one for its size alone.
Every word and every bigram of both corpora is counted; the counts are distributed tables that grow with the corpora. Where
the scored texts are the background, each is left out of the background's counts when it is scored.

The HOT_WORDS most frequent words have numbers, known to every task. Texts are indexed in blocks: a block's distinct bigrams of
two hot words are pairs of numbers, packed by bucket of the pair, and its texts' entries are packed lists in the same order.
The pairs go to their buckets, meet there, and come back with their counts in both corpora; so of a bigram, however common, a
bucket gets one entry for each block. Bigrams with another word are rows that meet at that word, where its count is joined.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Bits of a hot word's number; words with numbers, at most (number 0 is what stands before the first word of a text).
ID_BITS = 20
HOT_WORDS = (1 << ID_BITS) - 1
#: Share of the bigram estimate in the interpolated model.
SHARE = 0.5
UNKNOWN, BEGIN = 0, 1
#: Distinct words a task counts before it hands them on.
MOST_COUNTED = 500_000
#: Both counts of a word that is not hot travel in one number, the target's above these bits. A word with more counts would
#: have 2**20 words ahead of it with as many: that takes 2**51 tokens.
SIDE_BITS = 31
#: Bytes of text in a block. Tokens for each bucket of pairs; more buckets than MOST_BUCKETS would leave a block's payloads
#: a few pairs each, so beyond about 40 billion tokens buckets grow instead.
BLOCK_BYTES, BUCKET_TOKENS, MOST_BUCKETS = 4_000_000, 1 << 21, 20_000
#: What a text's count adds to.
ROLES = {"t": 1, "b": 2, "d": 4}
#: Payloads that are not of a bucket: the ids of a block's texts, its entries, its bigrams with a word that is not hot.
NAMES, ENTRIES, RARE = -3, -2, -1
#: A text is known by its block and its place there, in one number: bits of the place, of the block's place in its partition.
TEXT_BITS, BLOCK_BITS = 19, 24


def _hash(words: list[bytes]) -> np.ndarray:
    """63-bit hashes."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) >> 1 for w in words), np.int64, len(words))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each as compressed planes of bytes of the least width that holds it."""
    out = []
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or int(a.max(initial=0)) < 1 << 8 * w)
        planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
        data = zstandard.compress(planes, 1)
        out.append(struct.pack("<BII", width, len(a), len(data)) + data)
    return b"".join(out)


def _unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        width, n, size = struct.unpack_from("<BII", raw, at)
        at += 9
        planes = np.frombuffer(zstandard.decompress(raw[at : at + size]) if n else b"", np.uint8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += size
    return out


def _texts(target: DataFrame, background: DataFrame) -> DataFrame:
    side = lambda df, t: df.select(F.lit(t).alias("target"), common.raw_text().alias("raw"))
    return side(target, True).union(side(background, False))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def rows(side: bool) -> pd.DataFrame:
        n = list(seen[side].values())
        out = pd.DataFrame({"word": _hash(list(seen[side])), "t": n if side else [0] * len(n), "b": [0] * len(n) if side else n})
        seen[side].clear()
        return out

    for batch in batches:
        for side, raw in zip(batch["target"].tolist(), batch["raw"], strict=True):
            seen[side].update(raw.split())
            if len(seen[side]) > MOST_COUNTED:
                yield rows(side)
    for side in seen:
        if seen[side]:
            yield rows(side)


def _packed_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"words": [_pack(*(batch[c].to_numpy() for c in ("word", "t", "b")))]})


def _least_count(counted: DataFrame) -> float:
    """The count above which words are hot: as low as HOT_WORDS allow, in steps of a 32nd power of 2."""
    step = F.ceil(F.log2(F.col("t") + F.col("b")) * 32).cast("int")
    seen = sorted(((r["step"], r["n"]) for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, float("inf")
    for s, n in seen:
        total += n
        if total > HOT_WORDS:
            break
        least = 2.0 ** ((s - 1) / 32)
    return least


@dataclass(frozen=True)
class Models:
    """Both corpora, the table (word, t, b) of all words' counts, the hot words, and the corpora's sizes.

    ``tokens``, ``texts`` are those of target and background; ``hot`` holds the hashes of the hot words in order, the
    number of each, and both counts by number; ``least`` is the count above which words are hot. The properties bring whole models to the driver, for a look at small ones;
    scoring does without them.
    """

    target: DataFrame
    background: DataFrame
    counted: DataFrame
    n_words: int
    tokens: tuple[int, int]
    texts: tuple[int, int]
    hot: Broadcast
    least: float

    @cached_property
    def _table(self) -> pd.DataFrame:
        return self.counted.toPandas().sort_values("word", ignore_index=True)

    @property
    def words(self) -> dict[bytes | None, int]:
        """The target's words (None: the begin of a text) and their places in the other properties."""
        place = {h: i + 2 for i, h in enumerate(self._table["word"].tolist())}
        own = sorted({w for r in self.target.select(common.raw_text().alias("raw")).collect() for w in bytes(r["raw"]).split()})
        return {None: BEGIN} | {w: place[h] for w, h in zip(own, _hash(own).tolist(), strict=True)}

    @property
    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.r_[0.0, float(n), self._table[c].to_numpy(np.float64)] for c, n in zip("tb", self.texts, strict=True))

    @property
    def single(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple((one * self.scale(side) + 0.5) / self.mass(side) for side, one in enumerate(self.unigrams))

    def scale(self, side: int) -> float:
        """What brings the counts of a side down to the smaller side's tokens."""
        return (min(self.tokens) or 1) / self.tokens[side] if self.tokens[side] else 1.0

    def mass(self, side: int) -> float:
        """Scaled tokens of a side, and a half for each word and for unknown ones."""
        return self.tokens[side] * self.scale(side) + 0.5 * (self.n_words + 1)


def train(target: DataFrame, background: DataFrame) -> Models:
    """Count all words of both corpora (column ``text``). Hot words and a few sums are all that comes to the driver."""
    texts = _texts(target, background)
    counted = texts.mapInPandas(_count_words, "word long, t long, b long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    counted = common.materialize(counted)
    none = lambda c: F.coalesce(c, F.lit(0))
    n, t, b, most = counted.agg(F.count(F.lit(1)), none(F.sum("t")), none(F.sum("b")), none(F.max(F.greatest("t", "b")))).first()
    sizes = tuple(df.count() for df in (target, background))
    least = _least_count(counted)
    if most >> SIDE_BITS:  # by far the most words have less; only those that are not hot must
        rare = counted.filter(F.col("t") + F.col("b") <= least).agg(none(F.max(F.greatest("t", "b")))).first()[0]
        if rare >> SIDE_BITS:
            raise OverflowError(f"a word that is not hot has {rare} counts, more than {SIDE_BITS} bits hold")
    hot = counted.filter(F.col("t") + F.col("b") > least).mapInPandas(_packed_words, "words binary")
    got = [_unpack(bytes(r["words"])) for r in hot.collect()]
    word, t_, b_ = (np.concatenate([np.empty(0, np.int64), *[g[i] for g in got]]) for i in range(3))
    order = np.lexsort((word, -t_ - b_))
    word, counts = word[order], np.vstack([np.array(sizes, np.int64), np.stack([t_, b_], 1)[order]])
    at = np.argsort(word, kind="stable")
    return Models(target, background, counted, n, (t, b), sizes, target.sparkSession.sparkContext.broadcast((word[at], (at + 1).astype(np.int32), counts)), least)


class _Codes(dict):
    """word -> its number, or -1 less its hash if it is not hot; with a bounded memory."""

    def __init__(self, known: np.ndarray, number: np.ndarray) -> None:
        self.known, self.number = known, number

    def __missing__(self, word: bytes) -> int:
        if len(self) >= common.CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 7) >> 1
        at = int(np.searchsorted(self.known, h))
        code = self[word] = int(self.number[at]) if at < len(self.known) and self.known[at] == h else -1 - h
        return code


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, the last one first in rank, and where in it groups of equal keys begin."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _indexed(models: Models, texts: DataFrame, roles: str, buckets: int, leave_out: bool) -> DataFrame:
    """Texts (doc, none, raw) -> payloads (block, bucket, role, payload).

    For each bucket the block's distinct pairs and how often each occurs; with the role d also NAMES (ids, and whether there
    is none) and ENTRIES (for each pair, in
    order of bucket and pair, the texts that have it, how often, and with ``leave_out`` how often they have its two
    words); and RARE, the same for bigrams with a word that is not hot.
    """
    sent, role, told = models.hot, sum(ROLES[r] for r in roles), "d" in roles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, number, _ = sent.value
        codes = _Codes(known, number)
        block = TaskContext.get().partitionId() << BLOCK_BITS
        for batch in (b.iloc[i : i + (1 << TEXT_BITS)] for b in common.chunks(batches, "raw", BLOCK_BYTES) for i in range(0, len(b), 1 << TEXT_BITS)):
            begin, each = np.zeros(1, np.int64), []
            for raw in batch["raw"]:
                words = raw.split()
                each += [begin, np.fromiter(map(codes.__getitem__, words), np.int64, len(words))]
            size = np.array([len(w) + 1 for w in each[1::2]])
            x = np.concatenate(each)
            text = np.repeat(np.arange(len(size)), size)
            own = np.zeros(len(x), np.int64)
            if leave_out:
                order, first = _groups(x, text)
                n = np.diff(np.r_[first, len(x)])
                own[order] = np.repeat(n, n)
            now = np.flatnonzero(text[1:] == text[:-1]) + 1
            a, b, tx = x[now - 1], x[now], text[now] if told else np.zeros(len(now), np.int64)
            tokens = size - 1
            block += 1
            out: list[tuple[int, bytes]] = [(NAMES, _pack(*_halves(batch["doc"].to_numpy(np.int64)), batch["none"].to_numpy()))] if told else []
            hot = (a >= 0) & (b >= 0)
            pair, at, t = a[hot] << ID_BITS | b[hot], now[hot], tx[hot]
            bucket = (common.mix(pair.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order, first = _groups(t, bucket << 2 * ID_BITS | pair)
            n = np.diff(np.r_[first, len(order)])
            first = order[first]
            pair, bucket, t, at = pair[first], bucket[first], t[first], at[first]
            new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (bucket[1:] != bucket[:-1])]) if len(pair) else first
            if told and len(pair):
                out.append((ENTRIES, _pack(tokens, np.diff(np.r_[new, len(pair)]), t, n, own[at - 1], own[at])))
            if len(pair):
                total = np.add.reduceat(n, new)
                pair, bucket = pair[new], bucket[new]
                cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(pair)]
                for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    out.append((int(bucket[i]), _pack(np.diff(pair[i:j], prepend=0), total[i:j])))
            if not hot.all():
                a, b, at, t = a[~hot], b[~hot], now[~hot], tx[~hot]
                order, first = _groups(b, a, t)
                n = np.diff(np.r_[first, len(order)])
                first = order[first]
                a, b, at, t = a[first], b[first], at[first], t[first]
                out.append((RARE, _pack(tokens, t, np.maximum(a, 0), np.maximum(-1 - a, 0), a < 0, np.maximum(b, 0), np.maximum(-1 - b, 0), b < 0, n, own[at - 1], own[at])))
            if out:
                yield pd.DataFrame({"block": block, "bucket": [k for k, _ in out], "role": role, "payload": [p for _, p in out]})

    return texts.mapInPandas(run, "block long, bucket int, role int, payload binary")


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper and the lower 32 bits."""
    return x.view(np.uint64) >> np.uint64(32), x & 0xFFFFFFFF


def _places(block: int, t: np.ndarray) -> np.ndarray:
    """The numbers that texts of a block are known by."""
    return block << TEXT_BITS | t


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Payloads of names -> (at, doc, none) of each text."""
    for batch in batches:
        for block, payload in zip(batch["block"].tolist(), batch["payload"], strict=True):
            high, low, none = _unpack(payload)
            yield pd.DataFrame({"at": _places(block, np.arange(len(low))), "doc": high << 32 | low, "none": none > 0})


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Payloads of pairs, sorted by bucket -> for each block to be scored its pairs with their counts in both corpora."""

    def close(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        got = [_unpack(p) for *_, p in rows]
        key = np.concatenate([np.cumsum(g[0]) for g in got])
        size = [len(g[0]) for g in got]
        role = np.repeat([r for _, _, r, _ in rows], size)
        n = np.concatenate([g[1] for g in got])
        every, place = np.unique(key, return_inverse=True)
        t, b = (np.bincount(place, n * (role & r > 0), len(every)).astype(np.int64)[place] for r in (ROLES["t"], ROLES["b"]))
        end = np.cumsum(size)
        out = [(block, bucket, _pack(g[0], t[e - len(g[0]) : e], b[e - len(g[0]) : e])) for (block, bucket, r, _), g, e in zip(rows, got, end.tolist(), strict=True) if r & ROLES["d"]]
        if out:
            yield pd.DataFrame(out, columns=["block", "bucket", "payload"])

    rows: list[tuple] = []
    for batch in batches:
        for x in zip(batch["block"].tolist(), batch["bucket"].tolist(), batch["role"].tolist(), batch["payload"], strict=True):
            if rows and rows[-1][1] != x[1]:
                yield from close(rows)
                rows = []
            rows.append(x)
    if rows:
        yield from close(rows)


def _bits(n: np.ndarray, first: np.ndarray, single: np.ndarray, scale: float, mass: np.ndarray | float) -> np.ndarray:
    """Bits of a bigram's second word: from its count, the counts of both words, and the side's mass."""
    return -np.log2(SHARE * n / np.maximum(first, 1) + (1 - SHARE) * (single * scale + 0.5) / mass)


def _lost(models: Models, leave_out: bool):
    """A block's entries and the counts of its pairs, sorted by block and bucket -> (at, n, t, b): the texts' bits."""
    sent, scale, mass = models.hot, [models.scale(s) for s in (0, 1)], [models.mass(s) for s in (0, 1)]

    def close(block: int, entries: bytes, totals: list[bytes]) -> pd.DataFrame:
        counts = sent.value[2]
        tokens, m, t, n, o1, o2 = _unpack(entries)
        got = [_unpack(p) for p in totals]
        pair = np.repeat(np.concatenate([np.cumsum(g[0]) for g in got]), m)
        both = [np.repeat(np.concatenate([g[1 + s] for g in got]), m) for s in (0, 1)]
        one, two = counts[pair >> ID_BITS], counts[pair & ((1 << ID_BITS) - 1)]
        less = n if leave_out else 0
        bits = (
            _bits(both[0], one[:, 0], two[:, 0], scale[0], mass[0]),
            _bits(both[1] - less, one[:, 1] - o1, two[:, 1] - o2, scale[1], mass[1] - (tokens[t] * scale[1] if leave_out else 0)),
        )
        sums = [np.bincount(t, n * x, len(tokens)) for x in (1, *bits)]
        some = sums[0] > 0
        return pd.DataFrame({"at": _places(block, np.flatnonzero(some)), "n": sums[0][some].astype(np.int64), "t": sums[1][some], "b": sums[2][some]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, entries, totals = None, b"", []
        for batch in batches:
            for k, bucket, payload in zip(batch["block"].tolist(), batch["bucket"].tolist(), batch["payload"], strict=True):
                if k != block:
                    if entries:
                        yield close(block, entries, totals)
                    block, entries, totals = k, b"", []
                if bucket == ENTRIES:
                    entries = payload
                else:
                    totals.append(payload)
        if entries:
            yield close(block, entries, totals)

    return run


def _rare_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Payloads -> rows of bigrams with a word that is not hot: ``h`` that word (the first of two), ``other`` the other one's
    number or -1 less its hash, ``tag`` the role and whether h is the first word; small numbers travel two in one."""
    for batch in batches:
        for block, role, payload in zip(batch["block"].tolist(), batch["role"].tolist(), batch["payload"], strict=True):
            tokens, t, ia, ha, ra, ib, hb, rb, n, o1, o2 = _unpack(payload)
            ra, rb = ra > 0, rb > 0
            told = bool(role & ROLES["d"])
            yield pd.DataFrame({
                "h": np.where(ra, ha, hb), "other": np.where(ra, np.where(rb, -1 - hb, ib), ia), "c": np.zeros(len(n), np.int64), "at": _places(block, t) if told else 0,
                "tag": role << 1 | ra, "meta": n << 32 | o1, "more": o2 << 32 | (tokens[t] if told else 0),
            })


def _rare_bits(models: Models, leave_out: bool):
    """Rows with the counts ``u`` of h, ``c`` of a hidden other, and t, b of the bigram -> (at, n, t, b)."""
    sent, scale, mass = models.hot, [models.scale(s) for s in (0, 1)], [models.mass(s) for s in (0, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, low = sent.value[2], (1 << 32) - 1
        for batch in batches:
            if not len(batch):
                continue
            x = {c: batch[c].to_numpy(np.int64) for c in batch.columns}
            ahead, n, o1, o2, tokens = (x["tag"] & 1) > 0, x["meta"] >> 32, x["meta"] & low, x["more"] >> 32, x["more"] & low
            hot = counts[np.maximum(x["other"], 0)]
            bits = []
            for s in (0, 1):
                of = (lambda c: c >> SIDE_BITS) if s == 0 else (lambda c: c & ((1 << SIDE_BITS) - 1))
                own, other = of(x["u"]), np.where(x["other"] >= 0, hot[:, s], of(x["c"]))
                less = 1 if leave_out and s else 0
                bits.append(_bits(x["tb"[s]] - less * n, np.where(ahead, own, other) - less * o1, np.where(ahead, other, own) - less * o2, scale[s], mass[s] - less * tokens * scale[s]))
            at, place = np.unique(x["at"], return_inverse=True)
            sums = [np.bincount(place, n * y, len(at)) for y in (1, *bits)]
            yield pd.DataFrame({"at": at, "n": sums[0].astype(np.int64), "t": sums[1], "b": sums[2]})

    return run


def _rare_lost(models: Models, payloads: DataFrame, leave_out: bool) -> DataFrame:
    """(at, n, t, b) of the bigrams with a word that is not hot: they meet at it, where its count is joined."""
    rows = payloads.mapInPandas(_rare_rows, "h long, other long, c long, at long, tag byte, meta long, more long")
    words = models.counted.filter(F.col("t") + F.col("b") <= models.least).select(F.col("word"), (F.shiftleft("t", SIDE_BITS) + F.col("b")).alias("u"))
    two = rows.filter("other < 0").join(words, -1 - F.col("other") == F.col("word"), "left").select("h", "other", F.coalesce("u", F.lit(0)).alias("c"), "at", "tag", "meta", "more")
    every = rows.filter("other >= 0").union(two).join(words, F.col("h") == F.col("word"), "left").withColumn("u", F.coalesce("u", F.lit(0)))
    same = W.partitionBy("h", "other", F.col("tag").bitwiseAND(F.lit(1).cast("byte")))
    has = lambda r: F.col("tag").cast("int").bitwiseAND(F.lit(ROLES[r] << 1)) > 0
    count = lambda r: F.sum(F.when(has(r), F.shiftright("meta", 32)).otherwise(0)).over(same)
    found = every.withColumns({"t": count("t"), "b": count("b")}).filter(has("d"))
    return found.select("other", "c", "u", "t", "b", "at", "tag", "meta", "more").mapInPandas(_rare_bits(models, leave_out), "at long, n long, t double, b double")


def score(docs: DataFrame, models: Models, leave_out: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, loss_target, loss_background, score), one for each row of ``docs``.

    Losses are bits per token and ``score`` is target less background: the lower, the more a text is like the target.
    With ``leave_out``, ``docs`` are to have the rows of the models' background: a text's own counts are taken off the
    background's when it is scored (another row with the same text stays in). Null and empty texts have no tokens, losses and score 0; null ids and
    repeated rows are scored like others; words of equal counts have numbers in order of their hashes, which no score
    depends on; an empty table gives no rows; further columns are ignored. Texts stay where they are; a long
    one is a block of its own, whose words a task holds.
    """
    doc, none = F.col("doc_id").cast("long"), F.lit(0).cast("long")
    told = docs.select(F.coalesce(doc, none).alias("doc"), doc.isNull().alias("none"), common.raw_text().alias("raw"))
    plain = lambda df: df.select(none.alias("doc"), F.lit(True).alias("none"), common.raw_text().alias("raw"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(parts, sum(models.tokens) // BUCKET_TOKENS))
    index = _indexed(models, plain(models.target), "t", buckets, False)
    if leave_out:
        index = index.union(_indexed(models, told, "bd", buckets, True))
    else:
        index = index.union(_indexed(models, plain(models.background), "b", buckets, False)).union(_indexed(models, told, "d", buckets, False))
    # totals must meet the very entries they were made from, so the index is written once
    index = common.materialize(index)
    dealt = index.filter("bucket >= 0").repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    totals = dealt.mapInPandas(_totals, "block long, bucket int, payload binary")
    met = index.filter(F.col("bucket") == ENTRIES).select("block", "bucket", "payload").union(totals)
    lost = met.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInPandas(_lost(models, leave_out), "at long, n long, t double, b double")
    lost = lost.union(_rare_lost(models, index.filter(F.col("bucket") == RARE).select("block", "role", "payload"), leave_out))
    lost = lost.groupBy("at").agg(F.sum("n").cast("long").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    names = index.filter(F.col("bucket") == NAMES).select("block", "payload").mapInPandas(_named, "at long, doc long, none boolean")
    per = lambda c: F.coalesce(F.col(c) / F.col("n_tokens"), F.lit(0.0))
    out = names.join(lost, "at", "left").select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), F.coalesce("n_tokens", none).alias("n_tokens"), per("t").alias("loss_target"), per("b").alias("loss_background"))
    return out.select("*", (F.col("loss_target") - F.col("loss_background")).alias("score"))


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Score ``docs`` by models of ``target`` and of ``docs`` themselves as background, each text left out of it in turn."""
    return score(docs, train(target, docs), leave_out=True)
