"""Shared pieces of the training-data operators: words, rolling hashes, lineage cuts, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet.session import checkpoint_folder

#: Words are runs of bytes other than space and tab..carriage return; bytes.split() cuts exactly there.
WORD = r"[^\x20\x09-\x0D]+"
#: Odd multipliers of the polynomial window hashes modulo 2**64 (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Distinct words whose hash a Python worker remembers before it starts afresh.
CACHE_WORDS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with checkpoint() in the folder that spark.checkpoint.dir names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame, most: int = 4_000_000) -> None:
    """Let Arrow batches of this session hold at most so many bytes: a worker holds a batch, its pandas form and results."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(df.sparkSession.conf.get(key)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        df.sparkSession.conf.set(key, str(most))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the id's text is divisible by 5: such rows never train a model."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def fresh(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores ahead as tell it from the columns taken, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def raw_text(col: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


class WordHashes(dict):
    """word -> 64-bit hash, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: np.ndarray, width: int, base: int = BASES[0], at: np.ndarray | None = None) -> np.ndarray:
    """Hash of every run of ``width`` words (or of those that start at ``at``): sum of words[i+k] * base**(width-1-k)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if at is not None and len(at) * 8 < n:
        p = powers(base, width)[::-1]
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out += words[at + k] * p[k]
        return mix(out)
    # binary build-up: hashes of runs of 1, 2, 4, ... words, joined for the set bits of width
    run, length, out, have = words, 1, None, 0
    pw = 1
    left = width
    while left:
        if left & 1:
            if out is None:
                out, have = run[: len(words) - length + 1], length
            else:
                m = len(words) - have - length + 1
                out = out[:m] * np.uint64(pow(base, length, 1 << 64)) + run[have : have + m]
                have += length
        left >>= 1
        if left:
            m = len(words) - 2 * length + 1
            run = run[:m] * np.uint64(pow(base, length, 1 << 64)) + run[length : length + m]
            length *= 2
    out = mix(out[:n])
    return out if at is None else out[at]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def chunks(batches: Iterator[pd.DataFrame], column: str, most_bytes: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into pieces of bounded text volume; a single longer text is a piece of its own."""
    for batch in batches:
        if not len(batch):
            continue
        size = batch[column].map(len).to_numpy().cumsum()
        start = 0
        while start < len(batch):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most_bytes, "right")))
            yield batch.iloc[start:end]
            start = end


#: Bits of the filter that tells which documents can be left where they are: 2 MB, whatever the size of the corpus.
FILTER_BITS = 24


def _place(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(1 << FILTER_BITS))


def flagged(rows: DataFrame, doc: Column, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """``rows`` with a column ``flag``: whether the document may be among ``ids``; false alarms only grow with the ids.

    The bits are set by bitmap aggregates, 4 kB for each 32,768 places, so the table of them that is broadcast has at most
    512 rows and 2 MB.
    """
    place, k, held = _place(F.col(column)), fresh("bucket", rows.columns), fresh("bits", rows.columns)
    bits = ids.groupBy(F.bitmap_bucket_number(place).alias(k)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(held))
    at = F.bitmap_bit_position(_place(doc))
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(_place(doc)) == F.col(k), "left")
    byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(k, held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root), root the smallest node reached.

    Alternating star contraction: each round is a few shuffles over the remaining edges, and the number of rounds grows
    with the logarithm of the longest chain. Minima are pre-aggregated before their shuffle, so a hub is no hot key;
    joins back on a hub are split by adaptive skew handling. Lineage is cut by a checkpoint each round.
    """
    und = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        # large star: neighbours above a node move to the smallest node around it
        both = und(e)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below a node, and the node, move to the smallest of them
        down = large.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = materialize(small.filter("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
