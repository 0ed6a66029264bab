"""Statistics of whole texts that the quality operators share, computed on bytes in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters that count as symbols, and how long a repeated window is (fixed values).
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "upper", "digit", "punct", "symbol", "dup_lines", "repeated", "distinct", "top_word", "adjacent", "line_words", "log_words", "caps_words")
SCHEMA = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RATIOS)])


def _classes() -> np.ndarray:
    """256 x 5: upper case, digit, ASCII punctuation, symbol, continuation byte."""
    out = np.zeros((256, 5), np.int64)
    out[65:91, 0] = 1
    out[48:58, 1] = 1
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        out[a:b, 2] = 1
    out[list(SYMBOLS), 3] = 1
    out[128:192, 4] = 1
    return out


CLASSES = _classes()


def repeated_words(h: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words under any run of ``width`` words that the text has twice or more."""
    w = common.window_hashes(h, width)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
    edge = np.zeros(len(h) + 1, np.int64)
    hit = np.flatnonzero(twice[at] == w)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def of_text(raw: bytes, hashes: common.WordHashes) -> tuple:
    """(*COUNTS, *RATIOS) of one text; ratios are 0 where there is nothing to divide by."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(RATIOS)
    upper, digit, punct, symbol, tail = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES).tolist()
    chars = sum(map(len, words)) - tail
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    h = hashes.of(words)
    s = np.sort(h)
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    rep = repeated_words(h)
    caps = sum(map(bytes.isupper, words))
    return (
        n, chars, symbol, dup, rep,
        chars / n, upper / chars, digit / chars, punct / chars, symbol / n, dup / len(lines), rep / n, (len(cut) - 1) / n, int(np.diff(cut).max()) / n,
        float(np.count_nonzero(h[1:] == h[:-1])) / n, n / len(lines), float(np.log1p(n)), caps / n,
    )


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), then: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str = SCHEMA) -> DataFrame:
    """``carry`` and the statistics of each row's whole text (null: empty), or what ``then`` makes of them in the same pass."""
    fields = dict((f.name, f.dataType.simpleString()) for f in docs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = common.WordHashes()
        for batch in common.chunks(batches, "raw"):
            got = pd.DataFrame([of_text(raw, hashes) for raw in batch["raw"]], columns=[*COUNTS, *RATIOS])
            for i, c in enumerate(carry):
                got.insert(i, c, batch[c].reset_index(drop=True))
            yield then(got) if then else got

    common.small_batches(docs)
    source = docs.select(*carry, common.raw_text().alias("raw"))
    return source.mapInPandas(run, ", ".join(f"`{c}` {fields[c]}" for c in carry) + ", " + schema)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the rows that may train: one for each id, 1 where its labels differ; held-out ids never enter."""
    rows = labels.filter("doc_id is not null and quality in (0, 1)").filter(~common.held_out())
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))


def sample(docs: DataFrame, labels: DataFrame, most: int) -> pd.DataFrame:
    """Statistics and ``quality`` of at most ``most`` labelled documents, those whose id hashes lowest.

    One row for each id, however many rows of ``docs`` share it (of different texts the one with the least statistics).
    The ids are the only thing that is broadcast, and ``most`` bounds them.
    """
    ids = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    one = measured(rows, ("doc_id", "quality")).groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS, *RATIOS)).alias("m"))
    return one.select("doc_id", "quality", "m.*").toPandas().sort_values("doc_id").reset_index(drop=True)
