"""Operator 11, spelling variants: a sharded positional gram index with a count filter finds words one edit apart.

The index is dealt out in shards. A shard holds the words that agree everywhere but in one part of the word, half of it at
first: of two words one edit apart one half is untouched, so they meet in a shard. Within a shard the grams of the part
that may differ are indexed with their positions; a word's postings, under the length and position limits, are merged by
heap, candidates below the overlap that one edit leaves are dropped, and the rest are verified. A shard of more than
``most`` words is cut anew: the part that may differ is halved until the shard is small or a single code point is left,
so frequent beginnings and endings never gather many words in one place.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of the grams.
GRAM = 2
#: Letters of words: A-Z, a-z, U+00C0 to U+00FF. Latin-1 has a byte for each; the table lower-cases A-Z, blanks the rest.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))


def runs(text: str | None) -> Counter:
    """The lower-cased letter runs of a text, in Latin-1, with their numbers."""
    # characters beyond Latin-1 turn into ?, which is no letter
    return Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split())


def altered(prefix: int, run: bytes, every: int) -> bytes:
    """The run without one code point if ``every`` divides the hash of document and run; ``prefix`` is the hash so far."""
    h = zlib.crc32(run.decode("latin-1").encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """Words (word, n) of at least ``shortest`` code points that occur ``least`` times or more in all texts.

    Words are runs of the letters A-Z, a-z, U+00C0 to U+00FF, A-Z lower-cased; where ``every`` divides the crc32 of
    ``<doc_id>:<run>``, the run has lost a code point (0: none has). Null and empty texts hold none; a null id counts as
    empty; repeated rows count each time; long texts take the memory of their words once; an empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.chunks(batches, "text"):
            total: Counter = Counter()
            for name, text in zip(batch["doc_id"], batch["text"], strict=True):
                prefix = zlib.crc32(f"{name}:".encode())
                for run, n in runs(text).items():
                    if len(run) >= shortest:
                        word = altered(prefix, run, every) if every else run
                        if len(word) >= shortest:
                            total[word] += n
            if total:
                yield pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())}, columns=["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keyed(parts: DataFrame) -> DataFrame:
    """With ``key``: what lies outside of the part from ``s`` to ``e``; the longer word's part is one code point longer."""
    ends = F.col("e") + F.col("longer").cast("int")
    outside = F.xxhash64("short", "s", "e", F.substring("word", F.lit(1), F.col("s")), F.substring(F.col("word"), ends + 1, F.length("word")))
    return parts.withColumn("key", outside)


def _halves(parts: DataFrame) -> DataFrame:
    """Each part as its two halves; a part of one code point stays."""
    mid = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
    piece = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    both = F.when(F.col("e") - F.col("s") > 1, F.array(piece(F.col("s"), mid), piece(mid, F.col("e")))).otherwise(F.array(piece(F.col("s"), F.col("e"))))
    return parts.withColumn("p", F.explode(both)).withColumns({"s": F.col("p.s"), "e": F.col("p.e")}).drop("p")


def _shards(words: DataFrame, shortest: int, most: int) -> Iterator[DataFrame]:
    """Shards (short, s, e, words of that length, words one longer), level by level; the last levels are all small."""
    n = F.length("word")
    sides = F.array(F.struct(F.lit(False).alias("longer"), n.alias("short")), F.struct(F.lit(True).alias("longer"), (n - 1).alias("short")))
    parts = words.select("word", "n", F.explode(sides).alias("side")).select("word", "n", "side.longer", "side.short", F.lit(0).alias("s"), F.col("side.short").alias("e")).filter(F.col("short") >= shortest)
    while True:
        parts = _keyed(_halves(parts))
        # a part of one code point bounds the shard: letters of the alphabet, and pairs of letters
        large = common.materialize(parts.filter("e - s > 1").groupBy("key").count().filter(F.col("count") > most).select("key"))
        some = not large.isEmpty()
        member = F.struct("word", "n")
        small = (parts.join(large, "key", "left_anti") if some else parts).groupBy("key", "short", "s", "e").agg(
            F.collect_list(F.when(~F.col("longer"), member)).alias("equal"), F.collect_list(F.when(F.col("longer"), member)).alias("longer")
        )
        yield small.filter((F.size("equal") > 0) & (F.size("equal") + F.size("longer") > 1)).drop("key")
        if not some:
            return
        parts = common.materialize(parts.join(large, "key", "left_semi").drop("key"))


def ends(a: str, b: str) -> tuple[int, int]:
    """Code points that two words share at their beginning, and at their end."""
    m = min(len(a), len(b))
    head = 0
    while head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < m and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def first_part(short: int, s: int, e: int, tail: int) -> bool:
    """Whether of all parts that one halving after another would give, s to e is the first that holds the difference.

    The same two words meet in several shards where letters repeat. The halving that leads to s..e is followed from the
    whole word; at each cut the left half is taken whenever it holds the difference.
    """
    a, b = 0, short
    while (a, b) != (s, e):
        mid = (a + b) // 2
        right = s >= mid
        if right == (short - tail <= mid):
            return False
        a, b = (mid, b) if right else (a, mid)
    return True


def near_in_shard(short: int, s: int, e: int, equal: list[tuple[str, int]], longer: list[tuple[str, int]]) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Pairs of a shard's words one edit apart, each once over all shards; the first word has ``short`` code points.

    Postings (gram, position) -> places in ``equal``. A word as long meets the postings at its own positions, a longer one
    those at the same position and one before. Of the grams in the part that may differ, with a code point around it, one
    edit destroys GRAM at most.
    """
    at = max(s - 1, 0)
    part = lambda w, more: w[at : e + 1 + more]
    grams = lambda p: [p[i : i + GRAM] for i in range(len(p) - GRAM + 1)]
    index: dict[tuple[str, int], list[int]] = {}
    for k, (w, _) in enumerate(equal):
        for i, g in enumerate(grams(part(w, 0))):
            index.setdefault((g, i), []).append(k)
    for more, probes in ((0, equal), (1, longer)):
        for j, probe in enumerate(probes):
            found = grams(part(probe[0], more))
            bound = len(found) - GRAM
            if bound > 0:
                lists = [x for i, g in enumerate(found) for back in range(more + 1) if (x := index.get((g, i - back)))]
                candidates = [k for k, same in groupby(heapq.merge(*lists)) if sum(1 for _ in same) >= bound]
            else:
                candidates = list(range(len(equal)))
            for k in candidates:
                if not more and k >= j:
                    break
                head, tail = ends(equal[k][0], probe[0])
                if head + tail >= short - (not more) and equal[k][0] != probe[0] and first_part(short, s, e, tail):
                    yield equal[k], probe


def near_words(words: DataFrame, shortest: int = 7, most: int = 1000) -> DataFrame:
    """Rows (word, n, other, other_n): the ``words`` (word, n; each once) one inserted, deleted or replaced code point
    apart, both ways round."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for short, s, e, equal, longer in zip(batch["short"], batch["s"], batch["e"], batch["equal"], batch["longer"], strict=True):
                for a, b in near_in_shard(short, s, e, [(x["word"], x["n"]) for x in equal], [(x["word"], x["n"]) for x in longer]):
                    out += [(*a, *b), (*b, *a)]
            if out:
                yield pd.DataFrame(out, columns=["word", "n", "other", "other_n"])

    out = None
    for shards in _shards(words, shortest, most):
        found = shards.mapInPandas(pairs, "word string, n long, other string, other_n long")
        out = found if out is None else out.unionByName(found)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of ``forms`` (word, form): the word that the forms lead to in the end, by pointer doubling.

    A form's number is ten times the word's, so a chain is shorter than 20 and five rounds do.
    """
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.materialize(state.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return state


def least_of(n: Column, word: Column) -> Column:
    """Orders by the larger number, then by the smaller word."""
    return F.struct((-n).alias("less"), word.alias("word"))


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31, times: int = 10, most: int = 1000) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): one for each word of ``vocabulary``.

    ``form``: of the words one edit apart the most frequent one, of equal ones the smallest in code-point order, if it is
    ``times`` times as frequent as the word; else null. ``root``: where the forms lead. Ties, null and empty texts, null
    ids, repeated rows, empty tables and long texts: see ``vocabulary``; other columns are ignored.
    """
    words = common.materialize(vocabulary(docs, shortest, least, every))
    near = near_words(words, shortest, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(least_of(F.col("other_n"), F.col("other"))).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    met = common.materialize(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    )
    return met.join(roots(met.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
