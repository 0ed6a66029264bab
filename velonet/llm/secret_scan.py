"""Operator 12, secret scans: patterns for known forms, and a battery of randomness tests for strings of any form.

One pass over the texts finds the base spans and every long run of token characters. The alphabet of a run is inferred, and
three tests ask whether it could be drawn evenly from it: chi-squared counts, runs about the middle, serial correlation;
Fisher's rule joins their p-values. A random string passes a level p with probability 1 - p whatever its length, while
ordinary text passes the less often the longer it is. So the level is set for each alphabet and length by control of false
discoveries: for each run, decoys of the same length and alphabet are cut from the same text's plain characters, and the
level is taken at which their share tells that no more than the rate allowed of what passes is ordinary.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Base kinds in their order.
KINDS = ("assign", "access", "hex", "random")
KEYS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(={0,2})")
#: Alphabets from small to large; the first that holds a run is its encoding. Runs of digits alone have none.
UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
ALPHABETS = {
    "hex": DIGITS + LOWER[:6], "upper_hex": DIGITS + UPPER[:6], "base32": UPPER + DIGITS[2:8], "lower36": DIGITS + LOWER, "upper36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + b"+/", "url64": UPPER + LOWER + DIGITS + b"-_", "any": UPPER + LOWER + DIGITS + b"+/-_",
}
CONTINUATION = bytes(range(0x80, 0xC0))
#: Levels of p that control of false discoveries chooses from.
LEVELS = 50
#: Decoys of a run: with more of them, fewer runs suffice to show that ordinary strings rarely pass.
DECOYS = 8
SPANS = "array<struct<kind:string,start:long,end:long>>"


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(x: list[int], k: int) -> float:
    """p of Pearson's statistic against even use of k symbols. Its mean and variance are exact for any length."""
    n, counts = len(x), [0] * k
    for i in x:
        counts[i] += 1
    stat = k / n * sum(c * c for c in counts) - n
    # a scaled chi-squared variable with the same two moments, its cube root taken as normal
    scale = (n - 1) / n
    df = (k - 1) / scale
    return upper_normal(((max(stat, 1e-9) / scale / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def runs_test(x: list[int], k: int) -> float:
    """p of the number of runs below and above the middle of the alphabet; 0 if all lie on one side."""
    above = [2 * i >= k for i in x]
    n, a = len(x), sum(above)
    if a in (0, n):
        return 0.0
    r = 1 + sum(p != q for p, q in zip(above, above[1:], strict=False))
    mean = 2 * a * (n - a) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return two_sided((r - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(x: list[int], k: int) -> float:
    """p of the correlation of neighbours, about the mean and variance of an even draw."""
    m, v, n = (k - 1) / 2, (k * k - 1) / 12, len(x)
    return two_sided(sum((p - m) * (q - m) for p, q in zip(x, x[1:], strict=False)) / v / math.sqrt(n - 1))


def battery(run: bytes, alphabet: bytes) -> float:
    """Fisher's joint p of the three tests: near 0 for ordinary text, even between 0 and 1 for random strings."""
    at = {c: i for i, c in enumerate(alphabet)}
    x, k = [at[c] for c in run], len(alphabet)
    half = -sum(math.log(max(p, 1e-300)) for p in (chi_squared(x, k), runs_test(x, k), serial(x, k)))
    return math.exp(-half) * (1 + half + half * half / 2)


def encoding(run: bytes) -> str | None:
    """The smallest alphabet that holds the run; None for digits alone."""
    left = run.translate(None, DIGITS)
    if not left:
        return None
    return next(name for name, alphabet in ALPHABETS.items() if not run.translate(None, alphabet))


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """Base spans as byte offsets, by start, then kind."""
    low, out = text.lower(), []
    if any(k in low for k in KEYS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: bytes, taken: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int, str, float]], list[tuple[str, int, float]]]:
    """Runs clear of the spans ``taken`` as (start, end, encoding, p), and their decoys as (encoding, length, p).

    A run's decoys are the next DECOYS pieces of its length of the text's other characters in the same alphabet, as far as
    they go; an alphabet of one case takes letters of both.
    """
    spans, found = [], []
    starts, reach = [s for _, s, _ in taken], list(accumulate((e for *_, e in taken), max))
    for m in RUN.finditer(text):
        start, end = m.start(), m.start(1)
        spans.append((start, end))
        name = encoding(text[start:end])
        k = bisect_left(starts, m.end())
        if name and not (k and reach[k - 1] > start):
            found.append((start, m.end(), name, battery(text[start:end], ALPHABETS[name]), end - start))
    decoys, plain, pools, used = [], None, {}, {}
    for _, _, name, _, size in found:
        if plain is None:
            cuts = [0, *[x for s in spans for x in s], len(text)]
            plain = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
        if name not in pools:
            one_case = plain.upper() if ALPHABETS[name].isupper() else plain.lower() if ALPHABETS[name].islower() else plain
            pools[name] = one_case.translate(None, bytes(set(range(256)) - set(ALPHABETS[name])))
        for _ in range(DECOYS):
            a = used.get(name, 0)
            if len(pools[name]) >= a + size:
                decoys.append((name, size, battery(pools[name][a : a + size], ALPHABETS[name])))
                used[name] = a + size
    return [f[:4] for f in found], decoys


def positions(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offsets -> code points before them, in one pass."""
    out, at, n = {}, 0, 0
    for o in sorted(set(offsets)):
        n += len(text[at:o].translate(None, CONTINUATION))
        out[o], at = n, o
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, base, found, decoys) of ``docs`` (doc_id, text), one for each row: base spans in code points; runs with
    class and level; classes and levels of their decoys. A class is an alphabet and a length in steps of a half power of 2."""
    size = lambda n: int(2 * math.log2(n))
    level = lambda p: min(int(p * LEVELS), LEVELS - 1)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.chunks(batches, "text"):
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                base = base_spans(text)
                found, decoys = candidates(text, base)
                at = positions(text, [x for _, s, e in base for x in (s, e)] + [x for f in found for x in f[:2]])
                rows.append((
                    doc_id, [(k, at[s], at[e]) for k, s, e in base],
                    [(at[s], at[e], f"{name}-{size(len(text[s:e].rstrip(b'=')))}", level(p)) for s, e, name, p in found],
                    [(f"{name}-{size(n)}", level(p)) for name, n, p in decoys],
                ))
            yield pd.DataFrame(rows, columns=["doc_id", "base", "found", "decoys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.raw_text().alias("text"))
    return rows.mapInPandas(find, f"doc_id long, base {SPANS}, found array<struct<start:long,end:long,class:string,level:int>>, decoys array<struct<class:string,level:int>>")


def levels(scanned: DataFrame, rate: float = 0.05) -> DataFrame:
    """Rows (class, level): the lowest level of each class at which the share of decoys keeps within ``rate``.

    Of n runs and d decoys of a class, r and q reach a level. What passes holds an expected n * (q + 1) / (d + 1) ordinary
    strings at most, which must be ``rate`` * r or less. A class of a few runs cannot show that and has no level.
    """
    seen = lambda c: scanned.select(F.explode(c).alias("x")).groupBy("x.class", "x.level").count()
    counts = seen("found").select("class", "level", F.col("count").alias("n"), F.lit(0).cast("long").alias("d"))
    counts = counts.union(seen("decoys").select("class", "level", F.lit(0).cast("long"), "count")).groupBy("class", "level").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    up, all_of = W.partitionBy("class").orderBy(F.desc("level")), W.partitionBy("class")
    r, q, n, d = F.sum("n").over(up), F.sum("d").over(up), F.sum("n").over(all_of), F.sum("d").over(all_of)
    return counts.withColumn("fine", n * (q + 1) / (d + 1) <= rate * r).filter("fine").groupBy("class").agg(F.min("level").alias("level"))


def secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Rows (doc_id, spans), one for each row of ``docs`` (doc_id, text): base spans, and random strings clear of them.

    Spans (kind, start, end) lie by start, then kind; code points, end exclusive. Null and empty texts have none; repeated
    rows and null ids are scanned like others; ties of start keep the order of KINDS; an empty table gives no rows; a long
    text is scanned whole, at the memory of one copy of it for each alphabet that its runs use; other columns are ignored.
    """
    seen = common.materialize(scan(docs))
    # a few hundred classes at most: nine alphabets, half powers of two
    least = F.create_map(*[F.lit(x) for r in levels(seen, rate).collect() for x in (r["class"], r["level"])]).cast("map<string,int>")
    random = F.transform(F.filter("found", lambda f: f["level"] >= least[f["class"]]), lambda f: F.struct(F.lit("random").alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    order = lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]))
    by_start = lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)
    return seen.select("doc_id", F.array_sort(F.concat("base", random), by_start).alias("spans"))


def report(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans) from ``secrets``; odd rows as there."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return secrets(docs, rate).select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
