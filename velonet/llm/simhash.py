"""Operator 7, SimHash near-duplicates: deletion-variant signatures, equality-join, verification, components.

A fingerprint is cut into so few segments that of two near fingerprints one segment differs by at most one bit. Every
segment is indexed once for each of its bits with that bit struck out; two segments at most one bit apart share such a
variant. Rows are dealt by variant, compared inside it, and only links that join two parts not yet joined are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of one variant that are compared in one go; a larger variant is dealt out anew as pairs of blocks of this size.
BLOCK = 4096


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, a-z for A-Z, one space between; a shorter text is one run."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(start, end[width - 1 :].tolist(), strict=True)), np.uint64, len(start))


def majority_bits(h: np.ndarray) -> np.ndarray:
    """64 booleans, lowest bit first: set in over half the hashes."""
    if not len(h):
        return np.zeros(64, bool)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * total > len(h)


def _pack(bits: np.ndarray) -> np.uint64:
    return np.packbits(bits, bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, width: int = 4, parts: int = 1, sets: bool = False) -> DataFrame:
    """Rows (doc_id, f0[, f1 ...]): 64 fingerprint bits a column. Part 0 uses the XXH64 values, later parts remixed ones.

    With ``sets`` also t, a hash of the text, and size and sum of the set of its shingles' hashes: equal sets have both equal.
    """
    names = [f"f{i}" for i in range(parts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.chunks(batches, "raw"):
            out = np.zeros((len(batch), parts + 2 * sets), np.uint64)
            for i, raw in enumerate(batch["raw"]):
                h = shingle_hashes(raw, width)
                if len(h):
                    for k in range(parts):
                        out[i, k] = _pack(majority_bits(h if not k else common.mix(h + np.uint64((k * common.BASES[0]) & (2**64 - 1)))))
                    if sets:
                        h = np.unique(h)
                        out[i, parts:] = len(h), common.mix(h).sum(dtype=np.uint64)
            got = pd.DataFrame(out.view(np.int64), columns=[*names, *["size", "sum"][: 2 * sets]])
            if sets:
                got.insert(0, "t", batch["t"].to_numpy())
            got.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    common.small_batches(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.raw_text().alias("raw"), *([F.xxhash64(common.raw_text()).alias("t")] if sets else []))
    return source.mapInPandas(run, ", ".join(["doc_id long", *["t long"] * sets, *[f"{n} long" for n in names], *["size long", "sum long"][: 2 * sets]]))


def variant_masks(bits: int, segments: int, choose: int = 1) -> list[tuple[int, int]]:
    """(table, mask) of every variant: the union of ``choose`` of the segments, less one of its bits.

    At most 2*s - 1 differing bits leave one of s segments with at most one. With ``choose`` = t > 1 the t cleanest of s
    segments together differ by at most one bit as long as no more than s - t + 1 bits differ: more tables, each far
    more selective, for corpora whose variants would otherwise fill up.
    """
    edges = [bits * i // segments for i in range(segments + 1)]
    out = []
    for table, group in enumerate(combinations(range(segments), choose)):
        held = [b for g in group for b in range(edges[g], edges[g + 1])]
        whole = sum(1 << b for b in held)
        out += [(table, whole & ~(1 << b)) for b in held]
    return out


def plan(n: int, distance: int = 4) -> tuple[int, int]:
    """(segments, choose) for n fingerprints of 64 bits: all are complete; the bits in a key grow with n."""
    least = distance // 2 + 1
    for segments, choose, room in ((least, 1, 1 << 26), (distance + 1, 2, 1 << 31)):
        if n <= room:
            return segments, choose
    return distance + 2, 3


def _links(width: int, most: int, block: int, oversize: bool):
    """Partition function over rows (key, id, f0..) sorted by key: rows (a, b, key, blk, f0..).

    A verified link has a and b; a row of a variant with over ``block`` rows comes back with its id as a, b null, and its
    block's number, unless not ``oversize`` (its variants are bounded). Memory is bounded by one batch and one block.
    """
    names = [f"f{i}" for i in range(width)]

    def compare(ids: np.ndarray, keys: np.ndarray, f: np.ndarray) -> tuple[list, list]:
        n = len(keys)
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[new, n])
        end = np.repeat(new + size, size)
        parent = np.arange(n)
        a_out: list[int] = []
        b_out: list[int] = []
        active = np.flatnonzero(end - np.arange(n) > 1)
        lag = 1
        while len(active):
            left, right = active, active + lag
            apart = parent[left] != parent[right]
            left, right = left[apart], right[apart]
            differ = np.zeros(len(left), np.uint8)
            for k in range(width):
                differ += np.bitwise_count(f[left, k] ^ f[right, k])
            near = differ <= most
            hit = False
            for i, j in zip(left[near].tolist(), right[near].tolist(), strict=True):
                p, q = i, j
                while parent[p] != p:
                    p = parent[p]
                while parent[q] != q:
                    q = parent[q]
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a_out.append(i)
                    b_out.append(j)
                    hit = True
            while hit:
                up = parent[parent]
                hit = bool((up != parent).any())
                parent = up
            lag += 1
            active = active[end[active] - active > lag]
        return a_out, b_out

    def frame(a, b=None, key=None, blk=None, f=None) -> pd.DataFrame:
        n = len(a)
        out = {"a": a, "b": pd.array([None] * n if b is None else b, "Int64"), "key": np.zeros(n, np.int64) if key is None else key, "blk": np.zeros(n, np.int64) if blk is None else blk}
        for k, name in enumerate(names):
            out[name] = np.zeros(n, np.int64) if f is None else f[:, k].view(np.int64)
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ids, f = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.uint64)
        big, seen = None, 0

        def settle(keys, ids, f):
            a, b = compare(ids, keys, f)
            if a:
                yield frame(ids[a], ids[b])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.r_[keys, batch["key"].to_numpy(np.int64)]
            ids = np.r_[ids, batch["id"].to_numpy(np.int64)]
            f = np.vstack([f, np.ascontiguousarray(batch[names].to_numpy(np.int64)).view(np.uint64)])
            if big is not None:  # go on handing back the variant that proved too large
                n = int(np.searchsorted(keys, big, "right")) if keys[0] == big else 0
                if n:
                    yield frame(ids[:n], None, keys[:n], (seen + np.arange(n)) // block, f[:n])
                    seen += n
                    keys, ids, f = keys[n:], ids[n:], f[n:]
                if not len(keys):
                    continue
                big = None
            last = int(np.searchsorted(keys, keys[-1], "left"))
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[new, len(keys)])
            if oversize:
                for s, n in zip(new[size > block].tolist(), size[size > block].tolist(), strict=True):
                    yield frame(ids[s : s + n], None, keys[s : s + n], np.arange(n) // block, f[s : s + n])
                    if s + n == len(keys):
                        big, seen = keys[-1], n
                keep = np.repeat(size <= block, size)
            else:
                keep = np.ones(len(keys), bool)
            done = keep.copy()
            done[last:] = False
            yield from settle(keys[done], ids[done], f[done])
            rest = keep
            rest[:last] = False
            keys, ids, f = keys[rest], ids[rest], f[rest]
        if len(keys):
            yield from settle(keys, ids, f)

    return run


def links(nodes: DataFrame, bits: int, most: int, masks: list[tuple[int, int]], carry: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all nodes (id, f0..) which share a variant and differ in at most ``most`` bits.

    Not every pair is returned, but enough that the components are those of all pairs. Nodes should be distinct. With
    ``carry`` only the first so many columns are sent along and compared.
    """
    every = [c for c in nodes.columns if c != "id"]
    names = every[:carry]
    width = len(names)
    words = [(t, [(m >> (64 * k)) & (2**64 - 1) for k in range((bits + 63) // 64)]) for t, m in masks]
    cover = np.array([w for _, w in words], np.uint64).reshape(len(words), -1)
    seeds = common.mix((np.arange(len(words), dtype=np.uint64) + np.uint64(1)) * np.uint64(common.BASES[1]))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 400_000 // len(words))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                f = np.ascontiguousarray(part[every].to_numpy(np.int64)).view(np.uint64)
                key = np.tile(seeds, (len(part), 1))
                for k in range(cover.shape[1]):
                    key = common.mix(key ^ (f[:, k : k + 1] & cover[None, :, k]))
                out = {"key": key.ravel().view(np.int64), "id": np.repeat(part["id"].to_numpy(np.int64), len(words))}
                for k, name in enumerate(names):
                    out[name] = np.repeat(f[:, k].view(np.int64), len(words))
                yield pd.DataFrame(out)

    fields = ", ".join(f"{n} long" for n in names)
    found = "a long, b long, key long, blk long, " + fields
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # nodes come from an aggregate, which adaptive execution leaves in few tasks: they are dealt out before they multiply
    dealt = nodes.repartition(n, "id").mapInPandas(spread, "key long, id long, " + fields).repartition(n, "key")
    got = common.materialize(dealt.sortWithinPartitions("key").mapInPandas(_links(width, most, block, True), found))
    out = got.filter("b is not null").select("a", "b")
    over = got.filter("b is null")
    if not over.isEmpty():
        last = over.groupBy("key").agg(F.max("blk").alias("last"))
        pairs = over.join(last, "key").select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
        pairs = pairs.select(F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")).alias("key"), F.col("a").alias("id"), *names)
        pairs = pairs.repartition(n, "key").sortWithinPartitions("key")
        out = out.union(pairs.mapInPandas(_links(width, most, 2 * block, False), found).select("a", "b"))
    return out.distinct()


#: Dedup by similarity: shingles of five words, sets that overlap by SIMILAR or more. At SIMILAR the fingerprints' bits differ
#: with a probability of SPREAD, the angle of the sets' vectors (cosine 2 * SIMILAR / (1 + SIMILAR)) as a share of pi.
SHINGLE, SIMILAR = 5, 0.8
SPREAD = float(np.arccos(2 * SIMILAR / (1 + SIMILAR)) / np.pi)
#: Share of the pairs at SIMILAR that some segment must show; rows of a variant on average, at most.
RECALL, CROWD = 0.975, 512
#: Candidates differ in at most MOST_BITS of the first COMPARED * 64 bits: 3.6 standard deviations above the mean at SIMILAR.
COMPARED, MOST_BITS = 2, 34
#: Texts and bytes of shingle hashes in a block that is compared in one go, and texts of a large group that every block holds.
COMPARED_TEXTS, BLOCK_BYTES, LEADERS = 4096, 16_000_000, 32


def similar_plan(n: int) -> tuple[int, int]:
    """(bits of a segment, segments) for n documents: wider segments, and the more of them, the more documents.

    A segment shows a pair that differs in at most one of its bits.
    """
    width = next((w for w in (16, 20, 24) if n <= CROWD << (w - 1)), 28)
    shown = (1 - SPREAD) ** width + width * SPREAD * (1 - SPREAD) ** (width - 1)
    return width, int(np.ceil(np.log(1 - RECALL) / np.log(1 - shown)))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(a) + len(b)
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return 0.0  # cannot reach SIMILAR
    common_ = len(np.intersect1d(a, b, assume_unique=True))
    return common_ / (both - common_) if both else 1.0


def _shingle_sets(width: int):
    """Rows with ``raw`` -> the same with ``set``, the sorted distinct shingle hashes as bytes, in its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.chunks(batches, "raw"):
            out = batch.drop(columns="raw")
            out["set"] = [np.unique(shingle_hashes(raw, width)).tobytes() for raw in batch["raw"]]
            yield out

    return run


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (g, id, class, f0, f1, set) sorted by g -> links (a, b) between texts of a group that overlap by SIMILAR or more.

    Only as many as join the parts of the group; rows of one class are joined already. A group has a bounded size.
    """
    names = [f"f{i}" for i in range(COMPARED)]

    def settle(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, n = part["id"].to_numpy(np.int64), len(part)
        f = np.ascontiguousarray(part[names].to_numpy(np.int64)).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in part["set"]]
        _, first, place = np.unique(part["class"].to_numpy(np.int64), return_index=True, return_inverse=True)
        parent = first[place]
        out = []
        for lag in range(1, n):
            left = np.flatnonzero(parent[:-lag] != parent[lag:])
            near = np.bitwise_count(f[left] ^ f[left + lag]).sum(axis=1) <= MOST_BITS
            for i in left[near].tolist():
                p, q = int(parent[i]), int(parent[i + lag])
                if p != q and overlap(sets[i], sets[i + lag]) >= SIMILAR:
                    parent[parent == max(p, q)] = min(p, q)
                    out.append((ids[i], ids[i + lag]))
            if (parent == parent[0]).all():
                break
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        g = rest["g"].to_numpy()
        cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
        for i, j in zip(cut, cut[1:], strict=False):
            yield from settle(rest.iloc[i:j])
        rest = rest.iloc[cut[-1] :].reset_index(drop=True)
    if rest is not None:
        yield from settle(rest)


def _classes(docs: DataFrame, nodes: DataFrame, near: DataFrame, repeats: bool, block: int, block_bytes: int) -> DataFrame:
    """(node, root) of the nodes (id, first, f0.., size) that overlap by SIMILAR, transitively, within the parts ``near``.

    A part is compared in one task where its texts fit into a block. The texts of a larger one are dealt out to blocks,
    each with the same few leaders, so that a part of mutual copies is joined by its leaders at a cost in proportion to
    its size. Texts that this does not join to the part's largest class then meet all blocks of the part, so no link is lost.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"f{i}" for i in range(COMPARED)]
    members = common.materialize(nodes.join(near.hint("shuffle_merge"), nodes["id"] == near["node"]).select("id", F.col("root").alias("part"), "first", "size", *names))
    sizes = members.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8 + 64).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    large = sizes.filter(blocks > 1).select("part", blocks.alias("blocks"), F.ceil(F.col("n") / LEADERS).cast("long").alias("each"))
    draw = lambda seed: F.xxhash64("id", F.lit(seed))

    def sets_of(chosen: DataFrame) -> DataFrame:
        """``chosen`` (id, first, g array, class, f0..): each with its set, once for each g."""
        texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), common.raw_text().alias("raw"))
        texts = common.flagged(texts, F.col("_doc"), chosen.select("first.doc_id"), "doc_id", "_may").filter("_may").select("_doc", "raw", F.xxhash64("raw").alias("_t"))
        if repeats:
            texts = texts.dropDuplicates(["_doc", "_t"])
        met = texts.join(chosen.hint("shuffle_merge"), (F.col("_doc") == F.col("first.doc_id")) & (F.col("_t") == F.col("first.t")))
        met = met.select("g", "id", "class", *names, "raw").mapInPandas(_shingle_sets(SHINGLE), "g array<long>, id long, class long, " + ", ".join(f"{x} long" for x in names) + ", set binary")
        dealt = met.withColumn("g", F.explode("g")).repartition(n, "g").sortWithinPartitions("g", "id")
        return dealt.mapInPandas(_verified, "a long, b long")

    if large.isEmpty():
        return common.components(sets_of(members.select("id", "first", F.array("part").alias("g"), F.col("id").alias("class"), *names)))
    known = members.join(large, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(draw(1), F.col("blocks")))
    key = lambda *c: F.xxhash64("part", *c)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    g = F.when(F.col("blocks") == 1, F.array(F.col("part"))).when(F.pmod(draw(2), F.col("each")) == 0, F.transform(every, lambda k: key(k.cast("long")))).otherwise(F.array(key("own")))
    known = common.materialize(known)
    links_ = common.materialize(sets_of(known.select("id", "first", g.alias("g"), F.col("id").alias("class"), *names)))
    classes = common.components(links_)
    placed = known.filter("blocks > 1").join(classes, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("root", "id"))
    counts = placed.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("part").agg(F.max(F.struct("n", "class")).alias("m"), F.sum("n").alias("total")).select("part", F.col("m.class").alias("main"), F.ceil((F.col("total") - F.col("m.n")) / block).cast("int").alias("others"))
    odd = placed.join(best.filter("others > 0"), "part").withColumn("other", F.pmod(draw(3), F.col("others")))
    if odd.isEmpty():
        return classes
    meets = lambda a, b: key(F.lit(-1), a.cast("long"), b.cast("long"))
    all_others, all_blocks = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    to_own = F.transform(all_others, lambda k: meets(k, F.col("own")))
    also = F.transform(all_blocks, lambda k: meets(F.col("other"), k))
    g = F.when(F.col("class") == F.col("main"), to_own).otherwise(F.array_distinct(F.concat(to_own, also)))
    return common.components(links_.union(sets_of(odd.select("id", "first", g.alias("g"), "class", *names))))


def representatives(docs: DataFrame, block: int = COMPARED_TEXTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay when of every group of near-duplicates one is kept: the one with the smallest doc_id.

    Near means sets of five-word shingles (A-Z as a-z) that overlap by SIMILAR or more, transitively. Fingerprints find the
    candidates (RECALL of the pairs at SIMILAR, more of nearer ones); their sets decide. Copies are near, as are null
    and empty texts among each other. A row with a null doc_id is no known document: it stays and takes no part. Rows that
    share a doc_id but not a text are compared like others, and of the smallest id the text with the lower hash stays; of
    rows equal in both one stays. An empty table gives no rows. Columns, also further ones, are as they were.

    Only ids and fingerprints of all rows are compared; the texts that move are those of candidates and of rows that go.
    """
    width, segments = similar_plan(docs.count())
    parts = -(-width * segments // 64)
    names = [f"f{i}" for i in range(parts)]
    alike = [*names, "size", "sum"]
    prints = common.materialize(fingerprints(docs.filter("doc_id is not null"), SHINGLE, parts, True))
    # equal sets are one node
    nodes = prints.groupBy(*alike).agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count(F.lit(1)).alias("rows"))
    nodes = common.materialize(nodes.withColumn("id", F.monotonically_increasing_id()))
    edges = links(nodes.select("id", *names), width * segments, MOST_BITS, variant_masks(width * segments, segments), carry=COMPARED)
    twice = prints.groupBy("doc_id", "t").count().filter("count > 1").select("doc_id", "t")
    repeats = not twice.isEmpty()
    classes = _classes(docs, nodes, common.components(edges), repeats, block, block_bytes)
    rooted = nodes.join(classes, nodes["id"] == classes["node"], "left").withColumn("root", F.coalesce("root", "id")).filter(F.col("node").isNotNull() | (F.col("rows") > 1))
    best = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    named = rooted.join(best, "root").select(*alike, "stays")
    gone = prints.join(named, alike).filter(F.struct("doc_id", "t") != F.col("stays")).select("doc_id", "t").distinct()
    marks = gone.withColumn("mark", F.lit(1))
    if repeats:
        marks = marks.union(twice.withColumn("mark", F.lit(2))).groupBy("doc_id", "t").agg(F.min("mark").alias("mark"))
    marks = common.materialize(marks)
    mark, doc, t, may = (common.fresh(c, docs.columns) for c in ("mark", "doc", "t", "may"))
    all_ = common.flagged(docs, F.col("doc_id").cast("long"), marks, "doc_id", may)
    met = all_.filter(may).withColumn(t, F.xxhash64(common.raw_text()))
    marks = marks.select(F.col("doc_id").alias(doc), F.col("t").alias(f"_{t}"), F.col("mark").alias(mark))
    met = met.join(marks.hint("shuffle_merge"), (met["doc_id"] == marks[doc]) & (met[t] == marks[f"_{t}"]), "left")
    out = all_.filter(~F.col(may)).select(*docs.columns).union(met.filter(F.col(mark).isNull()).select(*docs.columns))
    if repeats:
        out = out.union(met.filter(F.col(mark) == 2).dropDuplicates(["doc_id", t]).select(*docs.columns))
    return out


def hex_fingerprint(col: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, tables: tuple[int, int] | None = None) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): documents linked at ``distance`` or fewer differing bits, transitively.

    Complete: no link is missed. Equal fingerprints are one node, so copies cost one row each; a null or empty text has
    fingerprint zero and is linked like any other; a null doc_id keeps its row and is never a component_id unless its
    component has no other. Repeated rows stay. An empty table gives no rows; further columns are ignored.
    """
    prints = common.materialize(fingerprints(docs, width))
    nodes = prints.groupBy("f0").agg(F.min("doc_id").alias("least"))
    segments, choose = tables or plan(nodes.count(), distance)
    edges = links(nodes.select(F.col("f0").alias("id"), "f0"), 64, distance, variant_masks(64, segments, choose))
    parts = common.components(edges)
    rooted = nodes.join(parts, nodes["f0"] == parts["node"], "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    # the root's smallest doc_id; most roots stand alone, so only linked nodes are summed up
    best = nodes.join(parts, nodes["f0"] == parts["node"]).groupBy("root").agg(F.min("least").alias("best"))
    named = rooted.join(best, "root", "left").select("f0", F.coalesce("best", "least").alias("component_id"))
    return prints.join(named, "f0").select("doc_id", hex_fingerprint("f0").alias("fingerprint"), "component_id")
