"""Near-duplicate representatives against exact Jaccard similarities of five-word shingle sets."""

import random

import pytest
from test_operators import words

from velonet.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = "".join(words(rng, 2))
    return " ".join(w)


def exact(rows):
    """Of every group of mutually reachable rows the smallest id."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {min(rows[k][0] for k in range(len(rows)) if find(k) == r) for r in map(find, range(len(rows)))}


@pytest.mark.parametrize("block", [512, 12])
def test_groups_are_exact(spark, block):
    """A large group of near copies, chains, texts just below the similarity, and strangers; also in tiny blocks."""
    rng = random.Random(31)
    base = " ".join(words(rng, 120))
    texts = [edited(rng, base, 1) for _ in range(70)] + [edited(rng, base, 9) for _ in range(40)]
    chain = " ".join(words(rng, 150))
    for _ in range(15):
        texts.append(chain)
        chain = edited(rng, chain, 2)
    texts += [" ".join(words(rng, rng.randint(5, 200))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in simhash.representatives(df, block=block).collect()} == exact(rows)


def test_recall_and_precision(spark):
    """Pairs at 0.8 to 0.85: 95 in 100 are resolved. Pairs at 0.7 to 0.8: all stay."""
    rng = random.Random(32)
    rows, near, far = [], [], []
    while len(near) < 300 or len(far) < 200:
        text = " ".join(words(rng, rng.randint(60, 400)))
        other = edited(rng, text, rng.randint(1, 12))
        s = similarity(shingles(text), shingles(other))
        kind = near if 0.8 <= s < 0.85 and len(near) < 300 else far if 0.7 <= s < 0.8 and len(far) < 200 else None
        if kind is not None:
            kind.append(len(rows))
            rows += [(len(rows), text), (len(rows) + 1, other)]
    kept = {r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i in kept for i, _ in rows if i % 2 == 0) and all(i + 1 in kept for i in far)
    assert sum(i + 1 not in kept for i in near) >= 0.95 * len(near)


def test_odd_rows(spark):
    rng = random.Random(33)
    a, b = " ".join(words(rng, 90)), " ".join(words(rng, 90))
    long = " ".join(words(rng, 60_000))
    rows = [(1, a, 5), (1, b, 6), (2, a.upper(), 7), (3, None, 8), (4, "", 9), (5, "   ", 1), (None, a, 2), (None, a, 2), (7, long, 3), (8, long + " end", 4), (9, "four words are few", 4), (9, "four words are few", 4)]
    rows += [(6, b + " more", 3)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(4)
    df = df.withColumns({"_t": df["mark"], "doc": df["mark"], "t": df["mark"], "first": df["mark"]})
    got = simhash.representatives(df)
    assert got.columns == df.columns
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert found == sorted([(1, a), (1, b), (3, ""), (0, a), (0, a), (7, long), (9, "four words are few")])
    assert simhash.representatives(df.limit(0)).count() == 0


def test_plan():
    assert simhash.similar_plan(1000) == (16, 12)
    last = 0
    for n in (10**6, 10**8, 10**9, 10**11):
        width, segments = simhash.similar_plan(n)
        shown = (1 - simhash.SPREAD) ** width + width * simhash.SPREAD * (1 - simhash.SPREAD) ** (width - 1)
        assert 1 - (1 - shown) ** segments >= simhash.RECALL and width >= last
        last = width
