"""Decontamination finds benchmark items of every length: short ones for certain, longer ones at the stated recall."""

import random

import numpy as np
import pandas as pd
import pytest

from velonet.llm import decontam

#: Share of copies at the tolerated edits that items sought by walks reach at least (README).
RECALL = 0.98


def edited(rng, item, edits):
    out = list(item)
    for _ in range(edits):
        p = rng.randrange(len(out))
        out[p : p + 1] = ([], [f"new{rng.random()}"], [out[p], f"new{rng.random()}"])[rng.randrange(3)]
    return out


def recall(n, cases=200):
    rng, hit = random.Random(n), 0
    for _ in range(cases):
        item = [f"w{rng.randrange(3000)}" for _ in range(n)]
        text = [f"w{rng.randrange(3000)}" for _ in range(60)]
        text[30:30] = edited(rng, item, int(decontam.RATE * n))
        index = decontam.build(pd.DataFrame({"item_id": [1], "raw": [" ".join(item).encode()]}))
        h = decontam.Folded().of(" ".join(text).encode().split())
        hit += bool(list(decontam.search(index, np.r_[h, np.zeros(decontam.STEPS + 1, np.uint64)], np.array([0]), np.array([len(h)]))))
    return hit / cases


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7, 8, 9, 10, 12, 15, 19])
def test_short_items_are_found_for_certain(n):
    assert recall(n) == 1.0


@pytest.mark.parametrize("n", [20, 25, 40, 60])
def test_recall_of_walks(n):
    assert recall(n) >= RECALL


def test_short_items_in_tables(spark):
    bench = spark.createDataFrame([(1, "What is it?"), (2, "one two three four five"), (3, "yes"), (4, "the other of the two came late")], "item_id long, text string")
    rows = [(1, "he said: what is IT and went"), (2, "a one two other four five b"), (3, "nothing of it"), (4, "what it is"), (5, "yes"), (6, "and the other of the two came very late")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.matches(docs, bench).collect()}
    assert got == {(1, 1, 0), (2, 2, 1), (5, 3, 0), (6, 4, 1)}
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {3, 4}
