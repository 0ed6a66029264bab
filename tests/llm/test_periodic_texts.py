"""Substring dedup of texts whose windows repeat inside themselves, against brute force."""

import hashlib
import random

from test_operators import words

from velonet.llm import substring_dedup


def plain(rows, window):
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = t.split()
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_periodic_texts(spark):
    rng = random.Random(51)
    loop, two = "on and on", "tick tock"
    rows = []
    for i in range(30):
        body = " ".join(words(rng, rng.randint(0, 60)))
        rows.append((i, " ".join([body, " ".join([rng.choice([loop, two, "x"])] * rng.randint(1, 400)), body if i % 3 else ""])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(df, 50).collect()}
    assert got == plain(rows, 50)
