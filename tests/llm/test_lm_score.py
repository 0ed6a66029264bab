"""LM scores against a plain count of every word and bigram, with and without words that are joined."""

import math
import random
from collections import Counter

import pytest
from test_operators import words

from velonet.llm import lm_score


def plain(target, background, docs, leave_out=False):
    sides = [[(t or "").encode().split() for t in s] for s in (target, background)]
    ones = [Counter(w for t in s for w in t) for s in sides]
    twos = [Counter(p for t in s for p in zip([None, *t], t, strict=False)) for s in sides]
    n, vocabulary = [sum(o.values()) for o in ones], len(ones[0] | ones[1])
    least, out = min(n) or 1, {}
    for i, text in docs:
        w = (text or "").encode().split()
        own, pairs = Counter(w), Counter(zip([None, *w], w, strict=False))
        loss = [0.0, 0.0]
        for k in (0, 1):
            scale = least / n[k] if n[k] else 1.0
            gone = k == 1 and leave_out
            for a, b in zip([None, *w], w, strict=False):
                single = ((ones[k][b] - gone * own[b]) * scale + 0.5) / ((n[k] - gone * len(w)) * scale + 0.5 * (vocabulary + 1))
                before = len(sides[k]) - gone if a is None else ones[k][a] - gone * own[a]
                loss[k] -= math.log2(lm_score.SHARE * (twos[k][a, b] - gone * pairs[a, b]) / max(before, 1) + (1 - lm_score.SHARE) * single) / len(w)
        out[i] = (len(w), *loss)
    return out


@pytest.mark.parametrize("hot", [(1 << 20) - 1, 40, 0])
def test_every_word_and_bigram_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_score, "HOT_WORDS", hot)
    rng = random.Random(3)
    # more words than any model of 2**14 words holds, most of them in one corpus only
    many = [f"w{i}" for i in range(20_000)]
    common = words(rng, 40)
    make = lambda own, n: " ".join(rng.choice(common if rng.random() < 0.5 else own) for _ in range(n))
    target = [make(many[:9000], 150) for _ in range(100)] + [None, ""]
    rows = [(i, make(many[5000:], 200)) for i in range(150)] + [(900, None), (901, ""), (None, "x y x y x"), (902, " ".join(many))]
    rows.append(rows[3])
    other = [(i, make(many, 60)) for i in range(20)] + [(21, "never seen"), (22, None)]
    t = spark.createDataFrame([(x,) for x in target], "text string").repartition(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    odd = spark.createDataFrame(other, "doc_id long, text string").repartition(2)
    model = lm_score.train(t, df)
    for frame, source in ((df, rows), (odd, other)):
        got = [(r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"], r["score"]) for r in lm_score.score(frame.select('*'), model, leave_out=frame is df).collect()]
        want = plain(target, [x for _, x in rows], source, frame is df)
        assert sorted(str(g[0]) for g in got) == sorted(str(i) for i, _ in source)
        for i, n, a, b, s in got:
            assert (n, a, b) == (want[i][0], pytest.approx(want[i][1]), pytest.approx(want[i][2])) and s == pytest.approx(a - b)


def test_counts_beyond_31_bits(spark):
    """A model whose commonest word has 2**33 counts scores by them; the counts are put in place of what was counted."""
    rng = random.Random(1)
    t = spark.createDataFrame([(" ".join(words(rng, 30)),) for _ in range(5)], "text string")
    df = spark.createDataFrame([(i, "often " * 3 + " ".join(words(rng, 20))) for i in range(9)], "doc_id long, text string")
    model = lm_score.train(t, df)
    known, number, counts = model.hot.value
    at = int(number[list(known).index(lm_score._hash([b"often"])[0])])
    assert counts.dtype.itemsize == 8
    large = counts.copy()
    large[at, 1] += 1 << 33
    more = lm_score.Models(**{**{f: getattr(model, f) for f in ("target", "background", "counted", "n_words", "texts", "least")}, "tokens": (model.tokens[0], model.tokens[1] + (1 << 33)), "hot": spark.sparkContext.broadcast((known, number, large))})
    was, now = ({r["doc_id"]: r for r in lm_score.score(df, m).collect()} for m in (model, more))
    # the background's single-word part of "often" is all but certain, that of other words all but nothing
    assert was.keys() == now.keys() and all(math.isfinite(r["score"]) and r["loss_background"] != pytest.approx(was[i]["loss_background"]) for i, r in now.items())


def test_rows_are_told_apart_by_id(spark):
    """Equal texts of two ids, two texts of one id, and rows without an id keep their own losses and ids."""
    rows = [(1, "a b c"), (2, "a b c"), (1, "c b"), (None, "a b c"), (None, "b"), (-1, "a b c"), (1 << 62, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in lm_score.cross_entropy_difference(df, df.select("text")).collect())
    assert got == sorted((str(i), len(t.split())) for i, t in rows)
