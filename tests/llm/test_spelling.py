"""Spelling variants against plain versions: the vocabulary, the near words, the forms."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from velonet.llm import spelling

SYLLABLES = "the of and ra to mi lo ver den tion al ce ber po qui stra né über ß".split()


def lowered(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def plain(rows, every=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = defaultdict(set)
    for a in counts:
        for b in counts:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near[a].add(b)
            if len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    base = ["".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    out = []
    for i in range(80):
        words = []
        for _ in range(150):
            w = rng.choices(base, [1 / (k + 1) for k in range(len(base))])[0]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("aeé") + w[k], rng.choice("aeé")]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "—", "\n", "\x00", "Ā"]).join(words)))
    return [*out, out[3], (None, out[4][1]), (200, None), (201, ""), (202, "Straßenbahn " * 30_000), (203, "q" * 50_000 + " " + "q" * 50_000), (204, "q" * 50_001 + " " + "q" * 50_001)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "w", 1) for i, t in corpus()], "doc_id long, text string, word string, n int").repartition(3)


@pytest.mark.parametrize("most", [1000, 3])
def test_variants(docs, most):
    assert sorted(map(tuple, spelling.variants(docs, most=most).collect())) == plain(corpus())


def test_chains_of_forms(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50}
    docs = spark.createDataFrame([(1, " ".join(w for w, n in counts.items() for _ in range(n)))], "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(docs, every=0).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij", 1) and got["abcdefghij"] == (None, "abcdefghij", 1)
    assert got["zzzzzzz"] == ("zzzzzzx", "zzzzzzx", 2), "of equal numbers the smaller word"


def test_each_pair_comes_once(spark):
    words = [("a" * n, 2) for n in range(7, 12)] + [("a" * k + "b" + "a" * (7 - k), 2) for k in range(8)]
    table = spark.createDataFrame(words, "word string, n long")
    for most in (100, 2):
        pairs = [(r.word, r.other) for r in spelling.near_words(table, most=most).collect()]
        assert len(pairs) == len(set(pairs))


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []
