"""Operators against plain, slow versions of themselves, and odd rows that several of them share."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_operators import words

from velonet.llm import langid, pii, quality_classifier, quality_rules, text_stats, url_filter


def plain_ratios(text):
    """The statistics of text_stats from their definitions."""
    w = text.split(" ") if " " in text or text else []
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(w), sum(map(len, w))
    windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    covered = {i + k for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    kind = lambda f: sum(map(f, text)) / chars
    return {
        "n_words": n, "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "mean_word": chars / n, "upper": kind(lambda c: "A" <= c <= "Z"), "digit": kind(lambda c: "0" <= c <= "9"), "punct": kind(lambda c: 33 <= ord(c) < 127 and not c.isalnum()),
        "symbol": sum(c in "#*$%&|<>" for c in text) / n, "dup_lines": (len(lines) - len(set(lines))) / len(lines), "repeated": len(covered) / n, "distinct": len(set(w)) / n,
        "top_word": max(Counter(w).values()) / n, "adjacent": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "line_words": n / len(lines), "log_words": math.log(1 + n),
        "caps_words": sum(x.encode().isupper() for x in w) / n,
    }


def odd_texts(rng):
    out = []
    for _ in range(40):
        w = words(rng, rng.randint(1, 80))
        w = [x.upper() if rng.random() < 0.1 else x + rng.choice(["", "", "!", "9", "#", "é", "$%"]) for x in w]
        w += w[:7] * rng.randint(0, 2)
        out.append("".join(x + rng.choice([" ", " ", " ", "\n", "\t", "\n\n"]) for x in w))
    return out


def test_statistics(spark):
    texts = odd_texts(random.Random(41))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in text_stats.measured(df).collect():
        want = plain_ratios(texts[r["doc_id"]])
        for k, v in want.items():
            assert r[k] == pytest.approx(v), (k, texts[r["doc_id"]])


def test_forest_walks():
    """Anomalies are those of walking every tree node by node."""
    rng = np.random.default_rng(42)
    x = rng.normal(size=(400, len(text_stats.RATIOS)))
    forest = quality_rules.grow(x)
    odd = np.vstack([x[:30], rng.normal(0, 6, (30, x.shape[1]))])
    for row, got in zip(odd, quality_rules.anomaly(forest, odd), strict=True):
        total = 0.0
        for t in range(len(forest.feature)):
            at = 0
            while forest.feature[t, at] >= 0:
                at = forest.child[t, at, int(row[forest.feature[t, at]] > forest.threshold[t, at])]
            total += forest.length[t, at]
        assert got == pytest.approx(2 ** (-total / len(forest.feature) / forest.unit))


def test_cut_takes_every_labelled_row(spark):
    rng = np.random.default_rng(43)
    good, bad = rng.beta(4, 6, 3000), rng.beta(6, 4, 500)
    df = spark.createDataFrame([(1, float(a)) for a in good] + [(0, float(a)) for a in bad], "quality int, anomaly double")
    low = np.sort(good)[math.ceil(3000 * (1 - quality_rules.MISS)) - 1]
    for rank in (0, 1, 1500, 2999):
        assert quality_rules.ranked(df.filter("quality = 1"), "anomaly", rank) == np.sort(good)[rank]
    above = bad[bad > low].min()
    assert quality_rules.calibrate(df) == pytest.approx((max(low, good[good < above].max()) + above) / 2)
    assert quality_rules.calibrate(df.filter("quality = 0")) == math.inf
    assert quality_rules.calibrate(df.filter("quality = 1")) == low


def test_held_out_rows_train_nothing(spark):
    import zlib

    rows = [(i, " ".join(words(random.Random(i), 40))) for i in range(300)]
    labels = [(i, 1 if zlib.crc32(str(i).encode()) % 5 else 0) for i in range(300)] + [(3, 0), (None, 1), (7, None)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = text_stats.sample(docs.union(docs.filter("doc_id = 1")), lab, 1000)
    assert set(got["quality"]) == {1} and got["doc_id"].is_unique and all(zlib.crc32(str(i).encode()) % 5 for i in got["doc_id"])


def test_one_id_many_times(spark):
    """What comes to the driver is bounded by rows, not by ids."""
    rows = [(5, "the same text again", "en")] * 3000 + [(None, f"text number {i} of many", "fr") for i in range(3000)] + [(i, f"wort {i} und wort", "de") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    keep, langid.fit = langid.fit, lambda w, y, langs: seen.append((len(w), langs))
    try:
        langid.train(df, most=300)
    finally:
        langid.fit = keep
    assert seen[0][1] == ("de", "en", "fr") and seen[0][0] <= 300 * (langid.WINDOWS_EACH + 1)
    labels = spark.createDataFrame([(5, 1)] * 50, "doc_id long, quality int")
    assert len(text_stats.sample(df, labels, 10)) <= 1


def test_network_forward_pass():
    """Log probabilities are those of plain loops over bytes, filters and windows."""
    rng = np.random.default_rng(44)
    tables = tuple(rng.normal(size=(w, 256, 5)) for w in langid.WIDTHS)
    net = langid.Network(("a", "b", "c"), tables, rng.normal(size=15), rng.normal(size=(15, 3)), rng.normal(size=3))
    w = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    for row, got in zip(w, langid.log_probabilities(net, w), strict=True):
        pooled = [max(sum(t[o, row[i + o], f] for o in range(len(t))) for i in range(len(row) - len(t) + 1)) for t in tables for f in range(5)]
        z = [sum(max(p + b, 0) * d[k] for p, b, d in zip(pooled, net.bias, net.dense, strict=True)) + net.shift[k] for k in range(3)]
        assert got == pytest.approx([v - math.log(sum(map(math.exp, z))) for v in z])


def test_personal_data_in_long_texts(spark):
    """Thousands of spans in one text, context across matches, and columns with the operator's own names."""
    rng = random.Random(45)
    parts = [rng.choice(["mail jo@ex.org now ", "ip 10.1.2.3 ", "+1 212 555 0199 call ", "wört " * 30, "phone 212-555-0188 "]) for _ in range(6000)]
    text = "é" + "".join(parts)
    df = spark.createDataFrame([(1, text, "x", "y", 1), (2, None, "x", "y", 2), (3, "", "x", "y", 3), (3, "", "x", "y", 3), (None, "a@b.co", "x", "y", 4)], "doc_id long, text string, _m_email string, _spans string, _cut int")
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    want = text
    for k, tag in ((r"[A-Za-z]+@[a-z.]+[a-z]", "[EMAIL]"), (r"10\.1\.2\.3", "[IP]"), (r"\+1 212 555 0199", "[PHONE]"), (r"212-555-0188", "[PHONE]")):
        want = re.sub(k, tag, want)
    assert got[1]["text"] == want and got[2]["text"] is None and got[3]["text"] == "" and got[None]["text"] == "[EMAIL]"
    assert pii.redact(df).columns == df.columns and got[1]["_m_email"] == "x" and got[1]["_spans"] == "y" and got[1]["_cut"] == 1
    assert pii.redact(df).count() == 5 and pii.redact(df.limit(0)).count() == 0
    r = pii.report(df.filter("doc_id = 1")).first()
    assert r["n_email"] == text.count("jo@ex.org") and r["n_ip"] == text.count("10.1.2.3")


def test_vocabulary():
    every = [t for t in url_filter.STRICT] + [t for terms in url_filter.SOFT.values() for t in terms]
    assert len(every) == len(set(every)) > 130
    assert all(re.fullmatch("[a-z0-9-]+", t) for t in every)


def test_addresses(spark):
    long = "http://a.org/" + "x/" * 50_000
    urls = [("http://a.org/Keygen", "allow"), ("http://a.org/KEYGEN", "block"), ("http://a.org/fake_id", "block"), ("http://a.org/win/win/win", "allow"), ("http://a.org/win/prize", "block"), ("http://a.org/crypto-gift", "allow"), ("http://a.org/crypto-gift-offer", "block"), (long + "casino", "block"), (long, "allow"), (None, "allow")]
    df = spark.createDataFrame([(i, u, 1, 2) for i, (u, _) in enumerate(urls)], "page_id long, url string, weight int, verdict int")
    assert [r["verdict"] for r in sorted(url_filter.judge(df).collect(), key=lambda r: r["page_id"])] == [v for _, v in urls]


def test_clashing_names_and_long_texts(spark):
    long = " ".join(words(random.Random(46), 50_000))
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, "a few words", 1, 2, 3)], "doc_id long, text string, score int, raw int, n_words int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, score int")
    assert quality_classifier.score(df, quality_classifier.train(df, labels)).count() == 2
    assert quality_rules.filtered(df, quality_rules.train(df, labels)).columns == df.columns
    assert quality_rules.judged(df.select("doc_id", "text"), None).count() == 2
