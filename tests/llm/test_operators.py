"""The training-data operators against brute force, and their behaviour on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from velonet.llm import common, decontam, langid, lm_score, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, text_stats, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, raw int, _gone int"
SYLLABLES = "the of and ra to mi lo ver den tion al ce ber po qui stra nel ou ma ti".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def corpus(n=60, seed=0):
    """Texts with copies, near copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    out = []
    for i in range(n):
        w = words(rng, rng.randint(1, 260))
        if i % 6 == 1:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        if i % 7 == 2 and i > 10:
            w = out[i - 5][1].split()
        if i % 7 == 3 and i > 10:
            w = out[i - 6][1].split()
            if w:
                w[rng.randrange(len(w))] = "changed"
        out.append((i, (" ", "\n", "\t ")[i % 3].join(w)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "one"), (None, out[7][1]), (3, out[3][1]), (n + 5, "é ü " * 3000), (n + 6, "\x1c odd\x0bspaces a b c d")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"s{i}", len(t or ""), "x", 1, 2) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raws():
    return [(i, (t or "").encode()) for i, t in corpus()]


def test_window_hashes_agree():
    h = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    for width in (1, 2, 5, 20, 31, 50):
        every = common.window_hashes(h, width)
        at = np.array([0, 7, len(every) - 1])
        assert (common.window_hashes(h, width, common.BASES[0], at) == every[at]).all()
        assert len(every) == 300 - width + 1 and len(np.unique(every)) == len(every)


def test_covers_are_perfect():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_substring_dedup(spark, docs, empty):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substring_dedup.dedup(docs, 50, texts=True).collect()), key=str)
    first = {}
    for i, raw in raws():
        if i is not None:
            w = raw.split()
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want, removed = [], 0
    for i, raw in raws():
        w, gone = raw.split(), set()
        for k in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        removed += len(gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert got == sorted(want, key=str) and removed > 500
    assert substring_dedup.dedup(empty).count() == 0


def bits_of(raw, width):
    w = raw.lower().split()
    s = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    rows = [(i, bits_of(raw, 4)) for i, raw in raws()]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    assert got == sorted(((i, format(f, "016x"), least.get(find(k))) for k, (i, f) in enumerate(rows)), key=str)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("segments", "choose"), [(3, 1), (5, 2), (6, 3)])
def test_variants_are_complete(segments, choose):
    rng = random.Random(5)
    masks = simhash.variant_masks(64, segments, choose)
    for _ in range(400):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(x & m == 0 for _, m in masks)
    assert simhash.plan(10**6) == (3, 1) and simhash.plan(10**9) == (5, 2) and simhash.plan(10**11) == (6, 3)


def test_links_in_oversize_variants(spark):
    """A dense cluster and many strangers in one variant, with blocks far smaller than the variant."""
    rng = random.Random(6)
    ball = [0b1011 << 40 | sum(1 << b for b in rng.sample(range(20), 2)) for _ in range(150)]
    lone = [rng.getrandbits(20) << 44 | 0xFFFFF for _ in range(60)]
    nodes = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(dict.fromkeys(ball + lone))]
    df = spark.createDataFrame(nodes, "id long, f0 long")
    edges = simhash.links(df, 64, 4, simhash.variant_masks(64, 3), block=16)
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    root = list(range(len(nodes)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(nodes)):
        for b in range(a):
            if ((nodes[a][1] ^ nodes[b][1]) & (2**64 - 1)).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert {k: find(k) for k in range(len(nodes)) if any(find(j) == find(k) for j in range(len(nodes)) if j != k)} == got


def test_representatives(spark, docs, empty):
    kept = [r["doc_id"] for r in simhash.representatives(docs).collect()]
    ids = {i for i, _ in raws() if i is not None}
    assert len(kept) == len(set(kept)) and kept.count(None) == 1
    sets = {}
    for i, raw in raws():
        w = raw.lower().split()
        sets.setdefault(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    for a in ids:
        near = [b for b in ids if b != a and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b])]
        if not near:
            assert a in kept
        for b in near:
            if len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]):
                assert not (a in kept and b in kept)
    assert simhash.representatives(docs).columns == docs.columns
    assert simhash.representatives(empty).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing_round_trip(spark, docs, empty, vocabulary):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    rows = packing.pieces(docs, vocabulary, 64, keep_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    got = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and 1 << r["bucket"] == r["length"]
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for i, raw in raws():
        want = [*slow.encode(raw.decode(), add_special_tokens=False).ids, 0]
        parts = sorted(got[i, len(want)])
        copies = sum(1 for x in raws() if x == (i, raw))
        assert len(parts) == copies * len({s for s, _ in parts})
        assert [t for _, p in parts[::copies] for t in p] == want
    assert packing.pieces(empty, vocabulary).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(docs, vocabulary, 100)


def test_tokenizer_on_odd_texts(vocabulary):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(vocabulary), packing.tokenizer(vocabulary)
    rng = random.Random(7)
    alphabet = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0x85, 0x4E00, 0x660, 0x300, 0xFEFF, 0x1F600]] + ["a", " ", "  ", "\n", "<|endoftext|>", "'s"] * 30
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert fast("a" * 5000).tolist() == slow.encode("a" * 5000, add_special_tokens=False).ids


PII_TEXTS = [
    None, "", "plain words",
    "mail a.b+c@ex-ample.co.uk, x@y.z.b@c.d and é@q.r or @no.pe; a@b.c+d@e.f",
    "é host 10.0.0.256 then 192.168.1.1.7 and 1.2.3.4.5.6.7.8 010.1.1.1",
    "card 4111 1111 1111 1111, bad 4111 1111 1111 1112, long 41111111111111111111111, 5500-0000-0000-0004x",
    "call +1 (415) 555-0132 or +49.30.1234567( +12 +123456789012345678 tel 415-555-0133 and 415-555-0134567",
    "iban DE89 3704 0044 0532 0130 00 ok, DE89370400440532013001 wrong; ssn 123-45-6789 but 123-45-6780 is far " + "x " * 40 + "321-54-9876",
    "1.1.1.1 " * 700, "7" * 4000, "+1 23 456 789 0 " * 300, "a@b" + ".c" * 3000, "x@" * 2000,
]


def brute_pii(text):
    def luhn(d):
        s = 0
        for k, c in enumerate(reversed(d)):
            v = int(c) * (1 + k % 2)
            s += v - 9 * (v > 9)
        return s % 10 == 0

    keep = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in keep.items() for m in re.finditer(p, text) if ok(m[0])]


def test_pii(spark, empty):
    rows = [(i, t, 1) for i, t in enumerate(PII_TEXTS)] + [(None, PII_TEXTS[3], 1), (3, PII_TEXTS[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    for i, t in enumerate(PII_TEXTS):
        want = brute_pii(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["spans"][: len(joined)] == joined, t[:80]
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        for k in ("email", "ip", "card", "phone"):
            assert got[i][f"n_{k}"] == sum(x[0] == k for x in want)
    extra = got[7]["spans"].split(",")
    assert [e.split(":")[0] for e in extra] == ["iban", "national_id", "national_id"] and "local_phone" in got[6]["spans"]
    assert pii.report(df).count() == len(rows) and pii.report(empty).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "write a@b.cc now, +1.2.3.4.5.6789 end", 0), (2, None, 0), (3, "none", 0)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df).collect()}
    assert got[1][0] == "write [EMAIL] now, [PHONE] end" and got[1][1] == len(got[1][0])
    assert got[2] == (None, None) and got[3] == ("none", 4)


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, rng.randint(14, 50)))) for k in range(20)] + [(90, None), (91, ""), (92, "too short"), (None, "null id of an item with enough words in it to count")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1000 + k, " ".join(words(rng, 80)), 0) for k in range(10)]
    for k in range(20):
        w = items[k][1].split()
        for _ in range(int(len(w) * (0, 0.1, 0.2)[k % 3])):
            p = rng.randrange(len(w))
            w[p : p + 1] = ([], ["new"], [w[p], "new"])[rng.randrange(3)]
        rows.append((k, " ".join([*words(rng, 40), *(x.upper() + "," for x in w), *words(rng, 40)]), 0))
    rows += [(500, None, 0), (501, "", 0), (None, items[0][1], 0), (0, rows[10][1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.matches(df, bench).collect()), key=str)
    hashes, want = decontam.Folded(), []
    for i, t, _ in rows:
        h = hashes.of((t or "").encode().split())
        for k, item in items[:20]:
            a = hashes.of(item.encode().split())
            e = decontam.edit_distance(a, h)[0] if len(h) else 10**6
            if e <= int(decontam.RATE * len(a)):
                want.append((i, k, e))
    assert len(got) >= 0.95 * len(want) and set(got) <= set(want) and len(want) >= 20
    clean = {r["doc_id"] for r in decontam.clean(df, bench).collect()}
    assert clean == {i for i, _, _ in rows} - {g[0] for g in got}
    assert decontam.matches(empty, bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0
    assert decontam.clean(df, bench.limit(0)).count() == len(rows)


def test_edit_distance_against_table():
    rng = random.Random(10)
    for _ in range(60):
        item, text = np.array([rng.randrange(4) for _ in range(rng.randint(1, 7))]), np.array([rng.randrange(4) for _ in range(rng.randint(1, 12))])
        best = 99
        for s in range(len(text) + 1):
            row = list(range(len(item) + 1))
            best = min(best, row[-1])
            for c in text[s:].tolist():
                new = [row[0] + 1]
                for j, a in enumerate(item.tolist()):
                    new.append(min(row[j] + (a != c), row[j + 1] + 1, new[j] + 1))
                row = new
                best = min(best, row[-1])
        edits, s, e = decontam.edit_distance(item, text)
        assert edits == best and 0 <= s <= e <= len(text)


def labelled(spark, n=600):
    """Clean prose, and shouted or symbol-laden junk labelled 0."""
    rng, rows, labels = random.Random(11), [], []
    for i in range(n):
        w = words(rng, rng.randint(20, 120))
        bad = i % 5 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    rows += [(n, None), (n + 1, ""), (None, "a few words"), (2, rows[2][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark, empty):
    docs, labels = labelled(spark)
    model = quality_classifier.train(docs, labels)
    rows = quality_classifier.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    want = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id is not null and quality is not null").collect()}
    aside = [r for r in rows if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in aside) and len(aside) > 60
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in aside if r["doc_id"] in want]) > 0.97
    assert 0 < len(model.rules) <= 200
    # the compiled column equals the rules evaluated in numpy
    x = np.array([text_stats.of_text((r["text"] or "").encode(), common.WordHashes())[len(text_stats.COUNTS) :] for r in docs.orderBy("doc_id", "text").collect()])
    margin = quality_classifier.holds(x, list(model.rules)) @ np.array(model.weights) + model.intercept
    assert np.allclose(sorted(r["score"] for r in rows), sorted(1 / (1 + np.exp(-margin))))
    constant = quality_classifier.train(docs, labels.limit(0))
    assert quality_classifier.score(empty, constant).count() == 0 and constant.rules == ()


def test_quality_rules(spark, empty):
    docs, labels = labelled(spark)
    forest = quality_rules.train(docs, labels)
    rows = quality_rules.judged(docs, forest).collect()
    want = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id is not null and quality is not null").collect()}
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert np.mean([i in kept for i, q in want.items() if q]) > 0.97 and np.mean([i in kept for i, q in want.items() if not q]) < 0.1
    assert {r["doc_id"] for r in quality_rules.filtered(docs, forest).collect()} == kept
    assert quality_rules.train(docs, labels.limit(0)) is None and quality_rules.judged(docs, None).filter("kept").count() > 500
    assert quality_rules.judged(empty, forest).count() == 0 and quality_rules.filtered(empty, forest).columns == empty.columns


def test_rule_counts(spark):
    texts = ["a b c d e f a b c d e g", "x\nx\n\n \ny\nx", "é#ü $ <b>|&%*", "w " * 40, None, "a b c d e a b c d e a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judged(df, None).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        rep = {j for k, g in enumerate(win) if win.count(g) > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep))
        assert tuple(got[i][c] for c in text_stats.COUNTS) == want
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(rep) > 20 * len(w))


def test_language_id(spark, empty):
    rng = random.Random(12)
    kinds = {"aa": "the of and to shing ed", "bb": "de la que ción ando los", "cc": "der und schen ung über keit"}
    rows = [(i, " ".join("".join(rng.choices(s.split(), k=2)) for _ in range(rng.randint(2, 120))), k) for i, (k, s) in enumerate(list(kinds.items()) * 200)]
    rows += [(9000, None, "aa"), (9001, "", "bb"), (9002, "123 !? 45", "aa"), (None, rows[1][1], "bb"), (9003, rows[0][1] * 400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df)
    assert net.langs == ("aa", "bb", "cc")
    got = langid.predict(df, net).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[k]["lang_pred"] for k in (9000, 9001, 9002)} == {"und"} and by[9003]["lang_pred"] == rows[0][2] and by[None]["lang_pred"] == "bb"
    aside = [(by[i]["lang_pred"], k) for i, _, k in rows[:600] if by[i]["held_out"]]
    assert len(aside) > 60 and np.mean([a == b for a, b in aside]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.train(empty) is None and langid.predict(df, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, net).count() == 0


def test_windows_cover_the_text():
    for n in (0, 5, 256, 257, 700):
        raw = bytes(range(97, 122)) * 30
        w = langid.windows_of(raw[:n])
        assert w.shape[1] == langid.WINDOW and (n <= 256 or bytes(w[-1]) == raw[n - 256 : n])


URLS = [
    None, "", "no scheme net/", "http://A.Example.NET/en/1", "http://example.net/de/", "https://x.example.com/de/1?a=/b", "https://org/fr/x", "http://example.org/fr", "http://net", "http://net/",
    "http://m.free-bets.example.org/en", "http://ads-track.example.org/", "http://freebets.example.org/", "http://a.org/xxx-xxx#t", "http://bets.example.org/", "x://y://z/fr/", "http://a\nb.org/fr/é",
]


def test_url_filter(spark):
    df = spark.createDataFrame([(i, u, "net/") for i, u in enumerate(URLS)] + [(None, URLS[3], ""), (3, URLS[3], "")], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fits)[1:]) if fits else (None, None)
        assert got[i]["rule"] == rule and (verdict is None or got[i]["verdict"] == verdict)
    assert [got[i]["verdict"] for i in (10, 11, 12, 13, 14)] == ["block", "block", "allow", "block", "allow"] and got[13]["strict_hits"] == 2
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_filter_sql_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(URLS)), "url": URLS}))
    want = sorted(map(tuple, con.execute(url_filter.oracle_sql()).fetchall()))
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert sorted(tuple(r) for r in url_filter.judge(df).collect()) == want


def test_lm_score(spark, docs, empty):
    rng = random.Random(13)
    a, b = words(rng, 30), words(rng, 30)
    make = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    target = spark.createDataFrame([(make(a, 80),) for _ in range(20)] + [(None,), ("",)], "text string")
    rows = [(i, make(a if i % 2 else b, 60)) for i in range(60)] + [(900, None), (901, ""), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm_score.train(target, df)
    got = {r["doc_id"]: r for r in lm_score.score(df, model, leave_out=True).collect()}
    assert len(got) == len(rows) and got[900]["score"] == 0 and got[901]["n_tokens"] == 0
    like, unlike = [got[i]["score"] for i in range(60) if i % 2], [got[i]["score"] for i in range(60) if not i % 2]
    assert max(like) < min(unlike)
    # counts are those of a plain count over all texts
    plain = {}
    for (t,) in [(r["text"],) for r in target.collect()]:
        for w in (t or "").encode().split():
            plain[w] = plain.get(w, 0) + 1
    for w, i in model.words.items():
        if w is not None:
            assert model.unigrams[0][i] == plain[w]
    assert sum(model.unigrams[0]) - model.unigrams[0][lm_score.BEGIN] == sum(plain.values())
    assert all(abs(p.sum() - p[lm_score.BEGIN] - 1) < 1e-9 for p in model.single)
    nothing = lm_score.train(target.limit(0), empty)
    assert lm_score.score(empty, nothing).count() == 0 and lm_score.score(docs, nothing).count() == docs.count()


def test_components(spark):
    rng = random.Random(14)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5000, k) for k in range(5001, 5060)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
