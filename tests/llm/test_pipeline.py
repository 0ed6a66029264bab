"""The corpus pipeline stage by stage on a small corpus with planted cases."""

import random

import pytest
from test_operators import words

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(20), [], []
    bench = [(k, " ".join(words(rng, 30))) for k in range(5)]
    for i in range(240):
        w = words(rng, rng.randint(40, 150))
        bad = i % 8 == 0
        rows.append((i, " ".join(x + "$$$" for x in w) if bad else " ".join(w)))
        labels.append((i, int(not bad), 0))
    rows[9] = (9, rows[1][1])
    near = rows[2][1].split()
    near[len(near) // 2] = "edited"
    rows[10] = (10, " ".join([rows[2][1]] * 1 if len(near) < 60 else near))
    rows[11] = (11, rows[11][1] + " " + bench[3][1] + " " + rows[12][1])
    rows[13] = (13, rows[13][1] + " write to jo@ex.org please")
    rows += [(300, None), (301, ""), (None, rows[3][1] + " more"), (14, rows[14][1])]
    out = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, dict(rows)


def test_stages(spark, folder):
    pytest.importorskip("public_tokenizers")
    sf, rows = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert not any(i % 8 == 0 for i in seen[0] if i is not None and i < 240 and i != 10) and len(seen[0]) > 195 and 300 not in seen[0]
    assert 9 not in seen[1] and 10 not in seen[1] and {1, 2, 14} <= set(seen[1]) and len(seen[0]) - len(seen[1]) <= 4
    assert set(seen[1]) - set(seen[2]) == {11}
    assert "[EMAIL]" in seen[3][13] and "jo@ex.org" not in seen[3][13]
    assert all(seen[3][i] == rows[i] for i in seen[3] if i != 13)


def test_run(spark, folder):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    sf, rows = folder
    got = {}
    for r in P.run(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in (1, 2, 15, 17):
        assert [t for _, p in sorted(got[i]) for t in p] == [*slow.encode(rows[i], add_special_tokens=False).ids, 0]
    assert not {9, 10, 11, 8, 300} & set(got)
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
