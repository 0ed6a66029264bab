"""Operator 6, language ID: a byte convolutional network, trained in numpy, over batched fixed-length windows.

Filters of several widths slide over byte embeddings; the largest response of each filter in a window goes through a
softmax. A text is cut into windows that cover all of it; their log probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes in a window, and windows that one training text gives at most, spread over the whole of it.
WINDOW, WINDOWS_EACH = 256, 3
#: Labelled texts that the network is trained on, at most, shared out evenly among the languages.
MOST_ROWS = 4_000
#: Texts of a language that training asks for at least, so that the draw leaves none out.
LEAST_EACH = 16
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 8
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.01, 3
#: Bytes that one pass of the network takes.
PASS = 1 << 16


@dataclass(frozen=True)
class Network:
    langs: tuple[str, ...]
    tables: tuple[np.ndarray, ...]  # of each width: (width, 256, FILTERS), embedding and filter multiplied out
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray


def windows_of(raw: bytes) -> np.ndarray:
    """Rows of WINDOW bytes that cover the text; the last one ends where the text does, a short text is filled with spaces."""
    if len(raw) <= WINDOW:
        return np.frombuffer(raw.ljust(WINDOW), np.uint8)[None, :]
    a = np.frombuffer(raw, np.uint8)
    full = a[: len(a) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return full if len(a) % WINDOW == 0 else np.vstack([full, a[-WINDOW:]])


def pooled(tables: tuple[np.ndarray, ...], w: np.ndarray, where: bool = False):
    """Largest response of every filter in each window (and the position of it, for training)."""
    best, at = [], []
    for t in tables:
        width = len(t)
        n = w.shape[1] - width + 1
        r = t[0][w[:, :n]]
        for o in range(1, width):
            r += t[o][w[:, o : o + n]]
        if where:
            k = r.argmax(axis=1)
            at.append(k)
            best.append(np.take_along_axis(r, k[:, None, :], 1)[:, 0])
        else:
            best.append(r.max(axis=1))
    return (np.hstack(best), at) if where else np.hstack(best)


def log_probabilities(net: Network, w: np.ndarray) -> np.ndarray:
    out = []
    step = PASS // WINDOW
    for i in range(0, len(w), step):
        z = np.maximum(pooled(net.tables, w[i : i + step]) + net.bias, 0) @ net.dense + net.shift
        z -= z.max(axis=1, keepdims=True)
        out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
    return np.vstack(out)


def fit(windows: np.ndarray, y: np.ndarray, langs: tuple[str, ...]) -> Network:
    """Adam on the cross-entropy, with plain numpy gradients."""
    rng = np.random.default_rng(SEED)
    k = len(WIDTHS) * FILTERS
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(k), "d": rng.normal(0, 0.3, (k, len(langs))), "s": np.zeros(len(langs))}
    for i, width in enumerate(WIDTHS):
        p[f"w{i}"] = rng.normal(0, 1 / np.sqrt(width * EMBED), (width, EMBED, FILTERS))
    p = {n: v.astype(np.float32) for n, v in p.items()}
    m, v = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            w, t = windows[rows], y[rows]
            tables = tuple(p["e"] @ p[f"w{j}"][o] for j, width in enumerate(WIDTHS) for o in range(width))
            grouped, used = [], 0
            for width in WIDTHS:
                grouped.append(np.stack(tables[used : used + width]))
                used += width
            best, at = pooled(tuple(grouped), w, True)
            h = np.maximum(best + p["b"], 0)
            z = h @ p["d"] + p["s"]
            z -= z.max(axis=1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(t)), t] -= 1
            q /= len(t)
            g = {"d": h.T @ q, "s": q.sum(axis=0), "e": np.zeros_like(p["e"])}
            dh = (q @ p["d"].T) * (h > 0)
            g["b"] = dh.sum(axis=0)
            for j, width in enumerate(WIDTHS):
                part = dh[:, j * FILTERS : (j + 1) * FILTERS]
                gw = np.zeros_like(p[f"w{j}"])
                for o in range(width):
                    byte = np.take_along_axis(w, at[j] + o, 1)  # batch x filters
                    gw[o] = np.einsum("bfe,bf->ef", p["e"][byte], part)
                    np.add.at(g["e"], byte.ravel(), (part[:, :, None] * p[f"w{j}"][o].T[None]).reshape(-1, EMBED))
                g[f"w{j}"] = gw
            step += 1
            for n in p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                p[n] = p[n] - (RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    made = tuple(np.stack([p["e"] @ p[f"w{j}"][o] for o in range(width)]) for j, width in enumerate(WIDTHS))
    return Network(langs, made, p["b"], p["d"], p["s"])


def _training_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, lang, raw in zip(batch["doc_id"], batch["lang"], batch["raw"], strict=True):
            w = windows_of(raw)
            take = np.unique(np.linspace(0, len(w) - 1, WINDOWS_EACH).astype(int))
            rows += [(doc, int(i), lang, w[i].tobytes()) for i in take]
            words = raw.split()  # texts may be a word or two, so a training text gives a short piece as well
            short = words[common.WordHashes().of(words[-1:])[0] % len(words) :][:2] if words else []
            if short:
                rows.append((doc, -1, lang, b" ".join(short)[:WINDOW].ljust(WINDOW)))
        yield pd.DataFrame(rows, columns=["doc_id", "part", "lang", "window"])


def train(docs: DataFrame, most: int = MOST_ROWS) -> Network | None:
    """Train on a bounded sample: of each language the texts whose hashes are lowest; None without any labelled text.

    Every label counts as a language. Rows that held_out() sets aside never enter; rows equal in id, label and text are one
    text. What comes to the driver is windows of fixed size of about ``most`` texts, or of LEAST_EACH a language where that
    is more.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~common.held_out())
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}
    if not counts:
        return None
    each = max(LEAST_EACH, most // len(counts))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.1 * each / n)))])
    place = F.col("key") / F.lit(float(2**64)) + 0.5
    picked = rows.filter(place <= share[F.col("lang")]).dropDuplicates(["lang", "key"]).select("doc_id", "lang", common.raw_text().alias("raw"))
    got = picked.mapInPandas(_training_windows, "doc_id long, part int, lang string, window binary").toPandas()
    got = got.sort_values(["doc_id", "part", "window"]).reset_index(drop=True)
    langs = tuple(sorted(set(got["lang"])))
    y = got["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    return fit(np.stack([np.frombuffer(w, np.uint8) for w in got["window"]]), y, langs)


def has_letter(raw: bytes) -> bool:
    """Whether the text holds a letter of any script."""
    if raw.upper() != raw or raw.lower() != raw:
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of ``docs``.

    A null or letterless text is ``und`` with score 0, as is every text when nothing could be learned; null ids are not
    held out; repeated rows stay; an empty table gives no rows; further columns are ignored. The network has a fixed
    size and goes to the tasks with the function. Of languages with equal probabilities the first in order wins. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.chunks(batches, "raw", 4_000_000):
            lang, score = ["und"] * len(batch), np.zeros(len(batch))
            spoken = [i for i, raw in enumerate(batch["raw"]) if has_letter(raw)] if net is not None else []
            if spoken:
                cut = [windows_of(batch["raw"].iat[i]) for i in spoken]
                first = np.cumsum([0, *map(len, cut)])[:-1]
                size = np.array(list(map(len, cut)))
                z = np.add.reduceat(log_probabilities(net, np.vstack(cut)), first, axis=0) / size[:, None]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                for i, k, s in zip(spoken, z.argmax(axis=1).tolist(), z.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = net.langs[k], s
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array, "lang_pred": lang, "score": score})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.raw_text().alias("raw"))
    got = source.mapInPandas(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")
