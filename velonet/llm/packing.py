"""Operator 4, packing: power-of-two decomposition of tokenised documents."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LENGTH = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its own character where that prints, else as one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """texts -> id arrays, equal to ``tokenizers`` with add_special_tokens=False.

    The same vocabulary and merge order run on a faster byte-pair engine; a text that holds an added token's string, or a
    control or separator character whose class the two engines could see differently, goes to ``tokenizers`` itself.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    added = [t["content"] for t in spec.get("added_tokens", [])]
    byte = _byte_of_symbol()
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = regex.compile(r"[\x00-\x08\x0B-\x1F\x7F-\xA0\u1680\u180E\u2000-\u206F\u3000\uFEFF]|[^\p{Assigned}]|[\U00010000-\U0010FFFF]")
    plain: set[str] = set()  # characters seen so far that both engines class alike; bounded by the basic plane

    def encode(text: str) -> np.ndarray:
        new = set(text) - plain
        strange = {c for c in new if odd.match(c)}
        plain.update(new - strange)
        if strange or any(t in text for t in added):
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def binary_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Full pieces of ``most`` (a power of two), then the set bits of what is left, largest first."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer_path: str, most: int = MAX_LENGTH, keep_ids: bool = False) -> DataFrame:
    """Cut each document (doc_id, text) into pieces of binary length; equal lengths form a bucket.

    A document's ids are those of its text (null: empty) and a final 0. Every piece is a sequence of its own, so no
    sequence crosses documents and none needs padding; batches are drawn from one bucket of equal lengths. No shuffle:
    pieces are made where the document was read. ``sequence_id`` numbers the pieces by input split and row, unique and
    the same for the same splits, so a retried task repeats it. With ``keep_ids`` the ids follow as an array.
    Null or repeated doc_ids and repeated rows are packed like any others; an empty table gives no rows; further
    columns are ignored.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest piece must be a power of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        encode = tokenizer(tokenizer_path)
        for batch in common.chunks(batches, "text", 3_000_000):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            arrays = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = np.append(encode(text), np.uint32(0)).astype("<u4", copy=False)
                at = 0
                for n in binary_lengths(len(ids), most):
                    part = ids[at : at + n]
                    rows["doc_id"].append(doc_id)
                    rows["start"].append(at)
                    rows["length"].append(n)
                    rows["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    rows["doc_tokens"].append(len(ids))
                    if keep_ids:
                        arrays.append(part.astype(np.int32))
                    at += n
            out = pd.DataFrame(rows)
            out["doc_id"] = pd.array([None if x is None or x != x else int(x) for x in rows["doc_id"]], "Int64")
            if keep_ids:
                out["ids"] = arrays
            yield out

    common.small_batches(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = source.mapInPandas(run, SCHEMA + (", ids array<int>" if keep_ids else ""))
    return cut.select(
        *[c for c in cut.columns if c != "ids"],
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.round(F.log2("length")).cast("int").alias("bucket"),
        *[c for c in cut.columns if c == "ids"],
    )
