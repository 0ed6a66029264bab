"""Lines drawn into map tiles: cell traversal gives pixels, one task for each tile makes its picture."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial as S

#: Red, green and blue of the values 0 to 7 and of the ground around them.
PALETTE = ((190, 190, 190), (0, 160, 70), (120, 200, 80), (250, 210, 60), (240, 140, 40), (220, 80, 40), (190, 30, 60), (120, 0, 90))
GROUND = (255, 255, 255)


def priority(load_class: Column, level: Column) -> Column:
    """A segment's load class where it is above 4 and the stress level is high or unknown (3, 4, 0, -1), else 0."""
    return F.when(level.isin(3, 4, 0, -1) & (load_class > 4), load_class).otherwise(0)


def in_frame(segments: DataFrame, left: float, right: float, low: float, high: float) -> DataFrame:
    """Segments (x1, y1, x2, y2) that meet a box, its border included."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))

    def span(a: Column, d: Column, lo: float, hi: float) -> tuple[Column, Column]:
        p, q = (lo - a) / F.nullif(d, F.lit(0.0)), (hi - a) / F.nullif(d, F.lit(0.0))
        still = F.when(a.between(lo, hi), 0.0).otherwise(2.0)  # no extent in this axis: within the box all along, or never
        return F.coalesce(F.least(p, q), still), F.coalesce(F.greatest(p, q), F.lit(1.0))

    (a, b), (c, d) = span(x1, x2 - x1, left, right), span(y1, y2 - y1, low, high)
    return segments.filter(F.greatest(F.lit(0.0), a, c) <= F.least(F.lit(1.0), b, d))


def pixels(segments: DataFrame, value: str, pixel: float, side: int = 256, grow: float = 0.0, lowest: bool = False) -> DataFrame:
    """Pixels (tile_x, tile_y, px, py, value, n) of ``pixel`` metres that segments (x1 .. y2, value) cross.

    Tiles have ``side`` by ``side`` pixels, counted from the origin to the right and up. Of the values at a pixel the
    greatest is drawn (``lowest``: the smallest); ``n`` counts the segments. ``grow`` widens lines to both sides. Segments
    without a value are left out. Pixels are merged before the exchange, so a busy place sends one row from each task.
    """
    cells = S.hash_segments(S.dealt_out(segments.filter(F.col(value).isNotNull()).select("line", "x1", "y1", "x2", "y2", F.col(value).alias("value"))), pixel, grow)
    best = F.min("value") if lowest else F.max("value")
    out = cells.groupBy("cx", "cy").agg(best.alias("value"), F.count(F.lit(1)).alias("n"))
    tile = lambda c: F.floor(F.col(c) / side).cast("long")
    return out.select(tile("cx").alias("tile_x"), tile("cy").alias("tile_y"), F.pmod("cx", F.lit(side)).alias("px"), F.pmod("cy", F.lit(side)).alias("py"), "value", "n")


def picture(drawn: np.ndarray, palette=PALETTE, ground=GROUND) -> bytes:
    """A PNG with a palette; ``drawn`` holds a value, or -1 for the ground, by row from the top and column."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    index = np.where(drawn < 0, len(palette), np.minimum(drawn, len(palette) - 1)).astype(np.uint8)
    rows = np.hstack([np.zeros((index.shape[0], 1), np.uint8), index])
    head = struct.pack(">IIBBBBB", index.shape[1], index.shape[0], 8, 3, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"PLTE", bytes(c for rgb in (*palette, ground) for c in rgb)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def indexes(png: bytes) -> np.ndarray:
    """Palette numbers of a picture() by row from the top and column."""
    at, data, wide, high = 8, b"", 0, 0
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        if kind == b"IHDR":
            wide, high = struct.unpack_from(">II", png, at + 8)
        if kind == b"IDAT":
            data += png[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(high, wide + 1)[:, 1:]


def tile_files(drawn: DataFrame, side: int = 256, palette=PALETTE, ground=GROUND) -> DataFrame:
    """Files (name, content) of the tiles of pixels(): one PNG for each, named by column and row. A group has side * side rows at most."""

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((side, side), -1, np.int64)
        grid[side - 1 - rows["py"].to_numpy(), rows["px"].to_numpy()] = rows["value"].to_numpy()
        return pd.DataFrame({"name": [f"tile_{key[0]}_{key[1]}.png"], "content": [picture(grid, palette, ground)]})

    return drawn.select("tile_x", "tile_y", "px", "py", "value").groupBy("tile_x", "tile_y").applyInPandas(draw, "name string, content binary")


def tiles_read(spark, path: str, side: int = 256, palette=PALETTE) -> DataFrame:
    """Pixels (tile_x, tile_y, px, py, value) drawn on the tiles in a folder."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                x, y = name.rsplit("/", 1)[1][5:-4].split("_")
                grid = indexes(content)[::-1]
                py, px = np.nonzero(grid < len(palette))
                yield pd.DataFrame({"tile_x": int(x), "tile_y": int(y), "px": px, "py": py, "value": grid[py, px].astype(int)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tile_*.png").load(path).select("path", "content")
    return files.mapInPandas(read, "tile_x long, tile_y long, px long, py long, value int")
