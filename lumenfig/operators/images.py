"""Rasters: dark content around a box, gaps between panels, crops. Pixels stay inside Arrow functions and never become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Brightness from which a pixel is white; strip, step and gap of the scan; dark share of content.
WHITE, STRIP, STEP, GAP, SEED_GAP, DARK = 245, 10, 4, 200, 260, 0.002
#: How far a box may grow up, left and right, and a seeded box up.
UP, LEFT, RIGHT, SEED_UP = 1200, 1000, 1000, 1500

#: Boxes of a page from which prefix sums of its raster are cheaper than to add up what each box looks at.
MANY = 30


#: Fixed value: pixels across an image that is sent to a model.
PAYLOAD = 1024
EDGES = ["x0", "y0", "x1", "y1", "top", "left", "right"]


class ImageCodec(Protocol):
    """Reads an image's bytes as grey values and writes a cut of it; real formats stay behind it."""

    def grey(self, content: bytes) -> np.ndarray: ...

    def crop(self, content: bytes, box: tuple[int, int, int, int]) -> bytes: ...

    def fit(self, content: bytes, widest: int) -> bytes: ...


def prefix_sums(grey: np.ndarray, white: int = WHITE) -> np.ndarray:
    """Sums of dark pixels over all rectangles from the corner, with a border of zeros."""
    out = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int32 if grey.size < 1 << 31 else np.int64)
    np.cumsum(np.cumsum(grey < white, 0, out.dtype), 1, out=out[1:, 1:])
    return out


def rect_sum(sums: np.ndarray, x0, y0, x1, y1):
    """Dark pixels of a rectangle, or of arrays of them; 0 for empty and inverted ones."""
    x0, y0, x1, y1 = np.broadcast_arrays(x0, y0, x1, y1)
    ok = (x1 > x0) & (y1 > y0)
    a, b, c, d = (np.where(ok, v, 0) for v in (x0, y0, x1, y1))
    return np.where(ok, sums[d, c] - sums[b, c] - sums[d, a] + sums[b, a], 0)


def _last_hit(dark: np.ndarray, allow: int, step: int) -> int:
    """Index of the last strip with content that no longer gap separates from the start; -1 if there is none."""
    hits = np.flatnonzero(dark)
    misses = np.diff(np.r_[-1, hits]) - 1
    far = np.flatnonzero(misses * step > allow)
    hits = hits[: far[0]] if len(far) else hits
    return int(hits[-1]) if len(hits) else -1


def strip_sums(sums: np.ndarray, low: int, high: int, at: np.ndarray, to: np.ndarray, down: bool) -> np.ndarray:
    """Dark pixels of strips, from ``at`` to ``to`` of the rows (down) or columns, between low and high of the other axis.

    sums: prefix sums, or the dark pixels themselves (bool), of which only those of the strips are added up then.
    """
    if sums.dtype != bool:
        return rect_sum(sums, low, at, high, to) if down else rect_sum(sums, at, low, to, high)
    if not len(at):
        return at
    first, last, low, high = max(0, int(at.min())), max(0, int(to.max())), max(0, low), max(0, high)
    part = sums[first:last, low:high] if down else sums[low:high, first:last]
    run = np.zeros(part.shape[0 if down else 1] + 1, np.int64)
    np.cumsum(np.add.reduce(part.view(np.uint8), axis=1 if down else 0, dtype=np.int32), out=run[1:])
    at, to = (np.clip(v - first, 0, len(run) - 1) for v in (at, to))
    return run[np.maximum(at, to)] - run[at]


def grown(sums: np.ndarray, box, top: int = 0, left: int = 0, right: int | None = None, up: int = UP, allow: int = GAP) -> list[int]:
    """A box grown up, then left, then right, over strips with content, each with the edges moved before. Never down.

    sums: prefix sums, which cost once a raster, or its dark pixels (bool), of which each box adds up what it looks at.
    """
    height, width = sums.shape if sums.dtype == bool else (sums.shape[0] - 1, sums.shape[1] - 1)
    x0, y0, x1, y1 = (int(v) for v in box)
    most = min(up, y0 - top)
    if most > 0:
        at = np.maximum(top, np.arange(y0 - STRIP, y0 - most - 1, -STEP))
        to = np.minimum(height, at + STRIP)
        hit = _last_hit(strip_sums(sums, x0, x1, at, to, True) / np.maximum(1, (x1 - x0) * (to - at)) >= DARK, allow, STEP)
        y0 = int(at[hit]) if hit >= 0 else y0
    most = min(LEFT, x0 - left)
    if most > 0:
        at = np.maximum(left, np.arange(x0 - STRIP, x0 - most - 1, -STEP))
        to = np.minimum(width, at + STRIP)
        hit = _last_hit(strip_sums(sums, y0, y1, at, to, False) / np.maximum(1, (to - at) * (y1 - y0)) >= DARK, allow, STEP)
        x0 = int(at[hit]) if hit >= 0 else x0
    most = min(RIGHT, (width if right is None else right) - x1)
    if most > 0:
        at = np.minimum(width, np.arange(x1, x1 + most + 1, STEP))
        to = np.minimum(width, at + STRIP)
        hit = _last_hit(strip_sums(sums, y0, y1, at, to, False) / np.maximum(1, (to - at) * (y1 - y0)) >= DARK, allow, STEP)
        x1 = int(to[hit]) if hit >= 0 else x1
    return [x0, y0, x1, y1]


def expand_by_content(figures: DataFrame, pages: DataFrame, codec: ImageCodec, seeded: bool = False) -> DataFrame:
    """Figures (doc_id, page, ord, box, top, left, right) grown over the content of their page (doc_id, page, png).

    The boxes go to the pages, as one array a page: while these arrays are small enough to be broadcast, rasters stay where they are read. Figures of
    pages without a raster stay as they are; of several rasters of a page the first counts.

    Spark takes any raster for 100 bytes, so an inner join may broadcast them through the driver. A left join can't, and as its filter names both sides, it stays one.
    """
    up, allow = (SEED_UP, SEED_GAP) if seeded else (UP, GAP)
    held = figures.groupBy("doc_id", "page").agg(F.collect_list(F.struct("ord", *[F.col(c).cast("double").alias(c) for c in EDGES])).alias("boxes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, page, boxes, png in zip(f["doc_id"], f["page"], f["boxes"], f["png"]):
                grey = codec.grey(png)
                sums = prefix_sums(grey) if len(boxes) > MANY else grey < WHITE
                for r in boxes:
                    out.append((doc, page, r["ord"], *map(float, grown(sums, [r[c] for c in EDGES[:4]], int(r["top"]), int(r["left"]), int(r["right"]), up, allow))))
            yield pd.DataFrame(out, columns=["doc_id", "page", "ord", *[f"_{c}" for c in EDGES[:4]]])

    kinds = {c: t for c, t in figures.dtypes}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("doc_id", "page", "ord")), *(f"_{c} DOUBLE" for c in EDGES[:4])])
    both = pages.select("doc_id", "page", "png").where("png is not null").join(held, ["doc_id", "page"], "left")
    both = both.where((F.octet_length("png") + 1) * F.coalesce(F.size("boxes"), F.lit(0)) > 0)
    made = both.mapInPandas(run, schema).dropDuplicates(["doc_id", "page", "ord"])
    rows = figures.join(made, ["doc_id", "page", "ord"], "left")
    return rows.select(*[F.coalesce(f"_{c}", F.col(c).cast("double")).alias(c) if c in EDGES[:4] else F.col(c) for c in figures.columns])


def thinned(grey: np.ndarray, widest: int = PAYLOAD) -> np.ndarray:
    """An image no wider than ``widest``, by leaving out rows and columns evenly."""
    if grey.shape[1] <= widest:
        return grey
    rows = np.linspace(0, grey.shape[0] - 1, max(1, int(grey.shape[0] * widest / grey.shape[1]))).astype(int)
    return grey[rows][:, np.linspace(0, grey.shape[1] - 1, widest).astype(int)]


def payloads(content: Column, codec: ImageCodec, widest: int = PAYLOAD) -> Column:
    """An image's bytes as they are sent to a model: no wider than ``widest``. The codec's ``fit`` makes them; null where it can't read the image."""

    @pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        def one(x) -> bytes | None:
            try:
                return codec.fit(x, widest)
            except Exception:
                return None

        return data.map(one, na_action="ignore")

    return run(content)


def count_gaps(profile: np.ndarray, white: float = 0.995) -> int:
    """Runs of nearly white values, at least 2 % of the profile (and 6) long, off its outer 3 %."""
    n = len(profile)
    inner = np.asarray(profile)[int(n * 0.03) : int(n * 0.97) + 1] >= white
    edge = np.flatnonzero(np.diff(np.r_[False, inner, False]))
    return int(((edge[1::2] - edge[::2]) >= max(6, int(n * 0.02))).sum())


def count_panels(grey: np.ndarray, widest: int = 800) -> int:
    """1 to 4 panels by the white gaps between columns and between rows; wide images are thinned first."""
    grey = thinned(grey, widest)
    step = 2 if grey.shape[1] > 500 else 1
    white = grey >= WHITE
    columns, rows = white.mean(0)[::step], white.mean(1)[::step]
    return min(4, max(count_gaps(columns), count_gaps(rows)) + 1)


def panels(content: Column, codec: ImageCodec) -> Column:
    """The panel count of an image's bytes; 1 where it can't be read."""

    @pandas_udf("int")
    def run(data: pd.Series) -> pd.Series:
        def one(x) -> int:
            try:
                return count_panels(codec.grey(x))
            except Exception:
                return 1

        return data.map(one, na_action=None)

    return run(content)


def crops(figures: DataFrame, codec: ImageCodec) -> DataFrame:
    """Figures with the page's bytes (png) replaced by their own crop, in the task that holds the page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            boxes = f[["x0", "y0", "x1", "y1"]].astype(int).itertuples(index=False)
            yield f.assign(png=[codec.crop(p, tuple(b)) for p, b in zip(f["png"], boxes)])

    return figures.mapInPandas(run, figures.schema)


def gap_islands(rows: DataFrame, key: str, order: str, white: Callable[[], Column]) -> DataFrame:
    """(key, gaps): the same gap count over rows, as islands of a running sum; values are numbered from 0 per key."""
    at = Window.partitionBy(key).orderBy(order)
    n = F.count("*").over(Window.partitionBy(key))
    numbered = rows.select(key, (F.row_number().over(at) - 1).alias("i"), n.alias("n"), white().alias("white"))
    inner = numbered.where((F.col("i") >= F.floor(F.col("n") * 0.03)) & (F.col("i") <= F.floor(F.col("n") * 0.97)))
    island = F.sum(F.when(F.col("white"), 0).otherwise(1)).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    runs = inner.withColumn("island", island).where("white").groupBy(key, "island").agg(F.count("*").alias("run"), F.max("n").alias("n"))
    hits = runs.where(F.col("run") >= F.greatest(F.lit(6), F.floor(F.col("n") * 0.02))).groupBy(key).agg(F.count("*").alias("gaps"))
    return rows.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("gaps", F.lit(0)).alias("gaps"))


def prefix_sum_2d(rows: DataFrame, key: str, x: str, y: str, value: str) -> DataFrame:
    """(key, x, y, total): two-dimensional prefix sums of a dense grid per key, as two windows."""
    across = F.sum(value).over(Window.partitionBy(key, y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("line").over(Window.partitionBy(key, x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, x, y, across.alias("line")).select(key, x, y, down.alias("total"))
