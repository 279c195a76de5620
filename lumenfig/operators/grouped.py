"""Operators per page whose result depends on the order of boxes, as Arrow-based functions.

Rows are partitioned and sorted by page and streamed through in batches of whole pages, so that a call handles many pages and
memory is bounded by a batch and its last page. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfig.operators.layout import CAPTIONS, PAGE, TITLE

XY = ["x0", "y0", "x1", "y1"]


def pairwise_intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared areas of all boxes of a with all of b; rows of four coordinates."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    return np.maximum(w, 0) * np.maximum(h, 0)


def greedy_keep(boxes: np.ndarray, scores: np.ndarray, limit: float = 0.80) -> np.ndarray:
    """Which boxes stay when near-equal ones are dropped in order.

    A box met in order drops the later ones that overlap it by ``limit`` and score no better. One that scores
    better drops the box itself, which still drops the rest of its list: this isn't textbook suppression.
    """
    inter = pairwise_intersection(boxes, boxes)
    area = np.maximum(boxes[:, 2] - boxes[:, 0], 0) * np.maximum(boxes[:, 3] - boxes[:, 1], 0)
    same = np.where(inter > 0, inter / np.maximum(1e-9, area[:, None] + area[None, :] - inter), 0.0) >= limit
    alive = np.ones(len(boxes), bool)
    for i in range(len(boxes)):
        if alive[i]:
            rivals = np.flatnonzero(same[i] & alive & (np.arange(len(boxes)) > i))
            weaker = scores[rivals] <= scores[i]
            alive[rivals[weaker]] = False
            alive[i] = weaker.all()
    return alive


def uncontained_keep(boxes: np.ndarray, limit: float = 0.90) -> np.ndarray:
    """Which boxes stay when those inside a larger one are dropped, in order; a dropped box contains nothing any more."""
    area = np.maximum(1e-9, (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]))
    inside = (pairwise_intersection(boxes, boxes) / np.minimum(area[:, None], area[None, :]) >= limit) & (area[None, :] > area[:, None])
    alive = np.ones(len(boxes), bool)
    for i in range(len(boxes)):
        alive[i] = not (inside[i] & alive).any()
    return alive


def by_page(rows: DataFrame, order: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:
    """Applies ``run`` to tables of whole pages, sorted by page and order, with the first row of each page and the end."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _then_none(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            keys = pd.DataFrame({c: table.column(c).to_pandas() for c in PAGE})
            starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            whole = table.num_rows if batch is None else int(starts[-1])
            rest = None if batch is None else table.slice(whole)
            if whole:
                done = run(table.slice(0, whole), np.r_[starts[starts < whole], whole])
                yield from done.combine_chunks().to_batches()

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(stream, schema)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _matrix(table: pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(float) for c in columns], 1)


def _kept(rows: DataFrame, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        boxes, scores = _matrix(table, XY), table.column("score").to_numpy().astype(float)
        return table.filter(pa.array(np.concatenate([keep(boxes[a:b], scores[a:b]) if b - a > 1 else np.ones(1, bool) for a, b in zip(starts, starts[1:])])))

    return by_page(rows, ["ord"], run, rows.schema)


def dedup_greedy(rows: DataFrame, limit: float = 0.80) -> DataFrame:
    """Rows (doc_id, page, ord, score, box) without near-equal boxes."""
    return _kept(rows, lambda boxes, scores: greedy_keep(boxes, scores, limit))


def drop_contained(rows: DataFrame, limit: float = 0.90) -> DataFrame:
    """Rows without boxes that lie in a larger one."""
    return _kept(rows, lambda boxes, _: uncontained_keep(boxes, limit))


def unsliced(box: np.ndarray, blocks: list[tuple[np.ndarray, int, int, bool]], width: int, height: int, pad: int = 4, passes: int = 10) -> np.ndarray:
    """A box moved until it cuts through no text.

    blocks: (box, class, number of words, in a drawing), in order. A block of which more than a tenth lies inside is taken in whole if it
    may be (short, in a drawing or a caption, and no title); otherwise the box gives way at the side nearest to it, if something of it remains.
    """
    x = np.asarray(box, float).copy()
    for _ in range(passes):
        before = x.copy()
        for b, cls, words, drawn in blocks:
            area = max(1e-9, (b[2] - b[0]) * (b[3] - b[1]))
            share = max(0.0, min(x[2], b[2]) - max(x[0], b[0])) * max(0.0, min(x[3], b[3]) - max(x[1], b[1])) / area
            if share <= 0.10:
                continue
            if (words <= 45 or drawn or cls in CAPTIONS) and cls != TITLE:
                if share < 0.98:
                    x = np.r_[np.minimum(x[:2], b[:2] - pad), np.maximum(x[2:], b[2:] + pad)]
                continue
            off = (b[:2] + b[2:]) / 2 - (x[:2] + x[2:]) / 2
            axis = int(abs(off[1]) / max(1, x[3] - x[1]) > abs(off[0]) / max(1, x[2] - x[0]))
            low, high = axis, axis + 2
            if off[axis] < 0 and x[low] < b[high] + pad < x[high] and x[low] < b[high]:
                x[low] = b[high] + pad
            elif off[axis] > 0 and x[low] < b[low] - pad < x[high] and x[high] > b[low]:
                x[high] = b[low] - pad
        if (x == before).all():
            break
    return np.clip(x, 0, [width - 1, height - 1, width - 1, height - 1])


def prevent_slicing(figures: DataFrame, blocks: DataFrame, width: int, height: int) -> DataFrame:
    """Figures (doc_id, page, ord, box) moved so that they cut through no block (ord, text, cls, in_visual, box) of their page."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    own = F.struct(*[F.col(c) for c in figures.columns]).alias("fig")
    coords = [F.col(c).cast("double").alias(c) for c in XY]
    none = F.lit(None).cast(figures.select(own).schema["fig"].dataType).alias("fig")
    left = figures.select(*PAGE, "ord", F.lit(1).alias("side"), F.lit(0).alias("cls"), F.lit(0).alias("words"), F.lit(False).alias("drawn"), *coords, own)
    right = blocks.select(*PAGE, "ord", F.lit(0).alias("side"), F.col("cls").cast("int").alias("cls"), words.alias("words"), F.col("in_visual").alias("drawn"), *coords, none)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        boxes, side = _matrix(table, XY), table.column("side").to_numpy()
        cls, many, drawn = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "words", "drawn"))
        for a, b in zip(starts, starts[1:]):
            if not side[a:b].any():
                continue
            held = [(boxes[i], int(cls[i]), int(many[i]), bool(drawn[i])) for i in range(a, b) if not side[i]]
            for i in range(a, b):
                if side[i] and held:
                    boxes[i] = unsliced(boxes[i], held, width, height)
        mine = side == 1
        table, moved = table.filter(pa.array(mine)), boxes[mine]
        for i, c in enumerate(XY):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(moved[:, i]))
        return table.select([*PAGE, "ord", *XY, "fig"])

    made = by_page(left.unionByName(right), ["side", "ord"], run, left.select(*PAGE, "ord", *XY, "fig").schema)
    return made.select(*[F.col(c) if c in XY else F.col(f"fig.{c}").alias(c) for c in figures.columns])
