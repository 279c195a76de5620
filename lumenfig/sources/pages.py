"""Pages of documents as tables: rasters, text blocks, drawings and detected boxes. Rendering and detection are injected."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfig import schemas
from lumenfig.functions import text as T
from lumenfig.functions.geometry import DPI, POINTS
from lumenfig.operators.layout import drawings_kept


class PageParts(NamedTuple):
    """One page: raster, its size in pixels, text blocks and drawings as (x0, y0, x1, y1[, text]) in points, watermark hits."""

    page: int
    width: int
    height: int
    png: bytes
    blocks: list[tuple[float, float, float, float, str]]
    drawings: list[tuple[float, float, float, float]]
    watermarks: list[tuple[float, float, float, float]]


class Renderer(Protocol):
    """Reads a document's bytes."""

    def pages(self, content: bytes, dpi: int) -> Iterator[PageParts]: ...


class Detector(Protocol):
    """Finds layout boxes on a raster: (class, score, x0, y0, x1, y1), scores from ``least`` up."""

    def detect(self, png: bytes, size: int, least: float) -> list[tuple[int, float, float, float, float, float]]: ...


def rendered(documents: DataFrame, renderer: Renderer, dpi: int = DPI) -> DataFrame:
    """One row per page of (doc_id, content), with its blocks and drawings as arrays; a document that can't be read gives none."""
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    kind = f"{schemas.PAGE}, blocks ARRAY<struct<x0: double, y0: double, x1: double, y1: double, text: string>>, drawings ARRAY<{box}>, watermarks ARRAY<{box}>"

    def boxed(rows) -> list[dict]:
        return [dict(zip(("x0", "y0", "x1", "y1", "text"), (*[float(v) for v in r[:4]], *r[4:]))) for r in rows]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, content in zip(f["doc_id"], f["content"]):
                try:
                    pages = list(renderer.pages(content, dpi))
                except Exception:
                    continue
                for p in pages:
                    yield pd.DataFrame([{"doc_id": doc, "page": p.page, "width": p.width, "height": p.height, "png": p.png, "blocks": boxed(p.blocks), "drawings": boxed(p.drawings), "watermarks": boxed(p.watermarks)}])

    return documents.select("doc_id", "content").mapInPandas(run, kind)


def _pixels(prefix: str, dpi: int) -> list:
    return [(F.col(f"{prefix}.{c}") * (dpi / POINTS)).alias(c) for c in ("x0", "y0", "x1", "y1")]


def blocks(pages: DataFrame, dpi: int = DPI) -> DataFrame:
    """Non-empty text blocks in pixels, in order."""
    rows = pages.select("doc_id", "page", F.posexplode("blocks").alias("ord", "b"))
    return rows.select("doc_id", "page", "ord", T.clean(F.col("b.text")).alias("text"), *_pixels("b", dpi)).where("text != ''")


def drawings(pages: DataFrame, dpi: int = DPI) -> DataFrame:
    """Drawings of a middling size, in pixels; the bounds are in square points."""
    rows = pages.select("doc_id", "page", (F.col("width") * F.col("height") * (POINTS / dpi) ** 2).alias("room"), F.explode("drawings").alias("d"))
    kept = drawings_kept(rows.select("doc_id", "page", "room", "d.*"), F.col("room"))
    return kept.select("doc_id", "page", *[(F.col(c) * (dpi / POINTS)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def watermark_hits(pages: DataFrame, dpi: int = DPI) -> DataFrame:
    return pages.select("doc_id", "page", "width", F.explode("watermarks").alias("w")).select("doc_id", "page", "width", *_pixels("w", dpi))


def detected(pages: DataFrame, detector: Detector, size: int = 1280, least: float = 0.15) -> DataFrame:
    """Boxes of every page, in the detector's order; the detector is sent once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(doc, page, i, int(b[0]), *[float(v) for v in b[1:]]) for doc, page, png in zip(f["doc_id"], f["page"], f["png"]) for i, b in enumerate(detector.detect(png, size, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ord", "cls", "score", "x0", "y0", "x1", "y1"])

    return pages.select("doc_id", "page", "png").mapInPandas(run, schemas.DETECTION)
