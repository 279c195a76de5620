"""Files written by the tasks that hold their rows."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfig.functions import text as T


def write_crops(figures: DataFrame, root: str) -> int:
    """Writes each figure's bytes (doc_id, page, id, png) to its place below a shared folder; the number of files."""
    named = figures.select("doc_id", T.crop_name(F.col("page"), F.col("id")).alias("name"), "png")
    return _written(named, root, "images")


def write_pages(pages: DataFrame, root: str) -> int:
    """Writes page rasters (doc_id, page, png), where they are wanted at all."""
    return _written(pages.select("doc_id", T.page_name(F.col("page")).alias("name"), "png"), root, "pages")


def _written(rows: DataFrame, root: str, folder: str) -> int:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, name, data in zip(f["doc_id"], f["name"], f["png"]):
                at = os.path.join(root, doc.replace("/", "_"), folder)
                os.makedirs(at, exist_ok=True)
                # Written beside and renamed, so that a task that is run again leaves whole files.
                part = os.path.join(at, f".{name}.{os.getpid()}")
                with open(part, "wb") as out:
                    out.write(data)
                os.replace(part, os.path.join(at, name))
            yield pd.DataFrame({"n": [len(f)]})

    return rows.mapInPandas(run, "n LONG").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
