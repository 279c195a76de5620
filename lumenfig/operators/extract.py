"""The extraction of figures from pages, as one plan over detected boxes, text blocks and drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfig.functions import text as T
from lumenfig.functions.geometry import Box, clamp, cut_above, padded
from lumenfig.operators import grouped, images, layout
from lumenfig.operators.layout import PAGE
from lumenfig.workdir import Workdir

XY = ["x0", "y0", "x1", "y1"]


def _finished(work: Workdir, figures: DataFrame, pages: DataFrame, boxes: DataFrame, text: DataFrame, codec: images.ImageCodec | None, width: int, height: int, seeded: bool) -> DataFrame:
    """Barriers, growth over content, the cut above the caption, the clip below tables, and no text sliced. Objects of pages without figures are left out first."""
    name, on = "seeded" if seeded else "found", figures.select(*PAGE).distinct()
    boxes, text = (work.keep(rows.join(on, PAGE, "left_semi"), f"{kind}_{name}") for kind, rows in (("boxes", boxes), ("text", text)))
    captions = layout.figure_captions(text)
    limits = layout.barriers(figures, captions, boxes, text, width, seeded)
    rows = figures.join(limits, [*PAGE, "ord"]).withColumn("y0_base", F.col("y0")).withColumn("left", F.greatest("left", "edge"))
    if codec is not None:
        rows = work.keep(images.expand_by_content(rows, pages, codec, seeded), f"grown_{name}")  # the clip reads it twice
    rows = rows.withColumn("y1", clamp(cut_above(F.col("y1"), F.floor("cap_y0")), 0.0, float(height - 1)).cast("double"))
    tables = boxes.where(F.col("cls").isin(list(layout.TABLES)))
    rows = rows.drop("top", "left", "right")
    rows = rows.drop("y0").join(layout.clipped_top(rows, tables), [*PAGE, "ord"])
    rows = rows.select(*PAGE, "ord", "score", "caption", *XY)
    rows = grouped.prevent_slicing(rows, text, width, height)
    return rows.where((F.col("x1") > F.col("x0") + 10) & (F.col("y1") > F.col("y0") + (30 if seeded else 10)))


def figures(pages: DataFrame, boxes: DataFrame, blocks: DataFrame, drawings: DataFrame, watermarks: DataFrame, width: int, height: int, codec: images.ImageCodec | None = None) -> DataFrame:
    """(doc_id, page, id, score, caption, box): the numbered figures of documents whose pages have one size.

    Candidates of the detector come first, then seeds above captions that none of them has; candidates with one caption are merged, near-equal
    ones dropped, then contained ones, and the rest is numbered through each document. Stages are written to the shared folder, which
    keeps each plan small and what is used twice from being made twice.
    """
    work = Workdir(boxes.sparkSession, "extract")
    boxes = work.keep(boxes, "boxes")
    figs = layout.candidates(boxes)
    visuals = drawings.select(*PAGE, *XY).unionByName(figs.select(*PAGE, *XY))
    text = layout.classify(layout.in_visual(blocks, visuals), F.lit(float(height)))
    drawn = work.keep(layout.in_visual(text.drop("in_visual"), drawings), "text")
    edge = layout.watermark_edge(watermarks, F.lit(float(width)))
    captions = layout.figure_captions(drawn)
    cap = captions.select(*PAGE, F.col("ord").alias("cap_ord"), F.col("text").alias("caption"), *[F.col(c).alias(f"cap_{c}") for c in XY])
    figs = figs.join(captions.select(*PAGE).distinct(), PAGE, "left_semi")
    wide = work.keep(figs.select(*PAGE, "ord", "score").join(layout.with_labels(figs, drawn), [*PAGE, "ord"]), "wide")
    met = wide.join(layout.caption_below(wide, captions), [*PAGE, "ord"]).join(cap, [*PAGE, "cap_ord"])
    met = work.keep(met.where(T.is_figure_caption(F.col("caption")) & ~T.is_table_caption(F.col("caption"))), "met")
    met = met.join(layout.extended_bottom(met, drawn), [*PAGE, "ord"]).withColumn("y1", F.least("bottom", F.col("cap_y0") - 2.0)).drop("bottom")
    met = met.join(edge, "doc_id", "left").withColumn("edge", F.when(F.col("page") == 1, F.coalesce("edge", F.lit(0.0))).otherwise(0.0))
    box = padded(Box.of(), F.lit(float(width)), F.lit(float(height)), left=F.col("edge"))
    met = met.select(*PAGE, "ord", "score", "caption", "edge", *[F.col(f"cap_{c}") for c in XY], *[v.cast("double").alias(c) for v, c in zip(box, XY)])
    met = met.where((F.col("x1") > F.col("x0") + 10) & (F.col("y1") > F.col("y0") + 10))
    met = work.keep(met, "boxed")
    first = work.keep(_finished(work, met, pages, boxes, drawn, codec, width, height, False), "first")
    seeds = layout.seeds_for_unmatched(captions, first.select(*PAGE, F.col("caption").alias("text")))
    seeds = seeds.withColumnRenamed("ord", "cap_ord").withColumnRenamed("text", "caption").join(cap.drop("caption"), [*PAGE, "cap_ord"])
    seeds = seeds.join(edge, "doc_id", "left").withColumn("edge", F.when(F.col("page") == 1, F.coalesce("edge", F.lit(0.0))).otherwise(0.0))
    seeds = seeds.withColumn("x0", F.greatest("x0", "edge")).withColumn("ord", F.col("cap_ord") + 1_000_000).drop("cap_ord")
    seeds = work.keep(seeds, "seeds")
    more = _finished(work, seeds, pages, boxes, drawn, codec, width, height, True)
    merged = layout.merged_by_caption(first.unionByName(more))
    kept = grouped.drop_contained(grouped.dedup_greedy(merged))
    return layout.numbered(kept).select(*PAGE, "id", "score", "caption", *XY)


def manifest_rows(rows: DataFrame, url_base: str, data_root: str = "../data", pdf_root: str = "../pdfs") -> DataFrame:
    """Manifest records of numbered figures; boxes and scores are dropped, md5 is there if the crops (png) are."""
    path = F.concat(F.lit(f"{data_root}/"), F.col("doc_id"), F.lit("/images/"), T.crop_name(F.col("page"), F.col("id")))
    return rows.select(
        "id", "doc_id", F.concat(F.lit(f"{pdf_root}/"), F.col("doc_id"), F.lit(".pdf")).alias("source_pdf"), T.paper_url(F.col("doc_id"), url_base).alias("source_pdf_url"), "page",
        path.alias("image_path"), "caption", (F.md5("png") if "png" in rows.columns else F.lit(None).cast("string")).alias("md5"),
    )
