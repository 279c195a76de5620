"""Queries over the geometry of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfig.fakes import RawGrey, ThinGrey
from lumenfig.functions import geometry as G
from lumenfig.functions import text as T
from lumenfig.operators import extract, grouped, images, layout
from lumenfig.plans import boxes as B
from lumenfig.sources import pages
from lumenfig.sources.tables import table
from lumenfig.workdir import Workdir

KEY = ["doc_id", "page"]
_A, _C = "a", "c"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = B.boxes(spark, sf_dir).drop("text", "cls", "score")
    two = one.select(*KEY, F.col("ord").alias("ord_b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    return one.join(two, KEY).where("ord < ord_b")


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU, containment and vertical overlap of all boxes that share a page."""
    a, b = G.Box.of(), G.Box.of("b_")
    rows = _pairs(spark, sf_dir).where(G.intersection(a, b) > 0)
    return rows.select(*KEY, "ord", "ord_b", F.round(G.iou(a, b), 6).alias("iou"), F.round(G.ios(a, b), 6).alias("ios"), F.round(G.v_overlap(a, b), 6).alias("v_overlap"))


def box_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between boxes that don't touch, and the first box padded to whole pixels."""
    a, b = G.Box.of(), G.Box.of("b_")
    p = G.padded(a, F.lit(460.0), F.lit(480.0))
    rows = _pairs(spark, sf_dir).where(G.intersection(a, b) <= 0)
    return rows.select(*KEY, "ord", "ord_b", G.gap_x(a, b).alias("dx"), G.gap_y(a, b).alias("dy"), *[v.cast("double").alias(f"p{c}") for v, c in zip(p, ("x0", "y0", "x1", "y1"))], F.round(G.to_points(a.x0), 6).alias("pt"))


def detection_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping detected boxes of a page; repeated rows count once."""
    d = table(spark, sf_dir, "detection").select(*KEY, "ord", "x0", "y0", "x1", "y1").distinct()
    two = d.select(*KEY, F.col("ord").alias("ord_b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    a, b = G.Box.of(), G.Box.of("b_")
    rows = d.join(two, KEY).where((F.col("ord") < F.col("ord_b")) & (G.intersection(a, b) > 0))
    return rows.select(*KEY, "ord", "ord_b", F.round(G.intersection(a, b), 4).alias("shared"))


def candidate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes that may be figures, tables too, and large enough for a crop."""
    d = layout.candidates(table(spark, sf_dir, "detection"), with_tables=True)
    return d.where(G.large_enough(G.Box.of())).select(*KEY, "ord", "cls", "score")


def watermark_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge right of narrow boxes at the left of first pages, per document."""
    return layout.watermark_edge(table(spark, sf_dir, "detection"), F.lit(2500.0))


def drawings_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a middling size."""
    return layout.drawings_kept(table(spark, sf_dir, "detection"), F.lit(900_000.0)).select(*KEY, "ord", "cls")


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.boxes(spark, sf_dir)
    visuals = b.where(F.col("cls") == layout.FIGURE)
    return layout.classify(layout.in_visual(b.drop("cls"), visuals), F.lit(620.0))


def in_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of which a figure of the page covers more than two fifths."""
    b = B.boxes(spark, sf_dir)
    got = layout.in_visual(b, b.where(F.col("cls") == layout.FIGURE))
    return got.select(*KEY, "ord", "in_visual")


def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every text block: caption, table caption, title or plain."""
    return _text(spark, sf_dir).select(*KEY, "ord", "cls")


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.candidates(B.boxes(spark, sf_dir), with_tables=True)


def caption_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest caption below each figure, strict before loose."""
    b = B.boxes(spark, sf_dir)
    caps = b.where(F.col("cls").isin(list(layout.CAPTIONS)))
    return layout.caption_below(_figures(spark, sf_dir), caps).select(*KEY, "ord", "cap_ord", "tier", "gap")


def plan_b_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed boxes above captions whose text no matched figure of the page has."""
    b = B.boxes(spark, sf_dir)
    caps = b.where(F.col("cls").isin(list(layout.CAPTIONS)))
    got = layout.caption_below(_figures(spark, sf_dir), caps).select(*KEY, F.col("cap_ord").alias("ord"))
    matched = caps.join(got.distinct(), [*KEY, "ord"], "left_semi")
    return layout.seeds_for_unmatched(caps, matched).select(*KEY, "ord", "x0", "y0", "x1", "y1", "score")


def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each matched figure may grow to the top, left and right."""
    b = B.boxes(spark, sf_dir)
    caps = b.where(F.col("cls").isin(list(layout.CAPTIONS)))
    figs = _figures(spark, sf_dir)
    own = caps.select(*KEY, F.col("ord").alias("cap_ord"), *[F.col(c).alias(f"cap_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = figs.join(layout.caption_below(figs, caps), [*KEY, "ord"]).join(own, [*KEY, "cap_ord"])
    return layout.barriers(met, caps, b, _text(spark, sf_dir), 620.0)


def extended_bottoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower edge of each matched figure, over short text above its caption."""
    b = B.boxes(spark, sf_dir)
    caps = b.where(F.col("cls").isin(list(layout.CAPTIONS)))
    figs = _figures(spark, sf_dir)
    met = figs.join(layout.caption_below(figs, caps), [*KEY, "ord"]).join(caps.select(*KEY, F.col("ord").alias("cap_ord"), F.col("y0").alias("cap_y0")), [*KEY, "cap_ord"])
    return layout.extended_bottom(met, b)


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each figure's box with up to three labels beside it."""
    b = B.boxes(spark, sf_dir)
    small = b.withColumn("x1", F.col("x0") + 20).withColumn("y1", F.col("y0") + 15)
    return layout.with_labels(_figures(spark, sf_dir), small)


def merged_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page with the same caption, as one."""
    got = layout.merged_by_caption(B.boxes(spark, sf_dir).withColumnRenamed("text", "caption"))
    return got.select(*KEY, "ord", "x0", "y0", "x1", "y1", "score", "caption")


def figure_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures numbered through each document, with the name of their crop."""
    got = layout.numbered(_figures(spark, sf_dir))
    return got.select(*KEY, "ord", "id", T.crop_name(F.col("page"), F.col("id")).alias("name"))


def clipped_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper edge of each figure below tables that end near it."""
    b = B.boxes(spark, sf_dir)
    figs = b.where(F.col("cls") == layout.FIGURE).withColumn("y0_base", F.col("y0") + 60)
    return layout.clipped_top(figs, b.where(F.col("cls").isin(list(layout.TABLES))))


def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that stay when near-equal ones are dropped in order."""
    return grouped.dedup_greedy(B.boxes(spark, sf_dir)).select(*KEY, "ord")


def drop_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that stay when those inside a larger one are dropped in order."""
    return grouped.drop_contained(B.boxes(spark, sf_dir)).select(*KEY, "ord")


def unsliced_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures moved so that they cut through no text."""
    figs = _figures(spark, sf_dir).select(*KEY, "ord", "x0", "y0", "x1", "y1")
    return grouped.prevent_slicing(figs, _text(spark, sf_dir), 620, 620)


def _painted(b: DataFrame) -> DataFrame:
    """(doc_id, page, png): rasters of the pages that have figures and captions, dark where a figure is, and a little above and beside it."""
    import numpy as np
    import pandas as pd

    figure = F.when(F.col("cls") == layout.FIGURE, F.array("x0", "y0", "x1", "y1"))
    held = b.groupBy(*KEY).agg(F.collect_list(figure).alias("figures"), F.count_if(T.is_figure_caption(F.col("text"))).alias("captions")).where("captions > 0 and size(figures) > 0").drop("captions")

    def paint(frames):
        for f in frames:
            out = []
            for figures in f["figures"]:
                grey = np.full((620, 620), 255, np.uint8)
                for x0, y0, x1, y1 in (np.asarray(r, int) for r in figures):
                    grey[max(0, y0 - 25) : y1, max(0, x0 - 15) : x1 + 15] = 0
                out.append(ThinGrey().pack(grey))
            yield pd.DataFrame({"doc_id": f["doc_id"], "page": f["page"], "png": out})

    return held.mapInPandas(paint, "doc_id STRING, page INT, png BINARY")


def extracted_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction over all pages, with rasters of those that have figures and captions."""
    b = B.boxes(spark, sf_dir)
    rasters = Workdir(spark, "rasters").keep(_painted(b), "pages")
    return extract.figures(rasters, b.drop("text"), b.drop("cls", "score"), b.where("cls = 9").select(*KEY, "x0", "y0", "x1", "y1"), b.where("cls = 8"), 620, 620, ThinGrey())


def grown_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown over the dark content of a raster; each page's raster has its own stripe, and each box its own place in it."""
    import numpy as np
    import pandas as pd

    b = table(spark, sf_dir, "detection").where("cls = 3").select("doc_id", "page", "ord").distinct()

    def paint(frames):
        # A frame of few pages: 10,000 rasters, which a batch of keys has, would be 900 MB.
        for f in (f[i : i + 64] for f in frames for i in range(0, len(f), 64)):
            out = []
            for page in f["page"]:
                grey = np.full((300, 300), 255, np.uint8)
                grey[100 - page % 60 : 140, 120:180] = 0
                out.append(RawGrey().pack(grey))
            yield pd.DataFrame({"doc_id": f["doc_id"], "page": f["page"], "png": out})

    # The number keeps Spark from making one task of the few bytes that the keys of all rasters are.
    pages = b.select("doc_id", "page").distinct().repartition(max(8, spark.sparkContext.defaultParallelism), "doc_id", "page").mapInPandas(paint, "doc_id STRING, page INT, png BINARY")
    o = F.col("ord").cast("double")
    places = {"x0": 122 + 2 * (o % 6), "y0": 112 + o % 7, "x1": 140 + (3 * o) % 20, "y1": F.lit(138.0), "top": F.lit(0.0), "left": F.lit(0.0), "right": F.lit(300.0)}
    figs = b.select("doc_id", "page", "ord", *[v.alias(c) for c, v in places.items()])
    return images.expand_by_content(figs, pages, RawGrey()).select("doc_id", "page", "ord", "x0", "y0", "x1", "y1")


def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are captions of figures and not too long; a text of the first kind is repeated by its page, so some are."""
    said = _text(spark, sf_dir).withColumn("text", F.when(F.col("cls") == layout.FIGURE_CAPTION, F.repeat(F.concat("text", F.lit(" ")), (F.col("page") % 40).cast("int"))).otherwise(F.col("text")))
    return layout.figure_captions(said).select(*KEY, "ord", T.word_count(F.col("text")).alias("words"))


def manifest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest records of numbered figures."""
    rows = layout.numbered(_figures(spark, sf_dir)).withColumnRenamed("text", "caption")
    return extract.manifest_rows(rows, "https://papers.example.org/pdf")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a renderer gives them, of boxes in points."""
    b = B.boxes(spark, sf_dir)
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    held = F.array_sort(F.collect_list(F.struct("ord", *box, "text")))
    return b.groupBy(*KEY).agg(held.alias("held")).select(*KEY, F.lit(1500).alias("width"), F.lit(1500).alias("height"), "held", F.transform("held", lambda h: h.dropFields("ord")).alias("blocks"), F.transform("held", lambda h: h.dropFields("ord", "text")).alias("drawings"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of rendered pages, in pixels."""
    got = pages.blocks(_pages(spark, sf_dir), 144)
    return got.select(*KEY, "ord", "text", "x0", "y0", "x1", "y1")


def page_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of rendered pages that are neither tiny nor the page, in pixels."""
    return pages.drawings(_pages(spark, sf_dir), 720).select(*KEY, "x0", "y0", "x1", "y1")


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, png): a dark raster of each page with detected figures, with up to four white gaps of its own."""
    import numpy as np
    import pandas as pd

    def paint(frames):
        for f in frames:
            out = []
            for page in f["page"]:
                grey = np.zeros((100, 400), np.uint8)
                for i in range(page % 5):
                    grey[:, 60 + 70 * i : 75 + 70 * i] = 255
                out.append(RawGrey().pack(grey))
            yield pd.DataFrame({"doc_id": f["doc_id"], "page": f["page"], "png": out})

    return table(spark, sf_dir, "detection").where("cls = 3 and page is not null").select(*KEY).distinct().mapInPandas(paint, "doc_id STRING, page INT, png BINARY")


def panel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of rasters, by their white gaps, four at most."""
    return _rasters(spark, sf_dir).select(*KEY, images.panels(F.col("png"), RawGrey()).alias("panels"))


def crop_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the crops of rasters, each of a size of its own."""
    o = F.col("page") % 37
    rows = _rasters(spark, sf_dir).select(*KEY, "png", (o * 2.0).alias("x0"), (o * 1.0).alias("y0"), (o * 3.0 + 20).alias("x1"), F.lit(90.0).alias("y1"))
    return images.crops(rows, RawGrey()).select(*KEY, (F.octet_length("png") - 4).alias("pixels"))


def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long runs of large values in each user's events, as gaps between panels are counted."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    return images.gap_islands(rows.withColumn("at", F.struct("ts", "event_id")), "user_id", "at", lambda: F.col("value") >= 5.0)


def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional prefix sums over a grid of quantities per document."""
    grid = B.boxes(spark, sf_dir).groupBy("doc_id", (F.col("page") % 20).alias("x"), (F.col("ord") % 4).alias("y")).agg(F.sum(F.round(F.col("score") * 100).cast("long")).alias("v"))
    cells = grid.select("doc_id").distinct().crossJoin(spark.range(20).select(F.col("id").cast("int").alias("x"))).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("y")))
    dense = cells.join(grid, ["doc_id", "x", "y"], "left").select("doc_id", "x", "y", F.coalesce("v", F.lit(0)).alias("v"))
    return images.prefix_sum_2d(dense, "doc_id", "x", "y", "v")


QUERIES = {
    f.__name__: f
    for f in (
        box_overlaps, box_gaps, detection_overlaps, candidate_boxes, watermark_edges, drawings_kept, in_visual, classify_blocks, caption_below, plan_b_seeds, barriers, extended_bottoms, merged_labels,
        merged_captions, figure_numbers, clipped_tops, dedup_greedy, drop_contained, unsliced_boxes, extracted_figures, figure_captions, manifest_records, page_blocks, page_drawings, panel_counts, crop_sizes, grown_boxes, gap_islands, prefix_sums,
    )
}

_CAPS = "caps AS (SELECT * FROM boxes WHERE cls IN (4, 6, 7)), figs AS (SELECT * FROM boxes WHERE cls IN (3, 5))"
_SEEN = f"""
    seen AS (
        SELECT t.*, EXISTS (SELECT 1 FROM boxes v WHERE v.cls = 3 AND v.doc_id = t.doc_id AND v.page = t.page AND {B.inter("t", "v")} > 0.4 * {B.area("t")}) AS in_visual FROM boxes t
    )"""
_CLS = """
    texts AS (
        SELECT * EXCLUDE (cls), CASE WHEN regexp_matches(text, '(?i)^\\s*(Figure|Fig\\.?|Figura)\\s*[A-Za-z0-9]+[.:-]\\s+') THEN 4 WHEN regexp_matches(text, '(?i)^\\s*(Table|Tabla)\\b') THEN 6
            WHEN NOT in_visual AND (regexp_matches(lower(text), 'https?://|www\\.|github\\.com|@|\\.org|\\.app|\\.edu') OR (page = 1 AND y0 < 620 * 0.22) OR y0 < 620 * 0.05 OR y1 > 620 * 0.95) THEN 0 ELSE 1 END AS cls FROM seen
    )"""
_MET = f"""
    pairs AS (
        SELECT f.doc_id, f.page, f.ord, c.ord AS cap_ord, c.y0 - f.y1 AS gap, {B.across("f", "c")} / (f.x1 - f.x0) AS hf, {B.across("f", "c")} / (c.x1 - c.x0) AS hc
        FROM figs f JOIN caps c ON f.doc_id = c.doc_id AND f.page = c.page
    ), tiers AS (
        SELECT *, CASE WHEN hf >= 0.35 AND hc >= 0.6 THEN 0 WHEN hf >= 0.15 AND hc >= 0.35 THEN 1 END AS tier FROM pairs WHERE gap BETWEEN -10 AND 450
    ), met AS (
        SELECT * FROM tiers WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY tier, gap, -hc, -hf, cap_ord) = 1
    )"""


def _limit(source: str, test: str, v: str, least: float, margin: int, top: int = 120, side: int = 8) -> str:
    hov = f"{B.across('f', 'o')} / greatest(1, f.x1 - f.x0)"
    return f"""
        SELECT f.doc_id, f.page, f.ord, max(CASE WHEN {test} AND o.y1 <= f.y0 + {top} AND {hov} >= {least} THEN o.y1 + {margin} END) AS t,
            max(CASE WHEN {test} AND o.x1 <= f.x0 + {side} AND {v} >= {least} THEN o.x1 + {margin} END) AS l,
            min(CASE WHEN {test} AND o.x0 >= f.x1 - {side} AND {v} >= {least} THEN o.x0 - {margin} END) AS r
        FROM own f JOIN {source} o ON f.doc_id = o.doc_id AND f.page = o.page GROUP BY ALL"""


def _greedy(keep: str, drop: str) -> str:
    """A recursive walk through the boxes of each page in order, with the list of those alive."""
    return f"""
        WITH RECURSIVE {B.SQL}, pages AS (
            SELECT doc_id, page, list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, score := score, ord := ord) ORDER BY ord) AS b FROM boxes GROUP BY ALL
        ), walk AS (
            SELECT doc_id, page, b, 1 AS i, list_transform(b, lambda x: true) AS alive FROM pages
            UNION ALL
            SELECT doc_id, page, b, i + 1, CASE WHEN alive[i] THEN list_transform(generate_series(1, len(b)), lambda j: CASE WHEN j = i THEN {keep} ELSE alive[j] AND NOT ({drop}) END) ELSE alive END FROM walk WHERE i <= len(b)
        ), done AS (SELECT doc_id, page, b, alive FROM walk WHERE i = len(b) + 1)
        SELECT doc_id, page, unnest(list_transform(list_filter(b, lambda x, k: alive[k]), lambda x: x.ord)) AS ord FROM done"""


def _unsliced(s: str, b: str) -> str:
    """One block's turn: nothing, the box grown over it, or the box moved off it."""
    share = f"({B.inter(s, b)} / greatest(1e-9, {B.area(b)}))"
    off = {v: f"(({b}.{v}0 + {b}.{v}1) / 2 - ({s}.{v}0 + {s}.{v}1) / 2)" for v in "xy"}
    rest = f"words := {s}.words, cls := {s}.cls, drawn := {s}.drawn"

    def moved(**edges: str) -> str:
        return "struct_pack(" + ", ".join(f"{c} := {edges.get(c, f'{s}.{c}')}" for c in ("x0", "y0", "x1", "y1")) + f", {rest})"

    def off_it(v: str) -> str:
        low, high = f"{s}.{v}0", f"{s}.{v}1"
        return f"""CASE WHEN {off[v]} < 0 AND {low} < {b}.{v}1 + 4 AND {b}.{v}1 + 4 < {high} THEN {moved(**{f"{v}0": f"{b}.{v}1 + 4"})}
            WHEN {off[v]} > 0 AND {low} < {b}.{v}0 - 4 AND {b}.{v}0 - 4 < {high} THEN {moved(**{f"{v}1": f"{b}.{v}0 - 4"})} ELSE {s} END"""

    grown = moved(x0=f"least({s}.x0, {b}.x0 - 4)", y0=f"least({s}.y0, {b}.y0 - 4)", x1=f"greatest({s}.x1, {b}.x1 + 4)", y1=f"greatest({s}.y1, {b}.y1 + 4)")
    return f"""CASE WHEN {share} <= 0.1 THEN {s} WHEN ({b}.words <= 45 OR {b}.drawn OR {b}.cls IN (4, 6, 7)) AND {b}.cls <> 0 THEN CASE WHEN {share} < 0.98 THEN {grown} ELSE {s} END
        WHEN abs({off["y"]}) / greatest(1, {s}.y1 - {s}.y0) > abs({off["x"]}) / greatest(1, {s}.x1 - {s}.x0) THEN {off_it("y")} ELSE {off_it("x")} END"""


SQL = {
    "box_overlaps": f"""
        WITH {B.SQL} SELECT a.doc_id, a.page, a.ord, b.ord AS ord_b, round({B.iou("a", "b")}, 6) AS iou, round({B.ios("a", "b")}, 6) AS ios, round({B.v_overlap("a", "b")}, 6) AS v_overlap
        FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord < b.ord WHERE {B.inter("a", "b")} > 0""",
    "box_gaps": f"""
        WITH {B.SQL} SELECT a.doc_id, a.page, a.ord, b.ord AS ord_b, greatest(0, a.x0 - b.x1, b.x0 - a.x1) AS dx, greatest(0, a.y0 - b.y1, b.y0 - a.y1) AS dy,
            greatest(0, least(459, floor(a.x0) - 4)) AS px0, greatest(0, least(479, floor(a.y0) - 4)) AS py0, greatest(0, least(459, ceil(a.x1) + 4)) AS px1, greatest(0, least(479, ceil(a.y1) + 4)) AS py1, round(a.x0 * (72.0 / 250), 6) AS pt
        FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord < b.ord WHERE {B.inter("a", "b")} <= 0""",
    "detection_overlaps": f"""
        WITH d AS (SELECT DISTINCT doc_id, page, ord, x0, y0, x1, y1 FROM detection)
        SELECT a.doc_id, a.page, a.ord, b.ord AS ord_b, round({B.inter("a", "b")}, 4) AS shared FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord < b.ord WHERE {B.inter("a", "b")} > 0""",
    "candidate_boxes": "SELECT doc_id, page, ord, cls, score FROM detection WHERE cls IN (3, 5) AND x1 > x0 + 10 AND y1 > y0 + 10",
    "watermark_edges": "SELECT doc_id, coalesce(max(CASE WHEN page = 1 AND x0 < 200 AND x1 - x0 < 125 THEN x1 + 15 END), 0) AS edge FROM detection GROUP BY doc_id",
    "drawings_kept": "SELECT doc_id, page, ord, cls FROM detection WHERE (x1 - x0) * (y1 - y0) > 50 AND (x1 - x0) * (y1 - y0) < 0.95 * 900000",
    "in_visual": f"WITH {B.SQL}, {_SEEN} SELECT doc_id, page, ord, in_visual FROM seen",
    "classify_blocks": f"WITH {B.SQL}, {_SEEN}, {_CLS} SELECT doc_id, page, ord, cls FROM texts",
    "caption_below": f"WITH {B.SQL}, {_CAPS}, {_MET} SELECT doc_id, page, ord, cap_ord, tier, gap FROM met",
    "plan_b_seeds": f"""
        WITH {B.SQL}, {_CAPS}, {_MET}, said AS (SELECT DISTINCT c.doc_id, c.page, c.text FROM met m JOIN caps c ON c.doc_id = m.doc_id AND c.page = m.page AND c.ord = m.cap_ord)
        SELECT doc_id, page, ord, x0, greatest(0, y0 - 25) AS y0, x1, greatest(0, y0 - 2) AS y1, 0.5 AS score
        FROM caps c WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.doc_id = c.doc_id AND s.page = c.page AND s.text = c.text)""",
    "barriers": f"""
        WITH {B.SQL}, {_CAPS}, {_MET}, {_SEEN}, {_CLS},
        own AS (SELECT f.*, struct_pack(x0 := c.x0, y0 := c.y0, x1 := c.x1, y1 := c.y1) AS cap FROM figs f JOIN met m ON f.doc_id = m.doc_id AND f.page = m.page AND f.ord = m.ord JOIN caps c ON c.doc_id = m.doc_id AND c.page = m.page AND c.ord = m.cap_ord),
        limits AS (
            {_limit("caps", f"{B.iou('o', 'f.cap')} <= 0.3", f"{B.upright('f', 'o')} / greatest(1, f.y1 - f.y0)", 0.1, 5)}
            UNION ALL {_limit("boxes", f"o.cls = 3 AND {B.iou('o', 'f')} <= 0.3", B.v_overlap("f", "o"), 0.1, 5)}
            UNION ALL {_limit("boxes", f"o.cls IN (4, 5, 6, 7) AND {B.iou('o', 'f.cap')} <= 0.3", B.v_overlap("f", "o"), 0.2, 12)}
            UNION ALL {_limit("texts", "o.y1 - o.y0 >= 10 AND NOT o.in_visual AND ((o.x1 - o.x0) / greatest(1, f.x1 - f.x0) >= 0.45 OR len(regexp_extract_all(o.text, '\\S+')) >= 45 OR o.cls = 0)", B.v_overlap("f", "o"), 0.2, 12, 40, 20)}
        )
        SELECT doc_id, page, ord, greatest(0, coalesce(max(t), 0)) AS top, greatest(0, coalesce(max(l), 0)) AS "left", least(620, coalesce(min(r), 620)) AS "right" FROM limits GROUP BY ALL""",
    "extended_bottoms": f"""
        WITH {B.SQL}, {_CAPS}, {_MET}, fit AS (
            SELECT f.doc_id, f.page, f.ord, b.y1, row_number() OVER (PARTITION BY f.doc_id, f.page, f.ord ORDER BY b.y0, b.ord) AS n
            FROM figs f JOIN met m ON f.doc_id = m.doc_id AND f.page = m.page AND f.ord = m.ord JOIN caps c ON c.doc_id = m.doc_id AND c.page = m.page AND c.ord = m.cap_ord JOIN boxes b ON b.doc_id = f.doc_id AND b.page = f.page
            WHERE b.y0 >= f.y1 - 10 AND b.y1 <= c.y0 + 1 AND b.y1 - b.y0 <= 140 AND len(regexp_extract_all(b.text, '\\S+')) <= 60 AND {B.across("f", "b")} / (f.x1 - f.x0) >= 0.15
                AND NOT regexp_matches(b.text, '(?i)^\\s*(Figure|Fig\\.?|Figura)\\s*[A-Za-z0-9]+[.:-]\\s+') AND NOT regexp_matches(b.text, '(?i)^\\s*(Table|Tabla)\\b')
        )
        SELECT f.doc_id, f.page, f.ord, greatest(f.y1, coalesce((SELECT max(y1) + 2 FROM fit x WHERE x.doc_id = f.doc_id AND x.page = f.page AND x.ord = f.ord AND n <= 8), f.y1)) AS bottom
        FROM figs f JOIN met m ON f.doc_id = m.doc_id AND f.page = m.page AND f.ord = m.ord""",
    "merged_labels": f"""
        WITH {B.SQL}, {_CAPS}, small AS (SELECT doc_id, page, ord, x0, y0, x0 + 20 AS x1, y0 + 15 AS y1, text FROM boxes),
        near AS (
            SELECT f.doc_id, f.page, f.ord, list(struct_pack(x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1) ORDER BY b.ord) AS labels FROM figs f JOIN small b ON f.doc_id = b.doc_id AND f.page = b.page
            WHERE 20 <= 0.25 * (f.x1 - f.x0) AND 15 <= 0.3 * (f.y1 - f.y0) AND {B.v_overlap("f", "b")} >= 0.65 AND len(regexp_extract_all(b.text, '\\S+')) <= 10 AND NOT regexp_matches(lower(b.text), '^(figure|fig\\.|fig |table|tabla)') AND NOT regexp_matches(b.text, '^\\[[0-9]+\\]$') GROUP BY ALL
        )
        SELECT doc_id, page, ord, u.x0 AS x0, u.y0 AS y0, u.x1 AS x1, u.y1 AS y1 FROM (
            SELECT f.doc_id, f.page, f.ord, list_reduce(coalesce(n.labels, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]).list_transform(lambda l: struct_pack(x0 := l.x0, y0 := l.y0, x1 := l.x1, y1 := l.y1, n := 0)), lambda s, b:
                CASE WHEN s.n < 3 AND greatest(0, s.x0 - b.x1, b.x0 - s.x1) <= 18 AND greatest(0, s.y0 - b.y1, b.y0 - s.y1) <= 18
                THEN struct_pack(x0 := least(s.x0, b.x0), y0 := least(s.y0, b.y0), x1 := greatest(s.x1, b.x1), y1 := greatest(s.y1, b.y1), n := s.n + 1) ELSE s END, struct_pack(x0 := f.x0, y0 := f.y0, x1 := f.x1, y1 := f.y1, n := 0)) AS u
            FROM figs f LEFT JOIN near n ON f.doc_id = n.doc_id AND f.page = n.page AND f.ord = n.ord)""",
    "merged_captions": f"""
        WITH {B.SQL} SELECT doc_id, page, min(ord) AS ord, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(score) AS score, min_by(text, ord) AS caption
        FROM boxes GROUP BY doc_id, page, lower(text)""",
    "figure_numbers": f"""
        WITH {B.SQL}, {_CAPS}, n AS (SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS id FROM figs)
        SELECT doc_id, page, ord, id, printf('p%04d_figure_%05d.png', page, CAST(id AS INTEGER)) AS name FROM n""",
    "clipped_tops": f"""
        WITH {B.SQL}, f AS (SELECT *, y0 + 60 AS base FROM boxes WHERE cls = 3),
        near AS (
            SELECT f.doc_id, f.page, f.ord, list(t.y1 ORDER BY t.ord) AS ends FROM f JOIN boxes t ON t.doc_id = f.doc_id AND t.page = f.page
            WHERE t.cls IN (5, 6, 7) AND t.y1 <= f.base + 12 AND {B.across("f", "t")} / (f.x1 - f.x0) >= 0.22 AND t.y0 < f.y1 GROUP BY ALL
        )
        SELECT f.doc_id, f.page, f.ord, list_reduce(coalesce(n.ends, []::DOUBLE[]), lambda y, e: CASE WHEN e > y THEN greatest(y, floor(e) + 2) ELSE y END, f.y0) AS y0
        FROM f LEFT JOIN near n ON n.doc_id = f.doc_id AND n.page = f.page AND n.ord = f.ord""",
    "dedup_greedy": _greedy(
        f"NOT coalesce(list_bool_or(list_transform(generate_series(i + 1, len(b)), lambda k: alive[k] AND {B.iou('b[i]', 'b[k]')} >= 0.8 AND b[k].score > b[i].score)), false)",
        f"j > i AND {B.iou('b[i]', 'b[j]')} >= 0.8 AND b[j].score <= b[i].score",
    ),
    "drop_contained": _greedy(
        f"NOT coalesce(list_bool_or(list_transform(generate_series(1, len(b)), lambda k: k <> i AND alive[k] AND {B.area('b[k]')} > {B.area('b[i]')} AND {B.ios('b[i]', 'b[k]')} >= 0.9)), false)", "false"
    ),
    "unsliced_boxes": f"""
        WITH RECURSIVE {B.SQL}, {_CAPS}, {_SEEN}, {_CLS},
        held AS (SELECT doc_id, page, list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, words := len(regexp_extract_all(text, '\\S+')), cls := cls, drawn := in_visual) ORDER BY ord) AS blocks FROM texts GROUP BY ALL),
        start AS (SELECT f.doc_id, f.page, f.ord, h.blocks, struct_pack(x0 := f.x0, y0 := f.y0, x1 := f.x1, y1 := f.y1, words := CAST(0 AS BIGINT), cls := 0, drawn := false) AS x FROM figs f JOIN held h USING (doc_id, page)),
        walk AS (
            SELECT doc_id, page, ord, blocks, x, x AS before, 0 AS turn FROM start
            UNION ALL
            SELECT doc_id, page, ord, blocks, list_reduce(blocks, lambda s, b: {_unsliced("s", "b")}, x), x, turn + 1 FROM walk WHERE turn < 10 AND (turn = 0 OR x <> before)
        ), last AS (SELECT doc_id, page, ord, arg_max(x, turn) AS x FROM walk GROUP BY ALL)
        SELECT doc_id, page, ord, {", ".join(f"greatest(0, least(619, x.{c})) AS {c}" for c in ("x0", "y0", "x1", "y1"))} FROM last""",
    "figure_captions": f"""
        WITH {B.SQL}, {_SEEN}, {_CLS}, n AS (SELECT doc_id, page, ord, len(regexp_extract_all(text, '\\S+')) * (page % 40) AS words FROM texts WHERE cls = 4) SELECT * FROM n WHERE words < 150""",
    "manifest_records": f"""
        WITH {B.SQL}, {_CAPS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS id FROM figs)
        SELECT id, doc_id, '../pdfs/' || doc_id || '.pdf' AS source_pdf, 'https://papers.example.org/pdf/' || doc_id || '.pdf' AS source_pdf_url, page,
            '../data/' || doc_id || '/images/' || printf('p%04d_figure_%05d.png', page, CAST(id AS INTEGER)) AS image_path, text AS caption, CAST(NULL AS VARCHAR) AS md5 FROM n""",
    "page_blocks": f"WITH {B.SQL} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS INTEGER) AS ord, trim(text) AS text, x0 * 2 AS x0, y0 * 2 AS y0, x1 * 2 AS x1, y1 * 2 AS y1 FROM boxes",
    "page_drawings": f"WITH {B.SQL} SELECT doc_id, page, x0 * 10 AS x0, y0 * 10 AS y0, x1 * 10 AS x1, y1 * 10 AS y1 FROM boxes WHERE (x1 - x0) * (y1 - y0) > 50 AND (x1 - x0) * (y1 - y0) < 0.95 * 22500",
    "panel_counts": "SELECT DISTINCT doc_id, page, least(4, page % 5 + 1) AS panels FROM detection WHERE cls = 3 AND page IS NOT NULL",
    "crop_sizes": "SELECT DISTINCT doc_id, page, (page % 37 + 20) * (90 - page % 37) AS pixels FROM detection WHERE cls = 3 AND page IS NOT NULL",
    "grown_boxes": """
        WITH b AS (SELECT DISTINCT doc_id, page, ord, 112.0 + 2 * (ord % 6) AS x, 102.0 + ord % 7 AS y, 140.0 + (3 * ord) % 20 AS r, 91 - page % 60 AS dark FROM detection WHERE cls = 3)
        SELECT doc_id, page, ord, CAST(x - 4 * floor((x - 111) / 4) AS DOUBLE) AS x0, CAST(y - 4 * floor((y - dark) / 4) AS DOUBLE) AS y0, CAST(r + 4 * floor((179 - r) / 4) + 10 AS DOUBLE) AS x1, CAST(138 AS DOUBLE) AS y1 FROM b""",
    "gap_islands": """
        WITH e AS (SELECT user_id, value >= 5.0 AS white, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
        s AS (SELECT *, sum(CASE WHEN white THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM e WHERE i >= floor(n * 0.03) AND i <= floor(n * 0.97)),
        r AS (SELECT user_id, island, count(*) AS run, max(n) AS n FROM s WHERE white GROUP BY ALL)
        SELECT u.user_id, CAST(count(r.user_id) AS BIGINT) AS gaps FROM (SELECT DISTINCT user_id FROM events WHERE value IS NOT NULL) u LEFT JOIN r ON r.user_id IS NOT DISTINCT FROM u.user_id AND r.run >= greatest(6, floor(r.n * 0.02)) GROUP BY u.user_id""",
    "prefix_sums": f"""
        WITH {B.SQL}, grid AS (SELECT doc_id, page % 20 AS x, ord % 4 AS y, sum(CAST(score * 100 AS BIGINT)) AS v FROM boxes GROUP BY ALL),
        dense AS (SELECT d.doc_id, CAST(x.x AS INTEGER) AS x, CAST(y.y AS INTEGER) AS y, coalesce(g.v, 0) AS v FROM (SELECT DISTINCT doc_id FROM boxes) d CROSS JOIN range(20) x(x) CROSS JOIN range(4) y(y) LEFT JOIN grid g ON g.doc_id = d.doc_id AND g.x = x.x AND g.y = y.y)
        SELECT a.doc_id, a.x, a.y, CAST(sum(b.v) AS BIGINT) AS total FROM dense a JOIN dense b ON a.doc_id = b.doc_id AND b.x <= a.x AND b.y <= a.y GROUP BY ALL""",
}
