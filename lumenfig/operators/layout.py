"""From boxes, text blocks and drawings of pages to captioned figure candidates: joins and aggregates per page.

Tables share the key (doc_id, page). Boxes have ord, cls, score and coordinates; blocks ord, text, cls and coordinates.
Every join has the page as its equality key, so it is a hash or sort-merge join with the geometry as a rest condition,
and pages spread over the cluster. Rows without key or coordinates join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfig.functions import text as T
from lumenfig.functions.geometry import Box, across, at_least_one, gap_x, gap_y, intersection, iou, positive, upright, v_overlap

PAGE = ["doc_id", "page"]
#: Classes of the layout detector.
TITLE, PLAIN, FIGURE, FIGURE_CAPTION, TABLE, TABLE_CAPTION, TABLE_NOTE = 0, 1, 3, 4, 5, 6, 7
CAPTIONS, TABLES = (FIGURE_CAPTION, TABLE_CAPTION, TABLE_NOTE), (TABLE, TABLE_CAPTION, TABLE_NOTE)
#: Shares of figure and caption that must overlap (strict, loose), and the gap between them in pixels.
STRICT, LOOSE, GAP = (0.35, 0.60), (0.15, 0.35), (-10, 450)
#: Text that isn't running text: addresses, links, mail.
METADATA = r"(https?://|www\.|github\.com|@|\.org|\.app|\.edu)"
MAX_CAPTION_WORDS = 150


def candidates(boxes: DataFrame, with_tables: bool = False) -> DataFrame:
    """Boxes that may be figures."""
    return boxes.where(F.col("cls").isin([FIGURE, TABLE] if with_tables else [FIGURE]))


def figure_captions(blocks: DataFrame) -> DataFrame:
    """Blocks that are captions of figures and not too long."""
    return blocks.where((F.col("cls") == FIGURE_CAPTION) & (T.word_count(F.col("text")) < MAX_CAPTION_WORDS))


def drawings_kept(drawings: DataFrame, page_area: Column) -> DataFrame:
    """Vector drawings larger than 50 square points and smaller than nearly the whole page; both bounds are strict."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return drawings.where((area > 50) & (area < 0.95 * page_area))


def watermark_edge(hits: DataFrame, page_width: Column) -> DataFrame:
    """(doc_id, edge): 15 pixels right of the widest watermark hit at the left of page 1; 0 if there is none."""
    ok = (F.col("page") == 1) & (F.col("x0") < 0.08 * page_width) & (F.col("x1") - F.col("x0") < 0.05 * page_width)
    return hits.groupBy("doc_id").agg(F.coalesce(F.max(F.when(ok, F.col("x1") + 15)), F.lit(0.0)).alias("edge"))


def _as(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Columns under a prefix, but for the page, so that names of both sides of a join don't clash."""
    return df.select(*PAGE, *[F.col(c).alias(f"{prefix}{c}") for c in [*keep, "x0", "y0", "x1", "y1"]])


def in_visual(blocks: DataFrame, visuals: DataFrame, share: float = 0.4) -> DataFrame:
    """Blocks with a flag: does some visual of the page cover more than ``share`` of the block?

    A block without area is in no visual. The visuals of a page are few, so they go along as an array and blocks stay one row each.
    """
    held = visuals.groupBy(*PAGE).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("_visuals"))
    block = Box.of()
    hit = F.exists("_visuals", lambda v: intersection(block, Box(v["x0"], v["y0"], v["x1"], v["y1"])) > share * block.area)
    return blocks.join(held, PAGE, "left").withColumn("in_visual", F.coalesce((block.area > 0) & hit, F.lit(False))).drop("_visuals")


def classify(blocks: DataFrame, page_height: Column) -> DataFrame:
    """Blocks (with in_visual) and their class: captions by how they begin; else, outside visuals, titles, headers and metadata; else plain."""
    meta = F.lower(F.coalesce("text", F.lit(""))).rlike(METADATA)
    header = (F.col("page") == 1) & (F.col("y0") < page_height * 0.22)
    margin = (F.col("y0") < page_height * 0.05) | (F.col("y1") > page_height * 0.95)
    cls = (
        F.when(T.is_figure_caption(F.col("text")), FIGURE_CAPTION)
        .when(T.is_table_caption(F.col("text")), TABLE_CAPTION)
        .when(~F.col("in_visual") & (meta | header | margin), TITLE)
        .otherwise(PLAIN)
    )
    return blocks.withColumn("cls", cls)


def caption_pairs(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """All pairs of a figure and a caption below it that overlap enough, with their tier (0 strict, 1 loose).

    Columns: doc_id, page, ord, cap_ord, tier, gap, hov_cap, hov_fig.
    """
    f, c = Box.of(), Box.of("cap_")
    pair = figures.select(*PAGE, "ord", "x0", "y0", "x1", "y1").join(_as(captions, "cap_", ["ord"]), PAGE)
    inter = across(f, c)
    fig, cap, gap = inter / at_least_one(f.w), inter / at_least_one(c.w), c.y0 - f.y1
    tier = F.when((fig >= STRICT[0]) & (cap >= STRICT[1]), 0).when((fig >= LOOSE[0]) & (cap >= LOOSE[1]), 1)
    pair = pair.select(*PAGE, "ord", "cap_ord", tier.alias("tier"), gap.alias("gap"), cap.alias("hov_cap"), fig.alias("hov_fig"))
    return pair.where(F.col("tier").isNotNull() & F.col("gap").between(*GAP))


def caption_below(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """Each figure's caption: strict before loose, then the smallest gap, the larger overlaps, and the first in order."""
    best = F.min(F.struct("tier", "gap", (-F.col("hov_cap")).alias("c"), (-F.col("hov_fig")).alias("f"), "cap_ord")).alias("best")
    pair = caption_pairs(figures, captions).groupBy(*PAGE, "ord").agg(best)
    return pair.select(*PAGE, "ord", "best.cap_ord", "best.tier", "best.gap")


def seeds_for_unmatched(captions: DataFrame, matched: DataFrame) -> DataFrame:
    """Seed boxes above captions whose text no candidate of the page has: 23 pixels high, score 0.5."""
    rest = captions.join(matched.select(*PAGE, "text").distinct(), [*PAGE, "text"], "left_anti")
    return rest.select(
        *PAGE, "ord", "text", F.lit(0.5).alias("score"), F.col("x0").cast("double").alias("x0"), positive(F.col("y0") - 25).alias("y0"), F.col("x1").cast("double").alias("x1"), positive(F.col("y0") - 2).alias("y1")
    )


def barriers(figures: DataFrame, captions: DataFrame, boxes: DataFrame, blocks: DataFrame, page_width: float, seeded: bool = False) -> DataFrame:
    """(doc_id, page, ord, top, left, right): how far each figure may grow.

    figures: ord, coordinates, and own caption as cap_x0 .. cap_y1 (null: none). blocks need text, cls and in_visual.
    Objects set limits by kind: other captions (margin 5), other figures (5), tables and their captions (12), and, unless the figure
    is a seed, large or title text (12). Without any, the page's edges hold. All objects of a page go along as one table, so
    figures meet them in one join.
    """
    f, own, o = Box.of(), Box.of("cap_"), Box.of("o_")
    fw, fh = at_least_one(f.w), at_least_one(f.h)

    def told(rows: DataFrame, kind: Column, words: Column, title: Column) -> DataFrame:
        return rows.select(*PAGE, kind.alias("o_kind"), words.alias("o_words"), title.alias("o_title"), *[F.col(c).cast("double").alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])

    no, none = F.lit(False), F.lit(0)
    of_box = F.when(F.col("cls") == FIGURE, "figure").when(F.col("cls").isin([*TABLES, *CAPTIONS]), "table")
    objects = told(captions, F.lit("caption"), none, no).unionByName(told(boxes, of_box, none, no).where("o_kind is not null"))
    if not seeded:
        objects = objects.unionByName(told(blocks.where(~F.col("in_visual")), F.lit("text"), T.word_count(F.col("text")), F.col("cls") == TITLE))
    kind = F.col("o_kind")
    not_own = F.coalesce(iou(o, own) <= 0.3, F.lit(True))
    large = (o.w / fw >= 0.45) | (F.col("o_words") >= 45) | F.col("o_title")
    near = F.when(kind == "figure", iou(o, f) <= 0.3).when(kind == "text", (o.h >= 10) & large).otherwise(not_own)
    least, margin = F.when(kind.isin("caption", "figure"), 0.1).otherwise(0.2), F.when(kind.isin("caption", "figure"), 5).otherwise(12)
    above, beside = F.when(kind == "text", 40).otherwise(120), F.when(kind == "text", 20).otherwise(8)
    hov, vov = across(f, o) / fw, F.when(kind == "caption", upright(f, o) / fh).otherwise(v_overlap(f, o))
    met = figures.select(*PAGE, "ord", "x0", "y0", "x1", "y1", *[f"cap_{c}" for c in ("x0", "y0", "x1", "y1")]).join(objects, PAGE, "left")
    got = met.groupBy(*PAGE, "ord").agg(
        F.max(F.when(near & (o.y1 <= f.y0 + above) & (hov >= least), o.y1 + margin)).alias("top"),
        F.max(F.when(near & (o.x1 <= f.x0 + beside) & (vov >= least), o.x1 + margin)).alias("left"),
        F.min(F.when(near & (o.x0 >= f.x1 - beside) & (vov >= least), o.x0 - margin)).alias("right"),
    )
    width = F.lit(float(page_width))
    return got.select(*PAGE, "ord", *[F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))).alias(c) for c in ("top", "left")], F.least(width, F.coalesce("right", width)).alias("right"))


def extended_bottom(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, ord, bottom): the lower edge, stretched over up to eight short blocks between figure and caption.

    figures: ord, coordinates and cap_y0. Blocks count in the order of their upper edges, then their own.
    """
    f, b = Box.of(), Box.of("b_")
    pair = figures.select(*PAGE, "ord", "x0", "y0", "x1", "y1", "cap_y0").join(_as(blocks, "b_", ["ord", "text"]), PAGE)
    t = T.clean(F.col("b_text"))
    ok = (b.y0 >= f.y1 - 10) & (b.y1 <= F.col("cap_y0") + 1) & (b.h <= 140) & (across(f, b) / at_least_one(f.w) >= 0.15)
    # The text of a block is looked at where its place is right, not before the join.
    ok = F.when(ok, (T.word_count(t) <= 60) & ~T.is_figure_caption(t) & ~T.is_table_caption(t))
    w = Window.partitionBy(*PAGE, "ord").orderBy("b_y0", "b_ord")
    first = pair.where(ok).withColumn("n", F.row_number().over(w)).where("n <= 8")
    low = first.groupBy(*PAGE, "ord").agg(F.max(F.col("b_y1") + 2.0).alias("low"))
    return figures.join(low, [*PAGE, "ord"], "left").select(*PAGE, "ord", F.greatest(F.col("y1").cast("double"), F.coalesce("low", F.col("y1").cast("double"))).alias("bottom"))


def label_candidates(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of a figure and a block that may be its label, but for the distance, which the fold of labels decides."""
    f, b = Box.of(), Box.of("b_")
    pair = figures.select(*PAGE, "ord", "x0", "y0", "x1", "y1").join(_as(blocks, "b_", ["ord", "text"]), PAGE)
    fw, fh = at_least_one(f.w), at_least_one(f.h)
    ok = (b.w <= 0.25 * fw) & (b.h <= 0.30 * fh) & (v_overlap(f, b) >= 0.65)
    return pair.where(F.when(ok, T.looks_like_label(F.col("b_text"))))


def with_labels(figures: DataFrame, blocks: DataFrame, near: float = 18, most: int = 3) -> DataFrame:
    """(doc_id, page, ord, x0, y0, x1, y1): each figure's box united with up to three labels, taken in order while they are near the growing box."""
    pair = label_candidates(figures, blocks)
    labels = pair.groupBy(*PAGE, "ord").agg(F.array_sort(F.collect_list(F.struct("b_ord", *[F.col(f"b_{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))).alias("labels"))
    rows = figures.join(labels, [*PAGE, "ord"], "left")
    kind = "array<struct<b_ord:int,x0:double,y0:double,x1:double,y1:double>>"
    start = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(0).alias("n"))

    def step(s, b):
        union, box = Box(s["x0"], s["y0"], s["x1"], s["y1"]), Box(b["x0"], b["y0"], b["x1"], b["y1"])
        take = (s["n"] < most) & (gap_x(union, box) <= near) & (gap_y(union, box) <= near)
        grown = F.struct(F.least(s["x0"], b["x0"]).alias("x0"), F.least(s["y0"], b["y0"]).alias("y0"), F.greatest(s["x1"], b["x1"]).alias("x1"), F.greatest(s["y1"], b["y1"]).alias("y1"), (s["n"] + 1).alias("n"))
        return F.when(take, grown).otherwise(s)

    box = F.aggregate(F.coalesce("labels", F.array().cast(kind)), start, step)
    return rows.select(*PAGE, "ord", box.alias("u")).select(*PAGE, "ord", "u.x0", "u.y0", "u.x1", "u.y1")


def merged_by_caption(rows: DataFrame) -> DataFrame:
    """Candidates of a page with the same caption, whatever its case, as one: union of boxes, best score, the first one's caption."""
    key = F.lower(T.clean(F.col("caption")))
    out = rows.groupBy(*PAGE, key.alias("key")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("score").alias("score"), F.min_by("caption", "ord").alias("caption"), F.min("ord").alias("ord")
    )
    return out.drop("key")


def numbered(rows: DataFrame) -> DataFrame:
    """Figures numbered through a document by page and order."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")))


def clipped_top(figures: DataFrame, tables: DataFrame, pad: int = 2) -> DataFrame:
    """(doc_id, page, ord, y0): the upper edge below tables that end near the figure's first top.

    figures: ord, coordinates and y0_base; tables: ord and coordinates. A table counts if it ends at most 12 pixels below that top and shares 0.22
    of the figure's width. Tables are taken in order, and each moves the edge if it reaches across the edge as the ones before left it.
    """
    f, t = Box(*[F.floor(F.col(c)) for c in ("x0", "y0", "x1", "y1")]), Box.of("t_")
    pair = figures.select(*PAGE, "ord", "x0", "y0", "x1", "y1", "y0_base").join(_as(tables, "t_", ["ord"]), PAGE)
    ok = (t.y1 <= F.col("y0_base") + 12) & (across(f, t) / at_least_one(f.w) >= 0.22) & (t.y0 < f.y1)
    held = pair.where(ok).groupBy(*PAGE, "ord").agg(F.array_sort(F.collect_list(F.struct("t_ord", F.col("t_y1").cast("double").alias("y1")))).alias("tables"))
    top = F.floor("y0").cast("double")
    moved = F.aggregate(F.coalesce("tables", F.array().cast("array<struct<t_ord:int,y1:double>>")), top, lambda y, b: F.when(b["y1"] > y, F.greatest(y, F.floor(b["y1"]).cast("double") + pad)).otherwise(y))
    return figures.join(held, [*PAGE, "ord"], "left").select(*PAGE, "ord", moved.alias("y0"))
