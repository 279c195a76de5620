"""Text of captions, descriptions and questions as columns, inside the JVM.

Null is treated as empty text unless a function says otherwise. White space is Unicode's.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: How captions and labels begin.
FIGURE_CAPTION = r"(?i)^\s*(?:Figure|Fig\.?|Figura)\s*[A-Za-z0-9]+[\.\:\-]\s+"
TABLE_CAPTION = r"(?iU)^\s*(?:Table|Tabla)\b"
LABEL_STARTS = ("figure", "fig.", "fig ", "table", "tabla")
META_PREFIX = r"(?i)^(here is (the )?(revised|rewritten) output:\s*|revised output:\s*|rewritten output:\s*|output:\s*)"
#: Words that don't anchor a question, and substrings that always do.
STOP_WORDS = (
    "a an the and or of to in on for with by from into over under between across as at is are was were be being been "
    "this that these those it its their his her our your show shows shown depict depicts depicted illustrate illustrates "
    "illustrated present presents presented figure panel panels plot chart graph"
).split()
ALWAYS_ANCHOR = ("curve", "line", "threshold", "inflection")
#: Caption keywords and the hint each group gives, in order.
HINTS = [
    (("taxonomy", "categorize", "categorise"), "Hint: taxonomy diagram."),
    (("chronological", "timeline", "evolution", "from 201", "to 202"), "Hint: timeline."),
    (("pipeline", "framework", "workflow", "stages"), "Hint: pipeline/workflow diagram."),
    (("error bars", "confidence interval", "95%"), "Hint: plot with error bars."),
    (("by ", "over ", "versus", "vs", "projected", "incidence", "degradation", "interactions"), "Hint: line chart or comparative plot."),
]
OTHER_HINT = "Hint: scientific figure."
#: Caption keywords, whether the figure type counts too, and the two questions they give, in order.
FALLBACKS = [
    (("timeline", "over time", "evolution", "trend"), False, "What main topic or process is represented over time in the figure?", "What overall trend or progression is shown across the figure?"),
    (("taxonomy", "category", "categories"), True, "What main concept is organized in the figure?", "How are the main categories structured in the figure?"),
    (("pipeline", "workflow", "framework", "architecture"), True, "What main objective or task does the figure describe?", "How is the overall pipeline or architecture organized in the figure?"),
    ((), False, "What main idea or comparison does the figure present?", "What overall structure or pattern is shown in the figure?"),
]
#: Panel counts and the prefix each gives.
PANELS = {2: "Two-panel", 3: "Three-panel", 4: "Four-panel"}


def _text(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def strip(t: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_text(t), r"(?U)^\s+|\s+$", "")


def clean(t: Column) -> Column:
    """White space collapsed and trimmed."""
    return strip(F.regexp_replace(_text(t), r"(?U)\s+", " "))


def unquoted(t: Column) -> Column:
    """Clean text without one pair of outer double quotes."""
    return strip(F.regexp_replace(clean(t), '^(["“”])(.+)(["“”])$', "$2"))


def model_output(t: Column) -> Column:
    """Unquoted text without the preamble that a model puts before its answer."""
    return strip(F.regexp_replace(unquoted(t), META_PREFIX, ""))


def word_count(t: Column) -> Column:
    return F.regexp_count(_text(t), F.lit(r"(?U)\S+"))


def is_one_sentence(t: Column) -> Column:
    """Exactly one non-blank stretch between full stops, exclamation and question marks; a decimal point divides too."""
    return F.size(F.filter(F.split(_text(t), r"[.!?]+"), lambda p: F.length(strip(p)) > 0)) == 1


def full_text(caption: Column, description2: Column, description3: Column, questions: Column) -> Column:
    """The text that is embedded: labelled parts, empty ones left out; a list of blank questions keeps its label."""
    asked = F.filter(F.transform(F.coalesce(questions, F.array().cast("array<string>")), strip), lambda q: q != "")
    return F.concat_ws(
        " ",
        *[F.when(strip(c) != "", F.concat(F.lit(label), strip(c))) for label, c in (("Caption: ", caption), ("Description: ", description2), ("Description: ", description3))],
        F.when(F.size(F.coalesce(questions, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Questions: "), F.concat_ws(" | ", asked))),
    )


def anchor_words(caption: Column) -> Column:
    """Words of four letters or more that may anchor a question, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(_text(caption)), F.lit(r"([a-z][a-z\-]{3,})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def anchor_terms(caption: Column, k: int = 10) -> Column:
    """The k most frequent anchor words, longer ones first among equals, then first come; as an array of distinct words."""

    def top(words: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(words),
            lambda w: F.struct(
                (F.size(F.array_remove(words, w)) - F.size(words)).alias("n"), (-F.length(w)).alias("l"), F.array_position(words, w).alias("p"), w.alias("w")
            ),
        )
        return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda r: r["w"])

    # The words are bound by a lambda, so that they are found once a row and not once for each of them.
    return F.transform(F.array(anchor_words(caption)), top)[0]


def has_anchor(question: Column, anchors: Column) -> Column:
    q = F.lower(_text(question))
    fixed = F.lit(False)
    for w in ALWAYS_ANCHOR:
        fixed = fixed | F.contains(q, F.lit(w))
    return F.exists(anchors, lambda a: F.contains(q, a)) | fixed


def normalize_question(q: Column) -> Column:
    """Clean, first letter large, exactly one question mark more than the text had after the last."""
    t = unquoted(q)
    bare = F.when(F.endswith(t, F.lit("?")), strip(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)
    return F.when(t == "", F.lit("")).otherwise(F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)), F.lit("?")))


def with_mark(q: Column) -> Column:
    return F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?")))


def question_pair(answer: Column) -> Column:
    """struct(q1, q2) of a model's JSON answer: the whole text, else its outermost braces; null if neither parses."""
    schema = "q1 STRING, q2 STRING, _bad STRING"
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    whole = F.from_json(_text(answer), schema, opts)
    inner = F.from_json(F.regexp_extract(_text(answer), r"(?s)\{.*\}", 0), schema, opts)

    def good(x: Column, text: Column) -> Column:
        return x["_bad"].isNull() & F.startswith(strip(text), F.lit("{"))

    picked = F.when(good(whole, _text(answer)), whole).when(good(inner, F.regexp_extract(_text(answer), r"(?s)\{.*\}", 0)), inner)
    return F.when(picked.isNotNull(), F.struct(unquoted(picked["q1"]).alias("q1"), unquoted(picked["q2"]).alias("q2")))


def looks_like_label(t: Column) -> Column:
    """Text short enough to be a label in a figure, and no caption or citation."""
    c = clean(t)
    opens = F.lit(False)
    for s in LABEL_STARTS:
        opens = opens | F.startswith(F.lower(c), F.lit(s))
    return (c != "") & ~opens & (word_count(c) <= 10) & ~c.rlike(r"^\[\d+\]$")


def is_figure_caption(t: Column) -> Column:
    return _text(t).rlike(FIGURE_CAPTION)


def is_table_caption(t: Column) -> Column:
    return _text(t).rlike(TABLE_CAPTION)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def hint(caption: Column) -> Column:
    """The kind of figure that a caption suggests."""
    c = F.lower(_text(caption))
    out = F.when(_any(c, HINTS[0][0]), F.lit(HINTS[0][1]))
    for parts, said in HINTS[1:]:
        out = out.when(_any(c, parts), F.lit(said))
    return out.otherwise(F.lit(OTHER_HINT))


def fallback_questions(caption: Column, figure_type: Column | None = None) -> Column:
    """Two general questions by the caption's keywords (and the figure type's, for the middle groups)."""
    c, t = strip(F.lower(_text(caption))), strip(F.lower(_text(figure_type))) if figure_type is not None else F.lit("")
    out = None
    for parts, typed, q1, q2 in FALLBACKS[:-1]:
        hit = _any(c, parts) | _any(t, parts) if typed else _any(c, parts)
        pair = F.array(F.lit(q1), F.lit(q2))
        out = F.when(hit, pair) if out is None else out.when(hit, pair)
    return out.otherwise(F.array(F.lit(FALLBACKS[-1][2]), F.lit(FALLBACKS[-1][3])))


def panel_prefix(panels: Column) -> Column:
    out = F.lit("")
    for n, said in PANELS.items():
        out = F.when(panels == n, F.lit(said)).otherwise(out)
    return out


def with_panel_prefix(t: Column, panels: Column) -> Column:
    """Text that names its panels first, if there are several and it doesn't yet."""
    prefix = panel_prefix(panels)
    said = F.concat(prefix, F.lit(" "), F.lower(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    return F.when((panels > 1) & (prefix != "") & (t != "") & ~F.startswith(F.lower(t), F.lower(prefix)), said).otherwise(t)


def to_posix(path: Column) -> Column:
    return F.replace(_text(path), F.lit("\\"), F.lit("/"))


def data_path(path: Column) -> Column:
    """What follows the last ``/data/`` (or ``data/``) of a path in either notation, without leading slashes."""
    p = to_posix(path)
    rest = (
        F.when(F.contains(p, F.lit("/data/")), F.substring_index(p, "/data/", -1)).when(F.contains(p, F.lit("data/")), F.substring_index(p, "data/", -1)).otherwise(p)
    )
    return F.regexp_replace(rest, "^/+", "")


def image_url(path: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}/images/"), data_path(path))


def escapes_root(path: Column) -> Column:
    """True if a cleaned path leaves its root; such paths are not served."""
    return F.exists(F.split(data_path(path), "/"), lambda s: s == "..") | data_path(path).isin("", ".")


def figure_key(doc_id: Column, number: Column) -> Column:
    return F.concat_ws("_", doc_id, number)


def paper_url(doc_id: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/"), doc_id, F.lit(".pdf"))


def crop_name(page: Column, number: Column) -> Column:
    return F.format_string("p%04d_figure_%05d.png", page.cast("int"), number.cast("int"))


def page_name(page: Column) -> Column:
    return F.format_string("page_%04d.png", page.cast("int"))


def short_caption(t: Column, size: int = 120) -> Column:
    return F.concat(F.left(_text(t), F.lit(size)), F.lit("..."))


def percent(score: Column) -> Column:
    return F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))


def asked_as(topic: Column, prefix: str = "show me an image about ") -> Column:
    """A topic as the query that is embedded and stored with votes."""
    return F.concat(F.lit(prefix), topic)


def url_part(t: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))


def iso_local(ts: Column) -> Column:
    """A zone-free time stamp as text; the fraction is left out if it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat_ws(".", whole, part))


def data_url(content: Column, path: Column) -> Column:
    """An image's bytes as a data URL; jpg becomes jpeg, unknown endings png."""
    end = F.lower(F.regexp_extract(_text(path), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(end.isin("jpg", "jpeg"), "jpeg").when(end.isin("png", "webp", "gif"), end).otherwise("png")
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, in either case; no built-in function is equivalent."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)])


def too_similar(a: Column, b: Column, limit: float = 0.82) -> Column:
    return similarity(a, b) >= limit
