"""Checks of generated descriptions and questions, as boolean columns, and the first one that fails.

Patterns keep to explicit word borders where a word may hold letters outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfig.functions import text as T

#: Words and letters taken for Spanish.
SPANISH = (
    r"(?iu)(?<![\p{L}\p{N}_])(el|la|los|las|un|una|unos|unas|de|del|que|y|en|por|para|con|sin|como|figura|figuras|muestra|muestran|curvas|puntos|"
    r"comparaci[oó]n|representa|se|es|son|entre|sobre|seg[uú]n|pero)(?![\p{L}\p{N}_])|[ñáéíóúü]"
)
#: A reference to a numbered figure, filler phrases of both kinds of description, and single-panel phrases.
FIGURE_REFERENCE = r"(?iU)\b(fig\.?|figure)\s*\d+\b"
IMAGE_FILLER = (
    r"(?i)(is presented|is shown|is depicted|shown in this figure|presented in this figure|the figure shows|this figure shows|"
    r"the figure depicts|this figure depicts|the figure illustrates|this figure illustrates)"
)
CAPTION_FILLER = (
    r"(?i)(is presented|is shown|is depicted|shown in this figure|presented in this figure|the figure shows|this figure shows|"
    r"the figure depicts|this figure depicts|the figure illustrates|this figure illustrates|an illustration depicts|an illustration illustrates|"
    r"here is the revised output|here is the rewritten output)"
)
SINGLE_PANEL = r"(?i)\b(single axis|single plot|single panel)\b"
#: General questions, questions that can't be answered from a caption, model names, and several panels.
GENERAL_QUESTION = (
    r"(?i)(what does (this|the) figure show|what is shown|what is depicted|describe (this|the) figure|summarize (this|the) figure|"
    r"what can be inferred in general|give an overview|provide an overview)"
)
BANNED_QUESTION = (
    r"(?i)(meet|intersect|cross|where do .* meet|where do .* intersect|around\s+\d{4}|approximately\s+\d{4}|at\s+around\s+\d{4}|"
    r"faster initial increase|faster increase|steeper at the start|what date is indicated|exact value|exactly how many|read the value)"
)
MODEL_NAME = r"(?i)\b(gpt[\-_]?\d(\.\d+)?|davinci[\-_]?\d*|claude[\-_]?\d|grok[\-_]?\d|o\d)\b"
SEVERAL_PANELS = r"(?i)\b(multi-?panel|two-?panel|three-?panel|four-?panel)\b"

#: Most words of a description and of a question, least of each.
MAX_DESCRIPTION, MIN_DESCRIPTION, MAX_QUESTION, MIN_QUESTION = 28, 7, 18, 6


def _t(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def looks_spanish(t: Column) -> Column:
    return _t(t).rlike(SPANISH)


def mentions_figures(t: Column) -> Column:
    return _t(t).rlike(FIGURE_REFERENCE)


def looks_generic(t: Column, with_image: bool = False) -> Column:
    """Empty, a filler phrase, or fewer than seven words; descriptions made without the image know more phrases."""
    return (T.strip(t) == "") | _t(t).rlike(IMAGE_FILLER if with_image else CAPTION_FILLER) | (T.word_count(t) < MIN_DESCRIPTION)


def stray_pipeline(t: Column, caption: Column) -> Column:
    return F.contains(F.lower(_t(t)), F.lit("pipeline")) & ~F.contains(F.lower(_t(caption)), F.lit("pipeline"))


def too_long(t: Column, most: int = MAX_DESCRIPTION) -> Column:
    return T.word_count(t) > most


def contradicts_panels(t: Column, panels: Column) -> Column:
    return (F.coalesce(panels, F.lit(0)) > 1) & _t(t).rlike(SINGLE_PANEL)


def bad_question(q: Column, caption: Column, panels: Column) -> Column:
    """Any reason to reject a question."""
    words, named = T.word_count(q), _t(q).rlike(MODEL_NAME) & ~_t(caption).rlike(MODEL_NAME)
    t = T.strip(q)
    return (
        (t == "") | ~F.endswith(t, F.lit("?")) | (words < MIN_QUESTION) | (words > MAX_QUESTION) | t.rlike(FIGURE_REFERENCE) | t.rlike(GENERAL_QUESTION) | t.rlike(BANNED_QUESTION) | named
        | ((F.coalesce(panels, F.lit(0)) == 1) & t.rlike(SEVERAL_PANELS))
    )


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, in order; null if none does."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks])


def caption_description_failure(t: Column, caption: Column) -> Column:
    """Why a description made from the caption alone is rejected."""
    return first_failure([
        ("empty", T.strip(t) == ""), ("spanish", looks_spanish(t)), ("figure reference", mentions_figures(t)), ("pipeline", stray_pipeline(t, caption)),
        ("sentences", ~T.is_one_sentence(t)), ("length", too_long(t)), ("generic", looks_generic(t)),
    ])


def image_description_failure(t: Column, panels: Column) -> Column:
    """Why a description made from caption and image is rejected; its language isn't checked."""
    return first_failure([
        ("empty", T.strip(t) == ""), ("figure reference", mentions_figures(t)), ("sentences", ~T.is_one_sentence(t)), ("length", too_long(t)),
        ("generic", looks_generic(t, with_image=True)), ("panels", contradicts_panels(t, panels)),
    ])


def questions_failure(q1: Column, q2: Column, caption: Column, panels: Column, anchors: Column) -> Column:
    """Why a pair of questions is rejected: no pair, a bad one, two alike, or one without an anchor."""
    return first_failure([
        ("no pair", q1.isNull() | q2.isNull()), ("bad", bad_question(T.with_mark(q1), caption, panels) | bad_question(T.with_mark(q2), caption, panels)), ("alike", T.too_similar(T.with_mark(q1), T.with_mark(q2))),
        ("no anchor", ~(T.has_anchor(q1, anchors) & T.has_anchor(q2, anchors))), ("empty", (T.normalize_question(q1) == "") | (T.normalize_question(q2) == "")),
    ])
