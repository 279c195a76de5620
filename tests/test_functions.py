"""Geometry and text on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from lumenfig.functions import geometry as G
from lumenfig.functions import text as T
from lumenfig.functions import validators as V


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>", type(None): "string", bytes: "binary"}
    df = spark.range(1).select(*[F.lit(v).cast(kinds[type(v)]).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(column).first()[0]


def box(*v):
    return G.Box(*[F.lit(float(x)) for x in v])


def test_overlaps(spark):
    a, b, c = box(0, 0, 10, 10), box(5, 5, 15, 15), box(10, 0, 20, 10)
    assert one(spark, G.iou(a, b)) == pytest.approx(25 / 175)
    assert one(spark, G.iou(a, c)) == 0
    assert one(spark, G.ios(a, b)) == 0.25
    assert one(spark, G.v_overlap(a, b)) == 0.5
    assert one(spark, G.iou(a, box(5, 5, 0, 0))) == 0
    assert one(spark, G.gap_x(a, box(13, 0, 20, 1))) == 3
    assert [one(spark, v) for v in G.padded(box(3.5, 3.5, 96.2, 99), F.lit(100.0), F.lit(100.0))] == [0, 0, 99, 99]


@pytest.mark.parametrize(("said", "figure", "in_table"), [("Fig. 3: a", True, False), ("Figure S1. a", True, False), ("Fig. 3 shows a", False, False), ("Table 1: a", False, True), (None, False, False)])
def test_caption_kinds(spark, said, figure, in_table):
    assert one(spark, T.is_figure_caption(F.col("t")), t=said) is figure
    assert one(spark, T.is_table_caption(F.col("t")), t=said) is in_table


@pytest.mark.parametrize(("said", "want"), [("[12]", False), ("Fig. 2", False), ("input layer", True), ("a b c d e f g h i j k", False), ("", False)])
def test_labels(spark, said, want):
    assert one(spark, T.looks_like_label(F.col("t")), t=said) is want


@pytest.mark.parametrize(("said", "want"), [("A b.", True), ("A. B.", False), ("Uses 0.5 rate.", False), ("", False)])
def test_one_sentence(spark, said, want):
    assert one(spark, T.is_one_sentence(F.col("t")), t=said) is want


@pytest.mark.parametrize(("said", "want"), [("what x", "What x?"), ("what x?", "What x?"), ("a??", "A??"), ("", ""), (None, "")])
def test_questions(spark, said, want):
    assert one(spark, T.normalize_question(F.col("t")), t=said) == want


@pytest.mark.parametrize(("said", "want"), [('"abc"', "abc"), ("“abc”", "abc"), ('"a" and "b"', 'a" and "b'), ('""', '""'), ("\t x\u00a0y \n", "x y")])
def test_quotes(spark, said, want):
    assert one(spark, T.unquoted(F.col("t")), t=said) == want


def test_full_text(spark):
    e = F.array().cast("array<string>")
    assert one(spark, T.full_text(F.lit(" c "), F.lit(""), F.lit(None).cast("string"), e)) == "Caption: c"
    assert one(spark, T.full_text(F.lit(None).cast("string"), F.lit("d"), F.lit("e"), F.array(F.lit(" "), F.lit("q ")))) == "Description: d Description: e Questions: q"
    assert one(spark, T.full_text(F.lit(""), F.lit(""), F.lit(""), F.array(F.lit(" ")))) == "Questions: "


@pytest.mark.parametrize(
    ("path", "want", "out"),
    [("../data/X/images/p.png", "X/images/p.png", False), ("C:\\data\\X\\a.png", "X/a.png", False), ("data/X/a.png", "X/a.png", False), ("metadata/X", "X", False), ("/a/data/b/data/c", "c", False), ("//z", "z", False), ("../data/../../etc/x", "../../etc/x", True), (None, "", True)],
)
def test_paths(spark, path, want, out):
    assert one(spark, T.data_path(F.col("p")), p=path) == want
    assert one(spark, T.escapes_root(F.col("p")), p=path) is out


def test_anchors(spark):
    got = one(spark, T.anchor_terms(F.lit("The robust encoder beats the encoder of older robust-baseline models, encoder"), 3))
    assert got == ["encoder", "robust-baseline", "robust"]
    assert one(spark, T.has_anchor(F.lit("Is the baseline higher?"), F.array().cast("array<string>"))) is True
    assert one(spark, T.has_anchor(F.lit("Is it higher?"), F.array(F.lit("encoder")))) is False


def test_question_pair(spark):
    assert tuple(one(spark, T.question_pair(F.lit('x {"q1": "a", "q2": "b"} y')))) == ("a", "b")
    assert one(spark, T.question_pair(F.lit("none"))) is None
    assert one(spark, T.question_pair(F.lit(None).cast("string"))) is None


def test_rejected_questions(spark):
    ok = "How does the robust encoder change its loss?"
    assert one(spark, V.bad_question(F.lit(ok), F.lit(""), F.lit(1))) is False
    for q in ("", "How so?", "How does it vary across the figure?", ok[:-1], "What does this figure show about the loss?", "Does gpt-4 beat the older robust encoder here?", "How are the two-panel losses of it arranged?"):
        assert one(spark, V.bad_question(F.lit(q), F.lit(""), F.lit(1))) is True, q
    assert one(spark, V.bad_question(F.lit("Does gpt-4 beat the older robust encoder here?"), F.lit("GPT-4 wins"), F.lit(1))) is False


def test_similarity(spark):
    import difflib

    a, b = "What is the loss?", "what is the LOSS of x?"
    assert one(spark, T.similarity(F.lit(a), F.lit(b))) == pytest.approx(difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio())
    assert one(spark, T.similarity(F.lit(None).cast("string"), F.lit(""))) == 1.0


def test_small_ones(spark):
    assert one(spark, T.url_part(F.lit("a b/é"))) == "a%20b%2F%C3%A9"
    assert one(spark, T.data_url(F.lit(b"x" * 100), F.lit("A.JPG"))).startswith("data:image/jpeg;base64,eHh4")
    assert one(spark, T.crop_name(F.lit(3), F.lit(12))) == "p0003_figure_00012.png"
    assert one(spark, T.with_panel_prefix(F.lit("Bars show loss."), F.lit(3))) == "Three-panel bars show loss."
    assert one(spark, T.hint(F.lit("A timeline by year"))) == "Hint: timeline."
    assert one(spark, V.looks_spanish(F.lit("EL NIÑO"))) is True and one(spark, V.looks_spanish(F.lit("Selo and delta"))) is False
