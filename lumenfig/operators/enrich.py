"""Generated descriptions and questions: prompts, attempts with checks and repair, and what is kept when all fail.

The attempts are columns of one plan: each asks the model only for rows whose last answer failed, and the
checks between them are the built-in columns of the validators. A model is any object with ``complete``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lumenfig.functions import text as T
from lumenfig.functions import validators as V
from lumenfig.workdir import Workdir

#: The questions of a record without caption.
NO_CAPTION = ("What main idea does the figure present?", "What overall structure or pattern is shown in the figure?")
#: Answers of a service after which it is asked again, and how often.
RETRY_ON, RETRIES, PAUSE = {403, 429, *range(500, 600)}, 6, 2.5
#: Answers that mean that a request's form isn't understood.
MALFORMED = {400, 422}


class ServiceError(Exception):
    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


class Model(Protocol):
    """A language model, with or without images."""

    def complete(self, prompt: str, image: bytes | None) -> str: ...


class Patient:
    """A model that is asked again, after a linearly longer pause, when its service is busy; other errors pass."""

    def __init__(self, model: Model, tries: int = RETRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> None:
        self.model, self.tries, self.pause, self.sleep = model, tries, pause, sleep

    def complete(self, prompt: str, image: bytes | None) -> str:
        for i in range(self.tries):
            try:
                return self.model.complete(prompt, image)
            except ServiceError as e:
                if e.status not in RETRY_ON or i + 1 == self.tries:
                    raise
                self.sleep(self.pause * (i + 1))
        raise AssertionError("unreachable")


class TwoForms:
    """A model with two forms of one request: what the first refuses as malformed is sent in the second."""

    def __init__(self, first: Model, second: Model) -> None:
        self.first, self.second = first, second

    def complete(self, prompt: str, image: bytes | None) -> str:
        try:
            return self.first.complete(prompt, image)
        except ServiceError as e:
            if e.status not in MALFORMED:
                raise
            return self.second.complete(prompt, image)


class InTime:
    """A model whose answer is waited for so many seconds; a later one is an error. The call itself goes on in its thread until it ends."""

    def __init__(self, model: Model, seconds: float) -> None:
        self.model, self.seconds = model, seconds

    def complete(self, prompt: str, image: bytes | None) -> str:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.model.complete, prompt, image).result(self.seconds)
        except TimeoutError:
            raise TimeoutError(f"no answer in {self.seconds} seconds") from None
        finally:
            pool.shutdown(wait=False)


class Cascade:
    """Vision models in turn, where there is an image, then a text model; an error or an empty answer goes on to the next.

    The text model's own error passes.
    """

    def __init__(self, vision: Sequence[Model], text: Model) -> None:
        self.vision, self.text = vision, text

    def complete(self, prompt: str, image: bytes | None) -> str:
        for m in self.vision if image is not None else ():
            try:
                if out := m.complete(prompt, image):
                    return out
            except Exception:
                continue
        return self.text.complete(prompt, None)


def sees_images(model: Model, image: bytes) -> bool:
    """Asks once, on the driver, whether a model takes images at all."""
    try:
        model.complete("Say OK.", image)
        return True
    except Exception:
        return False


def _ask(model: Model, prompt: Column, image: Column | None, spacing: float) -> Column:
    @pandas_udf("struct<value: string, error: string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prompts, images in batches:
            out = []
            for p, i in zip(prompts, images):
                if p is None:
                    out.append((None, None))
                    continue
                try:
                    out.append((model.complete(p, i), None))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
                if spacing:
                    time.sleep(spacing)
            yield pd.DataFrame(out, columns=["value", "error"])

    return run(prompt, image if image is not None else F.lit(None).cast("binary"))


def attempts(rows: DataFrame, model: Model, first: Column, again: Callable[[Column, Column], Column], check: Callable[[Column], Column], image: Column | None = None, tries: int = 3, spacing: float = 0.0) -> DataFrame:
    """Rows with answer, reason (null: it passed), last and error: up to ``tries`` attempts, each after a repair prompt of the one before.

    ``last`` is the last answer whether it passed or not. A row whose model raises keeps the error and is not asked again.
    Each attempt is written to the shared folder, so that no answer is ever asked for twice and plans stay small.
    """
    work = Workdir(rows.sparkSession, "attempts")
    rows = rows.withColumn("_prompt", first).withColumn("_open", first.isNotNull())
    rows = rows.withColumn("answer", F.lit(None).cast("string")).withColumn("last", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    for turn in range(tries):
        rows = work.keep(rows.withColumn("_made", _ask(model, F.when(F.col("_open"), F.col("_prompt")), image, spacing)), f"asked{turn}")
        rows = work.keep(rows.withColumn("_now", F.when(F.col("_open"), T.model_output(F.col("_made.value")))), f"read{turn}")
        work.drop(f"asked{turn}")
        rows = rows.withColumn("_fail", F.when(F.col("_open") & F.col("_made.error").isNull(), check(F.col("_now"))))
        passed = F.col("_open") & F.col("_made.error").isNull() & F.col("_fail").isNull()
        rows = (
            rows.withColumn("answer", F.when(passed, F.col("_now")).otherwise(F.col("answer")))
            .withColumn("last", F.when(F.col("_open") & F.col("_made.error").isNull(), F.col("_now")).otherwise(F.col("last")))
            .withColumn("reason", F.when(F.col("_open"), F.col("_fail")).otherwise(F.col("reason")))
            .withColumn("error", F.when(F.col("_open"), F.col("_made.error")).otherwise(F.col("error")))
            .withColumn("_open", F.col("_open") & ~passed & F.col("_made.error").isNull())
        )
        rows = work.keep(rows.withColumn("_prompt", again(F.col("last"), F.col("reason"))), f"judged{turn}")
        work.drop(f"read{turn}")
    return rows.drop("_prompt", "_open", "_made", "_now", "_fail")


def caption_prompt(caption: Column) -> Column:
    return F.concat(F.lit("Write one English sentence of at most 28 words on what the figure with this caption shows, without figure numbers. "), T.hint(caption), F.lit("\nCaption: "), caption)


def image_prompt(caption: Column, panels: Column, figure_type: Column) -> Column:
    prefix = T.panel_prefix(panels)
    said = F.when(prefix != "", F.concat(F.lit(" Begin with '"), prefix, F.lit("'."))).otherwise("")
    kind = F.when(F.coalesce(figure_type, F.lit("")) != "", F.concat(F.lit("\nKind: "), figure_type)).otherwise("")
    return F.concat(F.lit("Describe the image in one English sentence of at most 28 words, without figure numbers."), said, kind, F.lit("\nCaption: "), caption)


def question_prompt(caption: Column, panels: Column, figure_type: Column, anchors: Column) -> Column:
    words = F.array_join(F.slice(F.array_sort(anchors), 1, 8), ", ")
    kind = F.when(F.coalesce(figure_type, F.lit("")) != "", F.concat(F.lit("\nKind: "), figure_type)).otherwise("")
    return F.concat(
        F.lit('Write two different search questions of 6 to 18 words on the figure as JSON {"q1": "...", "q2": "..."}. Use words of the caption: '), words, F.lit("\nPanels: "), panels.cast("string"), kind, F.lit("\nCaption: "), caption
    )


def repair_prompt(first: Column) -> Callable[[Column, Column], Column]:
    """The first prompt with the rejected answer and the reason."""
    return lambda last, reason: F.concat(first, F.lit("\nRejected: "), F.coalesce(last, F.lit("")), F.lit("\nReason: "), F.coalesce(reason, F.lit("")))


def _kept(policy: str) -> Column:
    """What a description becomes when no attempt passed: the last rejected text, or nothing."""
    return F.coalesce("answer", "last" if policy == "last" else F.lit(None).cast("string"), F.lit(""))


def describe_captions(rows: DataFrame, model: Model, tries: int = 3, policy: str = "last", spacing: float = 0.0, force: bool = True) -> DataFrame:
    """Rows with description2 made from the caption; empty where the caption is, the old value where the model failed.

    Without ``force`` records that have a description keep it, and the model is not asked for them.
    """
    old = F.col("description2") if "description2" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_old", old).withColumn("_need", needs(old, force))
    empty, old = F.col("_need") & (T.strip(F.col("caption")) == ""), F.col("_old")
    prompt = F.when(F.col("_need") & ~empty, caption_prompt(F.col("caption")))
    out = attempts(rows, model, prompt, repair_prompt(prompt), lambda t: V.caption_description_failure(t, F.col("caption")), None, tries, spacing)
    made = F.when(~F.col("_need"), old).when(empty, "").when(F.col("error").isNotNull(), old).otherwise(_kept(policy))
    return out.withColumn("description2", made).drop("answer", "last", "_old", "_need")


def describe_images(rows: DataFrame, model: Model, tries: int = 3, policy: str = "last", spacing: float = 0.0, force: bool = True) -> DataFrame:
    """Rows (caption, image, panels, figure_type) with description3; answers that pass name their panels first. force as in describe_captions."""
    old = F.col("description3") if "description3" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_old", old).withColumn("_need", needs(old, force))
    empty, old = F.col("_need") & (T.strip(F.col("caption")) == ""), F.col("_old")
    prompt = F.when(F.col("_need") & ~empty, image_prompt(F.col("caption"), F.col("panels"), F.col("figure_type")))
    out = attempts(rows, model, prompt, repair_prompt(prompt), lambda t: V.image_description_failure(t, F.col("panels")), F.col("image"), tries, spacing)
    out = out.withColumn("answer", T.with_panel_prefix(F.col("answer"), F.col("panels")))
    made = F.when(~F.col("_need"), old).when(empty, "").when(F.col("error").isNotNull(), old).otherwise(_kept(policy))
    return out.withColumn("description3", made).drop("answer", "last", "_old", "_need")


def ask_questions(rows: DataFrame, model: Model, tries: int = 3, spacing: float = 0.0) -> DataFrame:
    """Rows (caption, image, panels, figure_type) with two questions; general ones by keywords when no attempt passed."""
    empty = T.strip(F.col("caption")) == ""
    rows = rows.withColumn("_anchors", T.anchor_terms(F.col("caption")))
    anchors = F.col("_anchors")
    prompt = F.when(~empty, question_prompt(F.col("caption"), F.col("panels"), F.col("figure_type"), anchors))
    old = F.col("questions") if "questions" in rows.columns else F.lit(None).cast("array<string>")

    def check(t: Column) -> Column:
        pair = T.question_pair(t)
        return V.questions_failure(pair["q1"], pair["q2"], F.col("caption"), F.col("panels"), anchors)

    out = attempts(rows, model, prompt, repair_prompt(prompt), check, F.col("image"), tries, spacing)
    pair = T.question_pair(F.col("answer"))
    made = F.when(F.col("answer").isNotNull(), F.array(T.normalize_question(T.with_mark(pair["q1"])), T.normalize_question(T.with_mark(pair["q2"]))))
    made = made.otherwise(T.fallback_questions(F.col("caption"), F.col("figure_type")))
    none = F.array(*[F.lit(q) for q in NO_CAPTION])
    return out.withColumn("questions", F.when(empty, none).when(F.col("error").isNotNull(), old).otherwise(made)).drop("answer", "last", "_anchors")


def needs(value: Column, force: bool) -> Column:
    """Should a value be made: always if forced, else where there is none."""
    return F.lit(True) if force else F.coalesce(T.strip(value) == "", F.lit(True))
