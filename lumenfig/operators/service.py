"""What a service in front of the engine answers, as functions from a request to a status and a body; no server is part of it."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lumenfig.operators import ratings
from lumenfig.operators.index import Embedder
from lumenfig.operators.search import MIN_SCORE, TOP_K, answer
from lumenfig.sources import files

Answer = tuple[int, Any]


def fields(body: Any, kinds: Mapping[str, type]) -> tuple[dict[str, Any] | None, str]:
    """The fields of a request's body, or None and what is wrong with it. Numbers aren't taken for text, nor truths for numbers."""
    if not isinstance(body, Mapping):
        return None, "no object"
    for name, kind in kinds.items():
        if name not in body:
            return None, f"{name} is missing"
        if not isinstance(body[name], kind) or isinstance(body[name], bool):
            return None, f"{name} is no {kind.__name__}"
    return {name: body[name] for name in kinds}, ""


def search(index: DataFrame, embedder: Embedder, body: Any, url_prefix: str = "", k: int = TOP_K, min_score: float = MIN_SCORE) -> Answer:
    """200 and the hits; 422 for a body that is no request, 400 for a blank query, 500 if the text can't be embedded or the index can't be searched."""
    asked, wrong = fields(body, {"query": str})
    if asked is None:
        return 422, {"detail": wrong}
    if not asked["query"].strip():
        return 400, {"detail": "blank query"}
    try:
        return 200, {"results": [r.asDict() for r in answer(index, embedder, asked["query"], url_prefix, k, min_score).collect()]}
    except Exception as e:
        return 500, {"detail": f"{type(e).__name__}: {e}"}


def vote(spark: SparkSession, path: str, body: Any, now: str) -> Answer:
    """200 and the number of votes; 422 for a body that is no vote, 400 for a score out of range."""
    said, wrong = fields(body, {"query": str, "image_path": str, "score": int})
    if said is None:
        return 422, {"detail": wrong}
    try:
        return 200, {"votes": ratings.append(spark, path, said["query"], said["image_path"], said["score"], now)}
    except ValueError as e:
        return 400, {"detail": str(e)}


def image(spark: SparkSession, root: str, path: str) -> Answer:
    """200 and a file's bytes; 404 for one that isn't there or lies outside the root."""
    try:
        return 200, files.one_file(spark, root, path)
    except Exception:
        return 404, {"detail": "no such file"}
