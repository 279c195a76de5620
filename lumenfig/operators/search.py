"""Exact cosine top-k search and its score filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from lumenfig.functions.text import image_url, short_caption

#: Hits of the service, hits of the command line, least score of the service.
TOP_K, TOP_K_CLI, MIN_SCORE = 5, 2, 0.75


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, inside the JVM."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(vec: Column, dim: int) -> Column:
    """True for a vector of the right length, finite, and not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & ~bad & (norm(vec) > 0), F.lit(False))


def score(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1], as the vector store reports it."""
    return (F.lit(1.0) + dot(a, b) / (norm(a) * norm(b))) / 2


def knn(index: DataFrame, query_vec: list[float], key: str, vec: str = "embedding", k: int = TOP_K) -> DataFrame:
    """The k nearest rows to one vector, ties by key; vectors of zero norm are left out.

    Plans as a scan with a projected score and TakeOrderedAndProject, so each
    task keeps k rows. An empty index gives no rows.
    """
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    rows = index.where(usable(F.col(vec), len(query_vec)))
    return rows.withColumn("score", score(F.col(vec), q)).orderBy(F.desc("score"), F.asc(key)).limit(k).drop(vec)


def above(hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The score threshold, applied after the limit: fewer than k rows may remain."""
    return hits.where(F.col("score") >= min_score)


#: Queries that are fetched without being counted; query values that go to every task at once (64 MB), in parts of about so many where there are more queries.
FIRST_QUERIES, QUERY_VALUES = 10_000, 8_000_000


def _best_of_task(ids: list, queries: np.ndarray, k: int, types: str):
    """(query_key, hit_key, score): of each query its k best among the rows (key, vector) of one task."""
    dim = queries.shape[1]
    unit = queries / np.linalg.norm(queries, axis=1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = [None]
        scores, place = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_pylist()
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            rows /= np.linalg.norm(rows, axis=1)[:, None]
            # Rows come in the order of their keys within a batch, so equal scores keep it.
            order = np.array(sorted(range(len(own)), key=own.__getitem__))
            rows, at = rows[order], order + len(keys)
            keys += own
            for i in range(0, len(ids), block := max(1, 4_000_000 // len(rows))):
                here = (1 + unit[i : i + block] @ rows.T) / 2
                few = min(2 * k, here.shape[1])
                # All that reach the k-th best stay, so that ties are settled by key.
                if here.shape[1] > few:
                    edge = np.partition(here, here.shape[1] - k, axis=1)[:, here.shape[1] - k]
                    q, m = np.nonzero(here >= edge[:, None])
                else:
                    q, m = (x.ravel() for x in np.indices(here.shape))
                for j in range(len(here)):
                    a, b = np.searchsorted(q, [j, j + 1])
                    cand = np.r_[scores[i + j], here[j, m[a:b]]], np.r_[place[i + j], at[m[a:b]]]
                    rank = sorted(range(len(cand[0])), key=lambda c: (-cand[0][c], cand[0][c] == -np.inf or keys[cand[1][c]]))[:k]
                    scores[i + j], place[i + j] = cand[0][rank], cand[1][rank]
            used, back = np.unique(place, return_inverse=True)
            keys, place = [keys[x] for x in used.tolist()], back.reshape(place.shape)
            if 0 not in used:
                keys, place = [None, *keys], place + 1
        q, c = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_pylist([{"query_key": ids[x], "hit_key": keys[place[x, y]], "score": float(scores[x, y])} for x, y in zip(q.tolist(), c.tolist())], schema=pa.schema(types))

    return run


def knn_batch(index: DataFrame, queries: DataFrame, key: str, query_key: str, vec: str = "embedding", k: int = TOP_K) -> DataFrame:
    """(query_key, hit_key, score, rank): top k per query, ties by key.

    As long as the queries are few they go to all tasks as one matrix, which a scan of the index meets
    batch by batch; more are counted and dealt into parts by hash, with a scan for each. A task keeps k rows a query. Unusable vectors, and
    those of another length than most of the first queries have, take no part.
    """
    spark = index.sparkSession
    kinds = dict(index.dtypes)[key], dict(queries.dtypes)[query_key]
    schema = f"query_key {kinds[1]}, hit_key {kinds[0]}, score DOUBLE"
    empty = spark.createDataFrame([], f"{schema}, rank INT")
    asked = queries.select(F.col(query_key).alias("query_key"), F.col(vec).alias("vec")).where(F.size("vec") > 0)
    first = asked.limit(FIRST_QUERIES + 1).toPandas()
    if not len(first):
        return empty
    dim = int(first["vec"].map(len).mode()[0])
    few = len(first) <= FIRST_QUERIES
    parts = 1 if few else max(1, -(-asked.count() * dim // QUERY_VALUES))
    rows = index.where(usable(F.col(vec), dim)).select(key, vec)
    types = [(f.name, to_arrow_type(f.dataType)) for f in empty.drop("rank").schema]
    out: DataFrame | None = None
    for part in range(parts):
        here = first if few else asked.where(F.pmod(F.xxhash64("query_key"), F.lit(parts)) == part).toPandas()
        here = here[[len(v) == dim for v in here["vec"]]]
        vectors = np.array([[np.nan if x is None else x for x in v] for v in here["vec"]], np.float64).reshape(-1, dim)
        fit = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
        if fit.any():
            found = rows.mapInArrow(_best_of_task(here["query_key"][fit].tolist(), vectors[fit], k, types), schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return empty
    w = Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc("hit_key"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centres(vectors: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors around which a sample of vectors gathers."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    made = unit[np.random.default_rng(7).permutation(len(unit))[:cells]]
    for _ in range(rounds):
        own = (unit @ made.T).argmax(1)
        total = np.zeros_like(made)
        np.add.at(total, own, unit)
        size = np.linalg.norm(total, axis=1)
        made = np.where((size > 0)[:, None], total / np.maximum(size, 1e-12)[:, None], made)
    return made


class Cells:
    """An index laid out by cells, so that a search reads only those near its query: the approximate search beside the exact one.

    The centres are fitted on a bounded sample; every usable row is laid out. ``probes`` of all cells makes the search exact.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(f"{path}/rows")
        held = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        self.centres = np.array([r["centre"] for r in held])

    @classmethod
    def build(cls, index: DataFrame, path: str, dim: int, vec: str = "embedding", cells: int = 64, sample: int = 16_384) -> Cells:
        rows = index.where(usable(F.col(vec), dim))
        total = rows.count()
        few = rows.where(F.pmod(F.xxhash64(vec), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 2 * sample / max(1, total)))).select(vec).limit(sample).toPandas()[vec]
        made = centres(np.stack(few.to_numpy()).astype(np.float64), min(cells, len(few))) if len(few) else np.zeros((0, dim))
        spark = index.sparkSession

        @pandas_udf("int")
        def cell(vectors: pd.Series) -> pd.Series:
            return pd.Series((np.stack(vectors.to_numpy()).astype(np.float64) @ made.T).argmax(1) if len(vectors) else [], dtype="int32")

        rows.withColumn("cell", cell(F.col(vec))).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(made)], "cell INT, centre ARRAY<DOUBLE>").write.mode("overwrite").parquet(f"{path}/centres")
        return cls(spark, path)

    def knn(self, query_vec: list[float], key: str, vec: str = "embedding", k: int = TOP_K, probes: int = 8) -> DataFrame:
        """As :func:`knn`, over the ``probes`` cells whose centres are nearest to the query; the others' files are not read."""
        near = np.argsort(-(self.centres @ np.asarray(query_vec, float)), kind="stable")[:probes].tolist()
        return knn(self.rows.where(F.col("cell").isin(near)).drop("cell"), query_vec, key, vec, k)


def answer(index: DataFrame, embedder, query: str, url_prefix: str, k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """Hits for a text, as the service returns them: the text is embedded once, on the driver; a blank one is refused."""
    if not query.strip():
        raise ValueError("blank query")
    hits = above(knn(index, embedder.embed([query])[0], "figure_key", k=k), min_score)
    return hits.select(
        image_url(F.col("image_path"), url_prefix).alias("image_url"), "image_path", "doc_id", "page", "caption", "source_pdf_url", F.round("score", 4).alias("score")
    )


def listing(hits: DataFrame) -> DataFrame:
    """Hits for the console: score, place, and the start of the caption."""
    return hits.select(F.round("score", 4).alias("score"), "doc_id", "page", "image_path", short_caption(F.col("caption")).alias("caption"))


def session(index: DataFrame, embedder, lines, show) -> None:
    """Answers lines of text until ``salir``; blank ones are passed over."""
    for line in lines:
        query = line.strip()
        if query.lower() == "salir":
            return
        if query:
            show(query, listing(knn(index, embedder.embed([query])[0], "figure_key", k=TOP_K_CLI)).collect())
