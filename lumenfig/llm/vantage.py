"""The most similar vectors of every vector, with vantage-point trees.

Vectors are scaled to unit length, where the k most similar by cosine are the k
nearest by distance. A tree of vantage points, fitted on a bounded sample of the vectors
(``sample`` rows, taken by the order of a hash), routes every vector to one
shard. A query visits its own shard and each shard that it can't rule out: at a
vantage point whose border lies at m, a query at distance d with search radius r can skip the
side across if |d - m| > r by the triangle inequality. The relaxed rule skips it if
|d - m| > r / factor. Factor 1 is exact: every neighbour within the radius is
found. A larger factor visits fewer shards and may miss some; recall is measured in the tests.

Within a shard a tree of its own is built over the shard's vectors, and queries walk
it together, a node's vectors against all queries that reach it, under the same relaxed rule.

Without a least cosine there is no radius to begin with. Every vector is then ranked within its own shard
first, and the distance of its k-th best there is its radius in the others, which are compared whole.

The number of shards grows with the rows, up to one for each ``BORDER_ROWS`` of the sample (beyond about
65 million vectors shards grow instead, and ``sample`` should). A shard that very many vectors visit answers them in several tasks.

The sample fixes borders only; all rows are indexed. Rows with vectors that are null, of
another length, all zero or not finite take no part; of rows with one key the first by value counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfig.operators.search import usable
from lumenfig.workdir import Workdir

#: Vectors per shard, on average, up to so many shards, and how many times as many beyond; vectors in a leaf of a shard's tree.
SHARD_ROWS, FEW_SHARDS, LARGER, LEAF_ROWS = 4096, 64, 16, 256
#: Queries of a shard that one task answers, on average; sampled vectors that a shard's border is drawn from, at least.
SHARD_QUERIES, BORDER_ROWS = 131_072, 16
#: Without a least cosine, when a query visits most shards: vectors per shard, and queries that a task holds, on average.
WIDE_ROWS, WIDE_QUERIES = 32768, 65536
#: There, the k best are chosen by exact cosines among so many times k by cosines of single precision.
SPARE = 4
#: Cells of the matrix of cosines that a leaf computes at once.
BLOCK_CELLS = 4_000_000


ROUTED = "shard INT, chunk INT, query BOOLEAN, ids BINARY, vecs BINARY"


class Tree:
    """A binary tree of vantage points in arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, points: np.ndarray, borders: np.ndarray, depth: int) -> None:
        self.points, self.borders, self.depth = points, borders, depth

    @classmethod
    def fit(cls, vectors: np.ndarray, depth: int, tries: int = 32) -> Tree:
        """Of some vectors of a node, the one whose distances spread most is its vantage point."""
        nodes = (1 << depth) - 1
        points = np.zeros((nodes, vectors.shape[1]), np.float32)
        borders = np.full(nodes, np.inf, np.float32)
        rng = np.random.default_rng(11)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, held = todo.pop()
            if node >= nodes or not len(held):
                continue
            of = vectors[held]
            pick = vectors[rng.choice(len(vectors), min(tries, len(vectors)), replace=False)]
            d = distances(of, pick)
            best = int(d.std(0).argmax())
            points[node], borders[node] = pick[best], np.median(d[:, best])
            near = d[:, best] <= borders[node]
            todo += [(2 * node + 1, held[near]), (2 * node + 2, held[~near])]
        return cls(points, borders, depth)

    def routes(self, vectors: np.ndarray, slack: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaves that each vector visits, with one slack or each its own; slack 0 for all gives their own leaves only."""
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            gap = np.empty(len(row), np.float32)
            for n in np.unique(node):
                here = node == n
                gap[here] = distances(vectors[row[here]], self.points[n : n + 1])[:, 0] - self.borders[n]
            reach = slack if np.ndim(slack) == 0 else slack[row]
            left, right = gap <= reach, gap > -reach
            if np.ndim(slack) == 0 and slack == 0:
                right = ~left
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - ((1 << self.depth) - 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled to length one; in the JVM a length would be computed again for each value."""
    for batch in batches:
        lists = batch.column(1)
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        x = (x / np.sqrt(np.bincount(row, x * x, len(sizes)))[row]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(x))], names=["key", "vec"])


def _routed(tree: Tree, slack: float, dim: int, chunks: int = 1):
    """(shard, chunk, query, ids, vecs) of every vector: its own shard as a member, in all chunks, and others as a query in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vecs = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            own = np.empty(len(ids), np.int64)
            row, leaf = tree.routes(vecs, 0)
            own[row] = leaf
            row, leaf = tree.routes(vecs, slack)
            away = leaf != own[row]
            row = np.concatenate([np.arange(len(ids)), row[away]])
            leaf = np.concatenate([own, leaf[away]])
            query = np.arange(len(row)) >= len(ids)
            chunk = ((ids[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(chunks)
            order = np.lexsort((chunk, query, leaf))
            cuts = np.searchsorted(leaf[order], np.arange((1 << tree.depth) + 1))
            out: list[tuple[int, int, bool, bytes, bytes]] = []
            for n in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[n] : cuts[n + 1]]
                asked = at[query[at]]
                for c in range(chunks):
                    # A vector asks in its own shard too, in the chunk that it falls into.
                    for kind, here in ((False, at[~query[at]]), (True, np.concatenate([asked[chunk[asked] == c], at[~query[at] & (chunk[at] == c)]]) if chunks > 1 else asked)):
                        if len(here):
                            out.append((n, c, kind, ids[row[here]].tobytes(), vecs[row[here]].tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["shard", "chunk", "query", "ids", "vecs"]
            )

    return run


def _searched(k: int, least: float, factor: float, dim: int, chunks: int):
    radius = math.sqrt(max(0.0, 2 - 2 * least))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(b"".join(rows["ids"]), np.int64), np.frombuffer(b"".join(rows["vecs"]), np.float32).reshape(-1, dim)

        member, held = of(pdf[~pdf["query"]])
        ids, vecs = of(pdf[pdf["query"]])
        if chunks == 1:
            # Members ask as well; with several chunks they have been sent as queries of one.
            ids, vecs = np.concatenate([ids, member]), np.concatenate([vecs, held])
        depth = max(0, math.ceil(math.log2(max(1, len(held)) / LEAF_ROWS)))
        tree = Tree.fit(held, depth) if len(held) else None
        empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "cos": np.zeros(0)})
        if tree is None:
            return empty
        own = np.empty(len(held), np.int64)
        row, leaf = tree.routes(held, 0)
        own[row] = leaf
        row, leaf = tree.routes(vecs, radius / factor)
        order = np.argsort(leaf, kind="stable")
        row, cuts = row[order], np.searchsorted(leaf[order], np.arange((1 << depth) + 1))
        out: list[np.ndarray] = []
        for n in range(1 << depth):
            at, inside = row[cuts[n] : cuts[n + 1]], np.nonzero(own == n)[0]
            block = min(4096, max(1, BLOCK_CELLS // max(1, len(inside))))
            for i in range(0, len(at) if len(inside) else 0, block):
                cos = vecs[at[i : i + block]] @ held[inside].T
                q, m = np.nonzero(cos >= least - 1e-6)
                if len(q) > 64 * len(cos):
                    # A leaf full of near-equal vectors: only the best can be among the k, and itself; some are spare, as single precision orders them.
                    best = np.argpartition(-cos, min(SPARE * k, cos.shape[1] - 1), axis=1)[:, : SPARE * k + 1]
                    q, m = np.repeat(np.arange(len(cos)), best.shape[1]), best.ravel()
                a, b = ids[at[i + q]], member[inside[m]]
                keep = a != b
                c = np.einsum("nd,nd->n", vecs[at[i + q[keep]]].astype(np.float64), held[inside[m[keep]]].astype(np.float64))
                out.append(np.rec.fromarrays([a[keep], b[keep], c], names="a,b,cos"))
        if not out:
            return empty
        both = pd.DataFrame.from_records(np.concatenate(out))
        both = both.sort_values(["a", "cos", "b"], ascending=[True, False, True], kind="stable").drop_duplicates(["a", "b"])
        return both.groupby("a", sort=False).head(k)

    return run


def _ranked(k: int, dim: int):
    """Of a shard its members' k best within it, and the cosine that each has to reach elsewhere; packed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
        vecs = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, dim) for x in pdf["vecs"]])
        many, block = min(SPARE * k, len(ids) - 1), max(1, BLOCK_CELLS // len(ids))
        few = min(k, many)
        out: list[tuple[bytes, ...]] = []
        for i in range(0, len(ids), block):
            part = vecs[i : i + block]
            cos = part @ vecs.T
            cos[np.arange(len(part)), np.arange(i, i + len(part))] = -2
            best = np.argpartition(-cos, max(0, many - 1), axis=1)[:, :many]
            cos = np.einsum("qd,qkd->qk", part.astype(np.float64), vecs[best].astype(np.float64))
            order = np.argsort(-cos, axis=1)[:, :few]
            best, cos = np.take_along_axis(best, order, 1), np.take_along_axis(cos, order, 1)
            bound = cos.min(1) if few == k else np.full(len(part), -np.inf)
            a = np.repeat(ids[i : i + block], few)
            out.append(tuple(x.tobytes() for x in (ids[i : i + block], part, bound, a, ids[best].ravel(), cos.ravel())))
        return pd.DataFrame(out, columns=["ids", "vecs", "bounds", "a", "b", "cos"]).assign(shard=pdf["shard"].iloc[0])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, cos in zip(*[c.to_pylist() for c in batch.columns]):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64)), pa.array(np.frombuffer(cos, np.float64))], names=["a", "b", "cos"])


def _sent(tree: Tree, factor: float, dim: int, chunks: int):
    """(shard, chunk, query, ids, vecs, bounds): the members of a shard for every chunk of queries, and each as a query of other shards in its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, *packed in zip(*[c.to_pylist() for c in batch.columns]):
                ids, vecs, bounds = np.frombuffer(packed[0], np.int64), np.frombuffer(packed[1], np.float32).reshape(-1, dim), np.frombuffer(packed[2], np.float64)
                out = [(shard, c, False, *packed) for c in range(chunks)]
                # The margin is for distances of single precision.
                row, leaf = tree.routes(vecs, np.sqrt(np.maximum(2 - 2 * bounds, 0)) / factor + 1e-3)
                row, leaf = row[leaf != shard], leaf[leaf != shard]
                chunk = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(chunks)
                for n in np.unique(leaf):
                    for c in range(chunks):
                        at = row[(leaf == n) & (chunk[row] == c)]
                        if len(at):
                            out.append((int(n), c, True, ids[at].tobytes(), vecs[at].tobytes(), bounds[at].tobytes()))
                cols = list(zip(*out))
                types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["shard", "chunk", "query", "ids", "vecs", "bounds"])

    return run


def _reached(k: int, dim: int):
    """(a, b, cos): of each query its k best members of a shard that reach its bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]])
            return ids, np.concatenate([np.frombuffer(x, np.float32).reshape(-1, dim) for x in rows["vecs"]]), np.concatenate([np.frombuffer(x, np.float64) for x in rows["bounds"]])

        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "cos": np.zeros(0)})]
        if pdf["query"].nunique() < 2:
            return out[0]
        ids, vecs, bounds = of(pdf[pdf["query"]])
        member, held, _ = of(pdf[~pdf["query"]])
        least, block = (bounds - 1e-6).astype(np.float32)[:, None], max(1, BLOCK_CELLS // len(member))
        for i in range(0, len(ids), block):
            part = vecs[i : i + block]
            cos = part @ held.T
            q, m = np.divmod(np.flatnonzero(cos >= least[i : i + block]), len(member))
            near = cos[q, m]
            for most in (SPARE * k, k):
                order = np.lexsort((-near, q))
                q, m, near = q[order], m[order], near[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < most
                q, m, near = q[kept], m[kept], near[kept]
                if most > k:
                    near = np.einsum("nd,nd->n", part[q].astype(np.float64), held[m].astype(np.float64))
            out.append(pd.DataFrame({"a": ids[i + q], "b": member[m], "cos": near}))
        return pd.concat(out, ignore_index=True)

    return run


def _without_least(work: Workdir, rows: DataFrame, tree: Tree, dim: int, k: int, factor: float, total: int) -> DataFrame:
    """(a, b, cos) with the k nearest of every vector among them, however far they are."""
    homes = rows.select("id", "vec").mapInArrow(_routed(tree, 0, dim), ROUTED)
    own = homes.groupBy("shard").applyInPandas(_ranked(k, dim), "ids BINARY, vecs BINARY, bounds BINARY, a BINARY, b BINARY, cos BINARY, shard INT")
    own = work.keep(own, "own")
    sent = own.select("shard", "ids", "vecs", "bounds").mapInArrow(_sent(tree, factor, dim, -(-total // WIDE_QUERIES)), "shard INT, chunk INT, query BOOLEAN, ids BINARY, vecs BINARY, bounds BINARY")
    away = sent.groupBy("shard", "chunk").applyInPandas(_reached(k, dim), "a LONG, b LONG, cos DOUBLE")
    return work.keep(away.unionByName(own.select("a", "b", "cos").mapInArrow(_unpacked, "a LONG, b LONG, cos DOUBLE")), "near")


def nearest(df: DataFrame, key: str, vec: str = "embedding", dim: int = 64, k: int = 5, least: float | None = 0.9, factor: float = 7.0, sample: int = 16_384) -> DataFrame:
    """(key_a, key_b, cos, place): of every row its k most similar others, with a cosine of at least ``least`` unless it is None.

    Cosines are those of the unit vectors in single precision; their ties go to the smaller key. Among more than a few k vectors of one leaf whose
    cosines differ by less than single precision tells, which are the nearest is left open. With factor 1 the result is exact but for ties among more than k vectors.
    Each shard gives a query at most k rows, so what is shuffled after the search is bounded
    by k rows per visit. Rows with equal vectors are searched as one.
    """
    spark = df.sparkSession
    work = Workdir(spark, "vantage")
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(vec).alias("vec")).where(F.col("key").isNotNull() & usable(F.col("vec"), dim))
    rows = rows.groupBy("key").agg(F.min("vec").alias("vec"))
    named = work.keep(rows.mapInArrow(_unit, "key STRING, vec ARRAY<FLOAT>"), "named")
    # Equal vectors are searched once; who has them comes back at the end.
    rows = work.keep(named.groupBy("vec").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("id"), "vec", "n"), "rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "key_a STRING, key_b STRING, cos DOUBLE, place INT")
    # About one and a half times the sample passes the first test, so no task hands more than its share of that to the driver.
    few = rows.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 1.5 * sample / total)))
    drawn = np.stack(few.orderBy(F.xxhash64("vec")).limit(sample).select("vec").toPandas()["vec"].to_numpy()).astype(np.float32)
    shards = total / WIDE_ROWS if least is None else max(min(FEW_SHARDS, total / SHARD_ROWS), total / (LARGER * SHARD_ROWS))
    depth = max(0, math.ceil(math.log2(max(1, min(shards, max(1, sample // BORDER_ROWS))))))
    tree = Tree.fit(drawn, depth)
    if least is None:
        pairs = _without_least(work, rows, tree, dim, k, factor, total)
    else:
        slack = math.sqrt(max(0.0, 2 - 2 * least)) / factor
        asked = total / len(drawn) * len(tree.routes(drawn, slack)[0]) / (1 << depth)
        chunks = max(1, math.ceil(asked / SHARD_QUERIES))
        visits = rows.select("id", "vec").mapInArrow(_routed(tree, slack, dim, chunks), ROUTED)
        near = visits.groupBy("shard", "chunk").applyInPandas(_searched(k, least, factor, dim, chunks), "a LONG, b LONG, cos DOUBLE")
        near = work.keep(near, "near")
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).groupBy("a", "b").agg(F.max("cos").alias("cos"))
        left = rows.select(F.col("id").alias("a"), F.col("vec").alias("va"))
        right = rows.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
        exact = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        pairs = both.join(left, "a").join(right, "b").select("a", "b", exact.alias("cos")).where(F.col("cos") >= least)
    pairs = pairs.withColumn("place", F.dense_rank().over(Window.partitionBy("a").orderBy(F.desc("cos")))).where(F.col("place") <= k).drop("place")
    holders = work.keep(named.join(rows.select("vec", "id", "n"), "vec").select("id", "key", "n"), "holders")
    first = _first_keys(holders, k + 1)
    own = holders.where("n > 1").select("id", F.col("key").alias("key_a")).join(first.select("id", F.col("key").alias("key_b")), "id").where("key_a != key_b")
    own = own.select("key_a", "key_b", F.lit(1.0).alias("cos"))
    others = holders.select(F.col("id").alias("a"), F.col("key").alias("key_a")).join(pairs, "a").join(first.select(F.col("id").alias("b"), F.col("key").alias("key_b")), "b")
    all_ = own.unionByName(others.select("key_a", "key_b", "cos"))
    place = F.row_number().over(Window.partitionBy("key_a").orderBy(F.desc("cos"), "key_b"))
    return all_.withColumn("place", place).where(F.col("place") <= k)


def _first_keys(holders: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The k smallest keys of each vector. A vector that very many rows share is ranked in salted parts first."""
    part = Window.partitionBy("id", "salt").orderBy("key")
    rows = holders.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    rows = rows.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("key"))).where(F.col("r") <= k).select("id", "key")


def mutual(found: DataFrame) -> DataFrame:
    """(figure_key_a, figure_key_b): pairs in which each is among the other's nearest, smaller key first."""
    ends = found.select(F.least("key_a", "key_b").alias("figure_key_a"), F.greatest("key_a", "key_b").alias("figure_key_b"), (F.col("key_a") < F.col("key_b")).alias("up"))
    both = ends.groupBy("figure_key_a", "figure_key_b").agg(F.count_distinct("up").alias("n"))
    return both.where("n = 2").drop("n")
