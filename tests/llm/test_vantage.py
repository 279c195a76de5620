"""Nearest vectors against brute force."""

import numpy as np

from lumenfig.llm import queries, vantage

SCHEMA = "figure_key STRING, embedding ARRAY<FLOAT>, id STRING, shard STRING"


def _rows(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    x = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), base + 0.1 * rng.normal(size=base.shape)])
    return x * rng.uniform(0.2, 5, (len(x), 1))


def _brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:k] if s[i, j] >= least}


def _found(spark, x, **more):
    df = spark.createDataFrame([(f"{i:05d}", [float(v) for v in r], "c", None) for i, r in enumerate(x)], SCHEMA)
    return {(int(r["key_a"]), int(r["key_b"])) for r in vantage.nearest(df, "figure_key", dim=x.shape[1], **more).collect()}


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_ROWS", 100)
    monkeypatch.setattr(vantage, "LEAF_ROWS", 16)
    x = _rows(900, 1)
    assert _found(spark, x, factor=1.0) == _brute(x, 5, 0.9)


def test_recall_of_the_relaxed_rule(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_ROWS", 200)
    monkeypatch.setattr(vantage, "LEAF_ROWS", 32)
    x = _rows(1800, 2, 64)
    want = _brute(x, 5, 0.9)
    assert len(_found(spark, x) & want) >= 0.9 * len(want)


def test_edges(spark):
    nan, same = float("nan"), [1.0, 0.0, 0.0]
    rows = [("a", same), ("a", same), ("b", [2.0, 0.0, 0.0]), ("c", [0.0, 0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [nan, 1.0, 1.0]), (None, same), ("g", [0.0, 1.0, 0.0]), ("h", [1.0, None, 0.0])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = vantage.nearest(df, "figure_key", dim=3)
    assert {(r["key_a"], r["key_b"]) for r in got.collect()} == {("a", "b"), ("b", "a")}
    assert [tuple(r) for r in vantage.mutual(got).collect()] == [("a", "b")]
    assert vantage.nearest(spark.createDataFrame([], SCHEMA), "figure_key").count() == 0


def test_rows_with_one_vector(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_ROWS", 100)
    monkeypatch.setattr(vantage, "LEAF_ROWS", 16)
    x = np.concatenate([np.tile([3.0, 1.0, 0.5, 0.2], (300, 1)), np.random.default_rng(3).normal(size=(300, 4))])
    got = _found(spark, x, factor=1.0, least=0.99)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for i in (0, 7, 299):
        assert {b for a, b in got if a == i} == {j for j in range(6) if j != i} if i < 6 else {b for a, b in got if a == i} == set(range(5))
    want = {(i, int(j)) for i in range(300, 600) for j in sorted(range(600), key=lambda j: (-round(u[i] @ u[j], 9), j)) [:6] if j != i and u[i] @ u[j] >= 0.99}
    few = {(a, b) for a, b in want if sum(p == a for p, _ in want) < 5}
    assert few <= got


def test_many_near_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_ROWS", 300)
    monkeypatch.setattr(vantage, "LEAF_ROWS", 64)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(1, 64)) + 0.02 * rng.normal(size=(900, 64))).astype(np.float32).astype(float)
    # Cosines are those of unit vectors in single precision.
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    near = u @ u.T
    np.fill_diagonal(near, -2)
    assert _found(spark, x, factor=1.0) == {(i, int(j)) for i in range(900) for j in np.argsort(-near[i])[:5]}


def test_shards_that_many_visit_answer_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_ROWS", 100)
    monkeypatch.setattr(vantage, "SHARD_QUERIES", 60)
    monkeypatch.setattr(vantage, "LEAF_ROWS", 16)
    x = _rows(900, 9)
    assert _found(spark, x, factor=1.0) == _brute(x, 5, 0.9)


def test_neighbours_have_no_least_cosine(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vantage, "WIDE_ROWS", 100)
    monkeypatch.setattr(vantage, "WIDE_QUERIES", 300)
    x = np.random.default_rng(4).normal(size=(700, 64))
    x[600:] = x[600:] * 0.02 + x[0]
    rows = [(f"{i:05d}", [float(v) for v in r], "c", None) for i, r in enumerate(x)]
    spark.createDataFrame(rows + [("n", None, "c", None)], SCHEMA).write.parquet(f"{tmp_path}/ragi_images.parquet")
    found = queries.p2_neighbours(spark, str(tmp_path)).collect()
    assert {(int(r["key_a"]), int(r["key_b"])) for r in found} == _brute(x, 5, -1)
    assert sorted(r["place"] for r in found) == [p for p in range(1, 6) for _ in range(700)]
    want = _brute(x, 5, -1)
    assert len(_found(spark, x, least=None, factor=4.0) & want) >= 0.9 * len(want)


def test_few_vectors_without_least_cosine(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "c", None), ("b", [-1.0, 0.0], "c", None), ("c", [2.0, 0.0], "c", None)], SCHEMA)
    got = [(r["key_a"], r["key_b"], r["place"]) for r in vantage.nearest(df, "figure_key", dim=2, least=None).collect()]
    assert sorted(got) == [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2)]
    assert vantage.nearest(df.limit(1), "figure_key", dim=2, least=None).count() == 0
