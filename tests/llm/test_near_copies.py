"""Likeness of word sets against all pairs."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenfig.llm import near_copies


def _texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split()
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(["the", "of", "a", "and"]) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(rng.randrange(4, 40))]
        out.append(" ".join(words))
    return out


def test_equals_all_pairs(spark):
    texts = _texts(400, 7)
    rows = [(i, t if i % 3 else t.upper() + ".", "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "  ...", "x"), (902, "", "x")]
    df = spark.createDataFrame(rows, "rec_id LONG, caption STRING, class_id STRING")
    found = {tuple(r) for r in near_copies.record_pairs(near_copies.alike(df, "rec_id", F.col("caption"))).collect()}
    sets = [set(t.lower().split()) for t in texts]
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])}
    assert found == want


def test_template_of_a_third_of_the_rows(spark):
    template = " ".join(f"t{i}" for i in range(24))
    texts = [f"{template} own{i}a own{i}b own{i}c" for i in range(150)] + [f"{template} own{i}a own{i}d" for i in range(20)] + _texts(300, 5)
    rng = random.Random(6)
    for n in (100, 125, 190):
        long = [f"l{n}x{i}" for i in range(n)]
        texts += [" ".join(long), " ".join(long[: int(0.72 * n)]), " ".join(rng.sample(long, int(0.9 * n)) + [f"m{n}x{i}" for i in range(n // 10)])]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id LONG, caption STRING")
    sets = [set(t.split()) for t in texts]
    for num, den in ((7, 10), (1, 2)):
        found = {tuple(r) for r in near_copies.record_pairs(near_copies.alike(df, "rec_id", F.col("caption"), num, den)).collect()}
        assert found == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}


def test_long_runs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    monkeypatch.setattr(near_copies, "RARE", 2)
    monkeypatch.setattr(near_copies, "PART_KEYS", 100)
    texts = ["same words here for many"] * 30 + [f"shared words of a long template {i}" for i in range(40)] + [f"shared words of a long template {i} {i}x" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id LONG, caption STRING")
    found = [tuple(r) for r in near_copies.record_pairs(near_copies.alike(df, "rec_id", F.col("caption"))).collect()]
    assert len(found) == len(set(found)) and set(found) == _all_pairs([set(t.split()) for t in texts])


def _all_pairs(sets, num=7, den=10):
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}


def test_links_through_common_words_only(spark):
    """Pairs that share their common words and differ in the rare ones, and sets with two rare words beside sets with three."""
    fill = [" ".join(f"common{j}" for j in range(i % 7, 14)) for i in range(200)]
    common = " ".join(f"common{j}" for j in range(14))
    texts = [f"{common} " + " ".join(f"r{i}x{j}" for j in js) for i in range(60) for js in ((0, 1, 2, 3, 4, 5), (0, 1, 2, 6, 7))]
    seven = " ".join(f"common{j}" for j in range(7))
    texts += [f"{seven} " + " ".join(f"s{i}x{j}" for j in js) for i in range(60) for js in ((0, 1), (0, 1, 2))]
    df = spark.createDataFrame(list(enumerate(texts + fill)), "rec_id LONG, caption STRING")
    found = {tuple(r) for r in near_copies.record_pairs(near_copies.alike(df, "rec_id", F.col("caption"))).collect()}
    assert found == _all_pairs([set(t.split()) for t in texts + fill])


def test_a_key_of_very_many_sets_is_handed_on_in_blocks():
    n = 100_000
    rng = np.random.default_rng(1)
    column = {"keys": np.zeros(n, np.uint32), "ids": np.arange(n, dtype=np.int64), "sketch": rng.integers(0, 1 << 63, (n, near_copies.BITS // 64), np.uint64), "size": np.full(n, 20, np.uint32)}
    pdf = pd.DataFrame([{"part": 0} | {k: v.tobytes() for k, v in column.items()}])
    out = near_copies._paired(7, 10)(pdf)
    assert len(out) == -(-n // near_copies.BLOCK) and out["key"].nunique() == 1
    assert out.memory_usage(deep=True).sum() < 2 * sum(v.nbytes for v in column.values())


def test_empty(spark):
    df = spark.createDataFrame([], "rec_id LONG, caption STRING")
    assert near_copies.record_pairs(near_copies.alike(df, "rec_id", F.col("caption"))).count() == 0


def test_groups_are_the_connected_parts(spark):
    texts = _texts(300, 11) + ["all alone here with words of its own"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, texts[0]), (501, None)], "rec_id LONG, caption STRING")
    found = near_copies.alike(df, "rec_id", F.col("caption"))
    pairs = {tuple(r) for r in near_copies.record_pairs(found).collect()}
    top = {i: i for i in [*range(301), 500]}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in sorted(pairs):
        x, y = sorted((root(a), root(b)))
        top[y] = x
    got = {r["id"]: (r["group_id"], r["links"]) for r in near_copies.groups(found).collect()}
    assert {i: g for i, (g, _) in got.items()} == {i: root(i) for i in top}
    assert got[300] == (300, 0)
