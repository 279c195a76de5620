"""Containers: nothing lost, nothing over, little room left."""

import random
from collections import Counter, defaultdict

import pytest

from lumenfig.llm import packing


def test_least_slack_uses_every_item():
    rng = random.Random(1)
    counts = Counter(rng.randrange(1, 100) for _ in range(3000))
    used, bins = Counter(), 0
    for mix, times in packing.least_slack(counts, 100):
        assert sum(n * k for n, k in mix.items()) <= 100
        bins += times
        for n, k in mix.items():
            used[n] += k * times
    assert used == counts
    first_fit: list[int] = []
    for n in sorted(counts.elements(), reverse=True):
        at = next((i for i, room in enumerate(first_fit) if room >= n), None)
        if at is None:
            first_fit.append(100 - n)
        else:
            first_fit[at] -= n
    assert bins <= len(first_fit)


def test_best_sum_is_found():
    assert list(packing.least_slack({7: 1, 5: 1, 4: 1, 3: 1}, 12)) == [({7: 1, 5: 1}, 1), ({4: 1, 3: 1}, 1)]


def test_packed(spark):
    rng = random.Random(2)
    sizes = [(i, rng.randrange(1, 90)) for i in range(500)] + [(900, 250), (901, 100), (902, 200)]
    df = spark.createDataFrame([(i, n, "c") for i, n in sizes], "id LONG, tokens LONG, window STRING").select("id", "tokens")
    packs = spark.createDataFrame([("a", 100), ("b", 300), (None, 5), ("z", 0)], "pack STRING, capacity INT")
    rows = packing.packed(df, packs, window=200).collect()
    for pack, capacity in (("a", 100), ("b", 300)):
        held, of = Counter(), defaultdict(list)
        for r in rows:
            if r["pack"] == pack:
                held[r["window"], r["container"]] += r["tokens"]
                of[r["doc_id"]].append(r["tokens"])
        assert max(held.values()) <= capacity
        assert {i: sum(v) for i, v in of.items()} == dict(sizes)
        assert all(len(v) == 1 or sum(v) > capacity for v in of.values())
    filled = {r["pack"]: r["filled"] for r in packing.fill(packing.packed(df, packs, window=200), packs).collect()}
    assert min(filled.values()) > 0.9


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(packing.VOCABULARY)
    texts = ["A short text.", "Größe und Maß, <|endoftext|>", "x" * 20_000]
    made.encode_special_tokens = True
    df = spark.createDataFrame([*enumerate(texts), (8, None), (9, "")], "doc_id LONG, text STRING")
    got = {r["id"]: r["tokens"] for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert got == {i: len(made.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
