"""Leaked test items against looking up every run of words."""

import random

from lumenfig.llm import leaks
from lumenfig.llm.common import words


def _brute(docs, items, n):
    runs = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in runs.get(tuple(w[k : k + n]), ())}


def test_equals_every_run(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "v1 v2")]
    docs = [(d, "-".join(rng.choice(vocab + ["other"]) for _ in range(rng.randrange(1, 200)))) for d in range(60)] + [(90, None), (91, "")]
    docs += [(92, "Ünïcode, " + items[0][1].upper() + "! done"), (93, "x " * 20_000 + (items[3][1] or ""))]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id LONG, text STRING, item_id INT")
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id LONG, text STRING, doc_id INT")
    for block in (500_000, 64):
        found = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i, min_words=6, block_words=block).collect()}
        assert found == _brute(docs, items, 6)


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    i = spark.createDataFrame([(1, item), (2, item)], "item_id LONG, text STRING")
    d = spark.createDataFrame([(1, f"Before it {item}, and after it come some more words to keep here, really many of them."), (2, f"a {item}"), (3, "clean"), (4, None)], "doc_id LONG, text STRING")
    got = {r["doc_id"]: r for r in leaks.without_leaks(d, leaks.leaks(d, i)).collect()}
    assert got[1]["text"] == "Before it , and after it come some more words to keep here, really many of them." and got[1]["cut"] == len(item)
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[4]["text"] is None


def test_letters_that_lower_case_doubles(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    i = spark.createDataFrame([(1, item), (2, "İstanbul " + item)], "item_id LONG, text STRING")
    d = spark.createDataFrame([(1, f"In İSTANBUL we read {item.upper()}, and then a good deal more was said about other things than that."), (2, f"İstanbul {item} İ and a few more words that stay here, so that most of the text is kept.")], "doc_id LONG, text STRING")
    found = leaks.leaks(d, i)
    assert {(r["doc_id"], r["item_id"], r["longest"]) for r in found.collect()} == {(1, 1, 12), (1, 2, 12), (2, 1, 12), (2, 2, 13)}
    got = {r["doc_id"]: r["text"] for r in leaks.without_leaks(d, found).collect()}
    assert got == {1: "In İSTANBUL we read , and then a good deal more was said about other things than that.", 2: " İ and a few more words that stay here, so that most of the text is kept."}


def test_no_items(spark):
    d = spark.createDataFrame([(1, "text")], "doc_id LONG, text STRING")
    assert leaks.leaks(d, spark.createDataFrame([], "item_id LONG, text STRING")).count() == 0
