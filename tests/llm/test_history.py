"""Repeats of history against going through the records one by one."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfig.llm import history
from lumenfig.llm.common import checksum_of, paper_of

SCHEMA = "rec_id LONG, batch_no INT, doc_id STRING, id INT, md5 STRING, owner STRING, window STRING"


def one_by_one(rows):
    first, out = {}, set()
    for r, b, doc, i, md5 in sorted(rows, key=lambda x: (x[1], x[0])):
        keys = ([("m", md5)] if md5 else []) + ([("f", doc.split("v")[0], i)] if doc and i is not None else [])
        hit = {first[k] for k in keys if k in first}
        if b > 0 and hit:
            out |= {(a, r) for a in hit}
            continue
        for k in keys:
            first.setdefault(k, r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_going_through_the_records(spark, seed):
    rng = random.Random(seed)
    rows = []
    for r in range(240):
        md5 = f"{rng.randrange(60):08x}" + "c0ffee00" * 3 if rng.random() < 0.8 else None
        rows.append((r, 0 if r < 120 else 1 + (r - 120) // 40, f"2013.{rng.randrange(9):05d}v{rng.randrange(1, 4)}", rng.randrange(12) if rng.random() < 0.9 else None, md5))
    df = spark.createDataFrame([(*x, "clash", None) for x in rows], SCHEMA)
    found = {tuple(x) for x in history.repeated_deliveries(df, shards=4).collect()}
    assert found == one_by_one(rows)


def test_edges(spark):
    assert history.repeated_deliveries(spark.createDataFrame([], SCHEMA)).count() == 0
    a = "ab" * 16
    rows = [
        (1, 0, None, None, None), (2, 0, "2013.00001v1", 1, a), (2, 0, "2013.00001v1", 1, a), (3, 1, None, None, "none"), (4, 1, None, None, "0" * 32),
        (5, 1, " pdfs/2013.00001V2.pdf", 1, None), (6, 2, None, 1, "MD5=" + a.upper()), (7, 2, "", 1, ""), (None, 1, "x", 1, a), (8, None, "x", 1, a),
    ]
    df = spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)
    assert {tuple(x) for x in history.repeated_deliveries(df).collect()} == {(2, 5), (2, 6)}


def test_spellings(spark):
    said = ["2013.00001v1", "2013.00001V12", " 2013.00001v1 ", "preprint:2013.00001v3", "pdfs/2013.00001v1", "2013.00001v1.pdf", "PREPRINT:2013.00001v1"]
    df = spark.createDataFrame([(x,) for x in said], "d STRING")
    assert [r[0] for r in df.select(paper_of(F.col("d"))).distinct().collect()] == ["2013.00001"]
    hexed = "8b051335a3336ccaff43b80decd99cf1"
    forms = [hexed, hexed.upper(), f" {hexed}\n", "0x" + hexed, "md5:" + hexed, ":".join(hexed[i : i + 2] for i in range(0, 32, 2)), f"{hexed[:8]}-{hexed[8:12]}-{hexed[12:16]}-{hexed[16:20]}-{hexed[20:]}"]
    df = spark.createDataFrame([(x,) for x in forms], "m STRING")
    assert [r[0] for r in df.select(checksum_of(F.col("m"))).distinct().collect()] == [hexed]


def test_rounds_come_before_the_order(spark, monkeypatch):
    monkeypatch.setattr(history, "IN_ORDER", 20)
    rng = random.Random(7)
    rows = [(r, r // 120, f"2013.{rng.randrange(9):05d}v1", rng.randrange(12), f"{rng.randrange(60):08x}" + "c0ffee00" * 3) for r in range(240)]
    rows += [(300 + r, 2, f"2014.{r // 2:05d}v1", 1, f"{(r + 1) // 2:08x}" + "beefcafe" * 3) for r in range(80)]
    df = spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)
    assert {tuple(x) for x in history.repeated_deliveries(df, shards=4).collect()} == one_by_one(rows)


def _texts(spark, rows):
    return spark.createDataFrame(rows, "rec_id LONG, t STRING")


def test_substrings_merges_and_reopening(spark, tmp_path):
    held = history.History(spark, f"file://{tmp_path}/history", shards=3, least=4)
    texts = ["the first caption describes a robust encoder in detail", "another caption about a very long spectral cache line", "nothing alike here at all", "short", None]
    for i, t in enumerate(texts):
        held.add(held.stretches(_texts(spark, [(i, t)]), "rec_id", F.col("t")))
    assert 1 <= len(held.segments) <= 3
    new = _texts(spark, [(10, "We note that the FIRST caption describes a robust encoder, again a very long spectral cache"), (11, "entirely different words were used"), (12, None), (13, ""), (14, "here at all")])
    for h in (held, history.History.open(spark, f"file://{tmp_path}/history")):
        got = {r["owner"]: (r["covered"], r["match"]) for r in history.coverage(h.lookup(h.stretches(new, "rec_id", F.col("t")))).collect()}
        assert got == {10: (12, 0)}
    again = history.History.open(spark, f"file://{tmp_path}/history")
    again.add(again.stretches(_texts(spark, [(20, "entirely different words were used")]), "rec_id", F.col("t")))
    got = {r["owner"]: r["match"] for r in history.coverage(again.lookup(again.stretches(new, "rec_id", F.col("t")))).collect()}
    assert got == {10: 0, 11: 20}


def test_windows_against_looking_them_up(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))) for _ in range(120)] + ["same words in very many records of all"] * 60
    rows = [(i, i % 4, t, "x") for i, t in enumerate(texts)]
    rows = [(r[1] * 1000 + r[0], *r[1:]) for r in rows] + [(9000, None, "a b c d e", "x"), (9001, 1, None, "x")]
    df = spark.createDataFrame(rows, "rec_id LONG, batch_no INT, caption STRING, owner STRING")
    got = {r["key"]: (r["n_words"], r["n_covered"], r["match"]) for r in history.covered_by_history(df, "rec_id", "batch_no", "caption", least=4, share=0.5, shards=5).collect()}
    first, want = {}, {}
    for b in range(4):
        now = [(i, t.split()) for i, n, t, _ in rows if n == b and t]
        for i, w in now:
            hit = [(k, first[tuple(w[k : k + 4])]) for k in range(len(w) - 3) if tuple(w[k : k + 4]) in first]
            covered = len({k + j for k, _ in hit for j in range(4)})
            if hit and covered >= 0.5 * len(w):
                want[i] = (len(w), covered, min(m for _, m in hit))
        for i, w in now:
            for k in range(len(w) - 3):
                first.setdefault(tuple(w[k : k + 4]), i)
    assert got == want
    assert history.covered_by_history(df.limit(0), "rec_id", "batch_no", "caption").count() == 0


def test_large_segments_are_not_rewritten_for_small_ones(spark, tmp_path):
    held = history.History(spark, f"file://{tmp_path}/h", shards=2)
    names = []
    for n, many in enumerate((400, 20, 20, 20)):
        rows = spark.range(many).select((F.col("id") + 1000 * n).alias("o"), F.unhex(F.md5(F.concat_ws("-", F.lit(n), "id"))).alias("f"))
        held.add(held.stretches(rows, "o", F.col("f")))
        names.append([name for name, _ in held.segments])
    assert all(x[0] == names[0][0] for x in names) and len(names[-1]) == 3
