"""Operators on pages, images, index, votes and generation."""

import uuid

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfig.fakes import HashEmbedder, RawGrey, Script, ThinGrey
from lumenfig.operators import enrich, grouped, images, index, layout, ratings, search
from lumenfig.sources import files, manifests

A, B, C = [0, 0, 100, 10], [10, 0, 110, 10], [-10, 0, 90, 10]


def test_greedy_dedup_isnt_textbook_suppression():
    assert grouped.greedy_keep(np.array([A, B, C], float), np.array([0.5, 0.9, 0.4])).tolist() == [False, True, False]


def test_contained_depends_on_order():
    a, b, c = [0, 0, 100, 10], [8, 0, 128, 10], [18, 0, 148, 10]
    assert grouped.uncontained_keep(np.array([a, b, c], float)).tolist() == [False, False, True]
    assert grouped.uncontained_keep(np.array([b, a, c], float)).tolist() == [False, True, True]


def _boxes(spark, rows, extra=""):
    return spark.createDataFrame([("d", 1, i, *map(float, r[:4]), *r[4:]) for i, r in enumerate(rows)], f"doc_id STRING, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE{extra}")


def test_streamed_pages_equal_single_pages(spark):
    rng = np.random.default_rng(4)
    rows = [(f"d{p % 7}", p, o, *map(float, (x := rng.integers(0, 40), y := rng.integers(0, 40), x + rng.integers(20, 60), y + rng.integers(20, 60))), float(rng.integers(1, 9))) for p in range(300) for o in range(6)]
    df = spark.createDataFrame(rows, "doc_id STRING, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, score DOUBLE")
    want = set()
    for p in range(300):
        of = [r for r in rows if r[1] == p]
        keep = grouped.greedy_keep(np.array([r[3:7] for r in of]), np.array([r[7] for r in of]), 0.5)
        want |= {(p, r[2]) for r, k in zip(of, keep) if k}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert {(r["page"], r["ord"]) for r in grouped.dedup_greedy(df, 0.5).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert grouped.dedup_greedy(df.limit(0)).count() == 0


def test_nearest_caption_and_its_bounds(spark):
    fig = _boxes(spark, [(0, 0, 100, 50)])
    caps = _boxes(spark, [(0, 60, 100, 70), (0, 60, 100, 70), (0, 270, 100, 280)])
    assert [r["cap_ord"] for r in layout.caption_below(fig, caps).collect()] == [0]
    for gap, hit in ((-10, 1), (450, 1), (-10.01, 0), (450.01, 0)):
        assert layout.caption_below(fig, _boxes(spark, [(0, 50 + gap, 100, 70 + gap)])).count() == hit


def test_merge_by_caption(spark):
    rows = _boxes(spark, [(0, 0, 10, 10, 0.3, "Fig. A"), (5, -5, 8, 20, 0.7, "fig.  a")], ", score DOUBLE, caption STRING")
    assert [tuple(r) for r in layout.merged_by_caption(rows).select("x0", "y0", "x1", "y1", "score", "caption").collect()] == [(0, -5, 10, 20, 0.7, "Fig. A")]


def test_drawing_bounds_are_strict(spark):
    rows = _boxes(spark, [(0, 0, 10, 5), (0, 0, 95, 10), (0, 0, 10, 6)])
    assert [r["ord"] for r in layout.drawings_kept(rows, F.lit(1000.0)).collect()] == [2]


def test_text_is_taken_in_or_given_way_to():
    fig = np.array([100, 100, 300, 300], float)
    short = (np.array([90, 150, 130, 160], float), layout.PLAIN, 3, False)
    long = (np.array([100, 280, 300, 340], float), layout.PLAIN, 90, False)
    assert grouped.unsliced(fig, [short], 1000, 1000).tolist() == [86, 100, 300, 300]
    assert grouped.unsliced(fig, [long], 1000, 1000).tolist() == [100, 100, 300, 276]


def test_gaps_of_profiles():
    p = np.zeros(100)
    p[40:47] = 1
    assert images.count_gaps(p) == 1
    q = np.zeros(100)
    q[[0, 1, 2, 98, 99]] = 1
    assert images.count_gaps(q) == 0
    grey = np.zeros((100, 200), np.uint8)
    grey[:, 95:105] = 255
    assert images.count_panels(grey) == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 9), st.integers(0, 9), st.integers(-2, 9), st.integers(-2, 9))
def test_rectangles_of_prefix_sums(x, y, w, h):
    grey = np.random.default_rng(1).integers(0, 255, (10, 10)).astype(np.uint8)
    x1, y1 = min(10, x + w), min(10, y + h)
    want = int((grey[y:y1, x:x1] < 245).sum()) if x1 > x and y1 > y else 0
    assert int(images.rect_sum(images.prefix_sums(grey), x, y, x1, y1)) == want


def test_growth_stops_at_wide_gaps_and_barriers():
    grey = np.full((600, 200), 255, np.uint8)
    grey[300:500, 50:150] = 0
    grey[20:30, 50:150] = 0
    sums = images.prefix_sums(grey)
    assert images.grown(sums, [50, 480, 150, 500])[1] in range(288, 302)
    # Strips start at 470 and step by 4, so the last one at or below the barrier of 400 starts at 402.
    assert images.grown(sums, [50, 480, 150, 500], top=400)[1] == 402
    assert images.grown(sums, [60, 480, 140, 500])[2] >= 150


def test_images_as_columns(spark):
    codec = RawGrey()
    grey = np.full((40, 60), 255, np.uint8)
    df = spark.createDataFrame([("d", 1, 0, 5.0, 5.0, 25.0, 15.0, bytearray(codec.pack(grey)))], "doc_id STRING, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, png BINARY")
    assert codec.grey(bytes(images.crops(df, codec).first()["png"])).shape == (10, 20)
    broken = spark.createDataFrame([(bytearray(b"x"),), (None,)], "png BINARY")
    assert [r[0] for r in broken.select(images.panels(F.col("png"), codec)).collect()] == [1, 1]


def test_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0]), (6, [float("nan"), 1.0])], "id INT, embedding ARRAY<FLOAT>")
    hits = search.knn(df, [1.0, 0.0], "id", k=2)
    assert [(r["id"], r["score"]) for r in hits.collect()] == [(1, 1.0), (5, 1.0)]
    assert search.above(search.knn(df, [1.0, 0.0], "id")).count() == 2


def test_index_build(spark, tmp_path):
    def records(rows):
        return spark.createDataFrame(rows, "id INT, doc_id STRING, source_pdf STRING, source_pdf_url STRING, page INT, image_path STRING, caption STRING, description2 STRING, description3 STRING, questions ARRAY<STRING>")

    path = f"file://{tmp_path}/index"
    one = (1, "d", "s", "u", 1, "a", "first", None, "", ["q"])
    assert index.build(spark, path, records([one, one, (2, "d", "s", "u", 1, "b", "bad", None, None, None)]), HashEmbedder(8, fail_on="bad")) == (0, 1)
    again = records([(1, "d", "s", "u", 1, "a", "changed", None, None, None), (3, "d", "s", "u", 2, "c", None, None, None, [])])
    assert index.build(spark, path, again, HashEmbedder(8)) == (1, 2)
    assert {r["figure_key"]: r["caption"] for r in spark.read.parquet(path).collect()} == {"d_1": "first", "d_3": ""}
    assert index.build(spark, path, again, HashEmbedder(8), force=True) == (2, 2)
    assert {r["caption"] for r in spark.read.parquet(path).collect()} == {"changed", ""}


def test_votes(spark, tmp_path):
    path = f"file://{tmp_path}/votes"
    assert ratings.append(spark, path, "q", "p", 5, "t") == 1
    assert ratings.append(spark, path, "q", "p", 5, "t") == 2
    for bad in (0, 6):
        with pytest.raises(ValueError):
            ratings.append(spark, path, "q", "p", bad, "t")
    df = spark.createDataFrame([('a "q", b', "x\\y", 3, "t")], ratings.RATING_SCHEMA)
    ratings.export_csv(df, f"file://{tmp_path}/csv")
    # Each task writes a file with a header; those of empty partitions hold nothing else.
    text = max((f.read_bytes().decode() for f in (tmp_path / "csv").glob("part-*")), key=len)
    assert text == 'Timestamp,Query,Ruta_Imagen,Estrellas\r\nt,"a ""q"", b",x\\y,3\r\n'


def test_generation(spark):
    good = "A bar chart compares the loss of several models over many settings."
    model = Script([("Reason: length", good), ("first", " ".join(["word"] * 40) + "."), ("second", RuntimeError("down")), ("third", "Nope.")])
    rows = spark.createDataFrame([(1, "first caption", "old"), (2, "second caption", "old"), (3, "third caption", None), (4, " ", "old")], "id INT, caption STRING, description2 STRING")
    got = {r["id"]: (r["description2"], r["error"] is not None) for r in enrich.describe_captions(rows, model).collect()}
    assert got == {1: (good, False), 2: ("old", True), 3: ("Nope.", False), 4: ("", False)}


def test_services():
    class Busy:
        def __init__(self, times, status):
            self.left, self.status = times, status

        def complete(self, prompt, image):
            self.left -= 1
            if self.left >= 0:
                raise enrich.ServiceError(self.status)
            return "ok"

    waits = []
    assert enrich.Patient(Busy(2, 503), sleep=waits.append).complete("p", None) == "ok" and waits == [2.5, 5.0]
    with pytest.raises(enrich.ServiceError):
        enrich.Patient(Busy(1, 404), sleep=waits.append).complete("p", None)
    chain = enrich.Cascade([Script([], ""), Script([("p", RuntimeError())])], Script([], "text"))
    assert chain.complete("p", b"i") == "text" and chain.complete("p", None) == "text"


def test_manifests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "manifest.json").write_text('[{"id": 1, "doc_id": "a", "page": 2, "caption": "é"}, {"id": 2, "doc_id": "a"}]')
    (tmp_path / "b" / "manifest.json").write_text('[{"id": 1, "doc_id": "b"')
    assert manifests.read(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception):
        manifests.read(spark, str(tmp_path), on_error="raise").collect()
    docs = spark.createDataFrame([("a",), ("empty",)], "doc_id STRING")
    manifests.write_lists(manifests.read(spark, str(tmp_path)), docs, str(tmp_path / "out"))
    assert (tmp_path / "out" / "empty" / "manifest.json").read_text() == "[]"
    assert "é" in (tmp_path / "out" / "a" / "manifest.json").read_text()


def test_files(spark, tmp_path):
    (tmp_path / "X" / "images").mkdir(parents=True)
    (tmp_path / "X" / "images" / "p.png").write_bytes(b"png")
    rows = spark.createDataFrame([("../data/X/images/p.png", None, None, "X"), (None, None, "p.png", "X"), (None, None, None, None)], "image_path STRING, path_rel STRING, file STRING, doc_id STRING")
    got = files.with_image(rows, files.images(spark, str(tmp_path)), str(tmp_path)).collect()
    assert sorted(r["image_file"] or "" for r in got) == ["", str(tmp_path / "X/images/p.png"), str(tmp_path / "X/images/p.png")]
    assert files.one_file(spark, str(tmp_path), "/data/X/images/p.png") == b"png"
    with pytest.raises(ValueError):
        files.one_file(spark, str(tmp_path), "../data/../../etc/passwd")
    assert files.first_image(spark, str(tmp_path)) == b"png"


def test_vote_stream(spark, tmp_path):
    import uuid

    from lumenfig.streaming import votes

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"query":"q","image_path":"p","score":4,"timestamp":"2033-02-25T07:00:25"}\n{"query":"q","image_path":"p","score":9,"timestamp":"x"}\n')
    votes.append(votes.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), f"votes-{uuid.uuid4().hex}").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert [(r["votes"], r["score"]) for r in votes.counted(spark.read.parquet(str(tmp_path / "out"))).collect()] == [(1, 4.0)]


def test_answers_and_files(spark, tmp_path):
    from lumenfig.sources import sinks

    made = HashEmbedder(16)
    rows = [("d_1", "../data/d/images/a.png", "d", 1, "robust encoder loss", "u"), ("d_2", "../data/d/images/b.png", "d", 2, "other things", "u")]
    df = spark.createDataFrame([(*r, made.embed([r[4]])[0]) for r in rows], "figure_key STRING, image_path STRING, doc_id STRING, page INT, caption STRING, source_pdf_url STRING, embedding ARRAY<FLOAT>")
    got = search.answer(df, made, "robust encoder loss", "http://h").collect()
    assert got[0]["image_url"] == "http://h/images/d/images/a.png" and got[0]["score"] == 1.0
    with pytest.raises(ValueError):
        search.answer(df, made, " ", "http://h")
    shown = []
    search.session(df, made, ["", "robust encoder loss ", "SALIR", "x"], lambda q, hits: shown.append((q, len(hits))))
    assert shown == [("robust encoder loss", 2)]
    figs = spark.createDataFrame([("d", 3, 1, bytearray(b"x"))], "doc_id STRING, page INT, id INT, png BINARY")
    assert sinks.write_crops(figs, str(tmp_path)) == 1 and sinks.write_pages(figs, str(tmp_path)) == 1
    assert (tmp_path / "d" / "images" / "p0003_figure_00001.png").read_bytes() == b"x"


def test_tables_within_the_padding_of_each_other(spark):
    figs = spark.createDataFrame([("d", 1, 0, 0.0, 100.0, 100.0, 300.0, 100.0), ("d", 1, 1, 0.0, 100.0, 100.0, 300.0, 60.0)], "doc_id STRING, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, y0_base DOUBLE")
    tables = _boxes(spark, [(0, 50, 100, 101), (0, 60, 100, 102.5), (0, 60, 100, 110), (0, 20, 30, 112.5)])
    # 101 moves the edge to 103, which 102.5 no longer reaches; 110 moves it to 112, and 112.5 lies beyond the first top by more than 12.
    assert {r["ord"]: r["y0"] for r in layout.clipped_top(figs, tables).collect()} == {0: 112.0, 1: 100.0}
    assert {r["ord"]: r["y0"] for r in layout.clipped_top(figs, tables.where("ord < 2")).collect()} == {0: 103.0, 1: 100.0}


def test_search_in_batches_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [1.0]), (903, [float("nan")] * 8)]
    index_ = spark.createDataFrame(rows, "id INT, embedding ARRAY<FLOAT>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in rows if i % 20 == 0 or i > 900], "q STRING, embedding ARRAY<FLOAT>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = set()
    for i in range(0, 300, 20):
        s = (1 + u @ u[i]) / 2
        want |= {(f"q{i}", j, n + 1) for n, j in enumerate(sorted(range(300), key=lambda j: (-round(s[j], 12), j))[:5])}
    for first, values in ((10_000, 8_000_000), (3, 8_000_000), (3, 40)):
        monkeypatch.setattr(search, "FIRST_QUERIES", first)
        monkeypatch.setattr(search, "QUERY_VALUES", values)
        assert {(r["query_key"], r["hit_key"], r["rank"]) for r in search.knn_batch(index_, asked, "id", "q").collect()} == want
    assert search.knn_batch(index_, asked.limit(0), "id", "q").count() == 0 and search.knn_batch(index_.limit(0), asked, "id", "q").count() == 0


def test_search_in_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    x = np.repeat(base, 50, axis=0) + 0.3 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "id INT, embedding ARRAY<FLOAT>")
    made = search.Cells.build(df, f"file://{tmp_path}/cells", 16, cells=32)
    again = search.Cells(spark, f"file://{tmp_path}/cells")
    assert again.rows.count() == 2000
    hit = 0
    for i in range(0, 2000, 200):
        exact = {r["id"] for r in search.knn(df, x[i].tolist(), "id").collect()}
        assert {r["id"] for r in again.knn(x[i].tolist(), "id", probes=32).collect()} == exact
        hit += len(exact & {r["id"] for r in made.knn(x[i].tolist(), "id", probes=4).collect()})
    assert hit >= 45


def _index_records(spark, rows):
    return spark.createDataFrame(rows, "id INT, doc_id STRING, source_pdf STRING, source_pdf_url STRING, page INT, image_path STRING, caption STRING, description2 STRING, description3 STRING, questions ARRAY<STRING>")


def test_a_failed_build_leaves_the_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    one, two, three = ((i, "d", "s", "u", i, "a", f"caption {i}", None, "", ["q"]) for i in (1, 2, 3))
    assert index.build(spark, path, _index_records(spark, [one, two]), HashEmbedder(8), dim=8) == (0, 2)
    # Another length of vectors fails before anything changes.
    with pytest.raises(ValueError):
        index.build(spark, path, _index_records(spark, [one, three]), HashEmbedder(16))
    assert {r["figure_key"] for r in spark.read.parquet(path).collect()} == {"d_1", "d_2"}
    # A run that was stopped between its two renames left the index beside its path.
    (tmp_path / "index").rename(tmp_path / "index.old")
    assert index.build(spark, path, _index_records(spark, [one, three]), HashEmbedder(8)) == (2, 2)
    assert {r["figure_key"] for r in spark.read.parquet(path).collect()} == {"d_1", "d_3"}
    assert not [p for p in tmp_path.iterdir() if p.name != "index"]
    # New keys alone are added as files of their own.
    held = {p.name for p in (tmp_path / "index").glob("*.parquet")}
    assert index.build(spark, path, _index_records(spark, [one, two, three]), HashEmbedder(8)) == (2, 3)
    assert held < {p.name for p in (tmp_path / "index").glob("*.parquet")}
    with pytest.raises(ValueError):
        index.build(spark, f"{path}2", _index_records(spark, [one]), HashEmbedder(8), dim=4)
        index.build(spark, f"{path}2", _index_records(spark, [one]), HashEmbedder(8), dim=4, force=True)
        index.dimension(spark.read.parquet(f"{path}2"))


def test_texts_are_embedded_by_batch(spark):
    class Whole:
        def embed(self, texts):
            if len(texts) == 1 and texts[0] != "alone":
                raise ValueError("one text")
            if "bad" in texts:
                raise ValueError("bad text")
            return [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "ccc"])], "id INT, full_text STRING").coalesce(1)
    assert [(r["embedding"], r["error"]) for r in index.embedded(df, Whole()).orderBy("id").collect()] == [([1.0, 3.0], None), ([2.0, 3.0], None), ([3.0, 3.0], None)]
    mixed = spark.createDataFrame([(0, "bad"), (1, "alone")], "id INT, full_text STRING").coalesce(1)
    assert [(r["embedding"], r["error"]) for r in index.embedded(mixed, Whole()).orderBy("id").collect()] == [(None, "ValueError: one text"), ([5.0, 1.0], None)]


def test_what_is_there_is_not_asked_for_again(spark):
    rows = spark.createDataFrame([(1, "a caption", "kept"), (2, "a caption", " "), (3, "", None), (4, " ", "kept too")], "id INT, caption STRING, description2 STRING")
    said = "A bar chart compares the loss of several models over many settings."
    got = {r["id"]: r["description2"] for r in enrich.describe_captions(rows, Script([], said), force=False).collect()}
    assert got == {1: "kept", 2: said, 3: "", 4: "kept too"}
    assert enrich.describe_captions(rows, Script([], said), force=False).columns == [*rows.columns, "reason", "error"]


def test_forms_and_times_of_requests():
    import time

    class Form:
        def __init__(self, status):
            self.status = status

        def complete(self, prompt, image):
            if self.status:
                raise enrich.ServiceError(self.status)
            return "ok"

    for status in (400, 422):
        assert enrich.TwoForms(Form(status), Form(0)).complete("p", b"i") == "ok"
    with pytest.raises(enrich.ServiceError):
        enrich.TwoForms(Form(404), Form(0)).complete("p", b"i")

    class Slow:
        def complete(self, prompt, image):
            time.sleep(0.4)
            return "late"

    assert enrich.InTime(Slow(), 5).complete("p", None) == "late"
    with pytest.raises(TimeoutError):
        enrich.InTime(Slow(), 0.05).complete("p", None)


def test_manifest_lists_change_only_with_their_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (1, "b", "y")], "id INT, doc_id STRING, caption STRING")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id STRING")
    assert manifests.write_lists(rows, docs, str(tmp_path)) == 3
    at = (tmp_path / "a" / "manifest.json").stat().st_mtime_ns
    assert manifests.write_lists(rows, docs, str(tmp_path)) == 0
    assert manifests.write_lists(rows.withColumn("caption", F.when(F.col("doc_id") == "b", "z").otherwise(F.col("caption"))), docs, str(tmp_path)) == 1
    assert (tmp_path / "a" / "manifest.json").stat().st_mtime_ns == at and not list(tmp_path.rglob("*.json.*"))
    (tmp_path / "empty").mkdir()
    assert manifests.resolved_root(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/empty", f"file://{tmp_path}"]) == f"file://{tmp_path}"
    assert manifests.resolved_root(spark, [f"file://{tmp_path}/none"]) is None
    seen = rows.withColumn("image_file", F.when(F.col("caption") == "x", "p"))
    assert {tuple(r) for r in manifests.counted(seen).collect()} == {("a", 2, 1, 1), ("b", 1, 0, 0)}


def test_pages_from_a_renderer_and_a_detector(spark):
    from lumenfig.sources import pages

    class Renderer:
        def pages(self, content, dpi):
            if content == b"broken":
                raise ValueError("unreadable")
            for p in (1, 2):
                yield pages.PageParts(p, 500, 250, b"png%d" % p, [(0, 0, 72, 36, " one \n block "), (0, 0, 1, 1, "  ")], [(0, 0, 10, 10), (0, 0, 1, 1), (0, 0, 144, 72)], [(0, 0, 36, 72)])

    class Detector:
        def detect(self, png, size, least):
            return [(3, 0.9, 1, 2, 3, 4), (4, least, 5, 6, 7, 8)] if png == b"png1" else []

    docs = spark.createDataFrame([("d", bytearray(b"ok")), ("e", bytearray(b"broken"))], "doc_id STRING, content BINARY")
    made = pages.rendered(docs, Renderer(), dpi=250)
    assert {(r["doc_id"], r["page"], r["width"]) for r in made.collect()} == {("d", 1, 500), ("d", 2, 500)}
    assert {(r["page"], r["ord"], r["text"], r["x1"], r["y1"]) for r in pages.blocks(made, 250).collect()} == {(p, 0, "one block", 250.0, 125.0) for p in (1, 2)}
    # The page has 144 by 72 points: a drawing of 100 square points stays, one of 1 and one of the whole page don't.
    assert [round(r["x1"], 3) for r in pages.drawings(made, 250).collect()] == [round(10 * 250 / 72, 3)] * 2
    assert {(r["page"], r["x1"]) for r in pages.watermark_hits(made, 250).collect()} == {(1, 125.0), (2, 125.0)}
    assert [tuple(r) for r in pages.detected(made, Detector()).orderBy("ord").collect()] == [("d", 1, 0, 3, 0.9, 1.0, 2.0, 3.0, 4.0), ("d", 1, 1, 4, 0.15, 5.0, 6.0, 7.0, 8.0)]


def test_answers_to_requests(spark, tmp_path):
    from lumenfig.operators import service

    made = HashEmbedder(16)
    df = spark.createDataFrame([("d_1", "../data/d/a.png", "d", 1, "robust loss", "u", made.embed(["robust loss"])[0])], "figure_key STRING, image_path STRING, doc_id STRING, page INT, caption STRING, source_pdf_url STRING, embedding ARRAY<FLOAT>")
    status, body = service.search(df, made, {"query": "robust loss"}, "http://h")
    assert status == 200 and body["results"][0]["image_url"] == "http://h/images/d/a.png"
    assert [service.search(df, made, b)[0] for b in ({"query": " "}, {}, {"query": 3}, None, [])] == [400, 422, 422, 422, 422]
    assert service.search(df, HashEmbedder(16, fail_on="loss"), {"query": "loss"})[0] == 500
    path = f"file://{tmp_path}/votes"
    vote = {"query": "q", "image_path": "p", "score": 4}
    assert service.vote(spark, path, vote, "t") == (200, {"votes": 1}) and service.vote(spark, path, vote, "t") == (200, {"votes": 2})
    assert [service.vote(spark, path, vote | x, "t")[0] for x in ({"score": 6}, {"score": "4"}, {"score": True})] == [400, 422, 422]
    assert ratings.compact(spark, path) == 2 and len(list((tmp_path / "votes").glob("*.parquet"))) == 1
    (tmp_path / "a.png").write_bytes(b"png")
    assert service.image(spark, str(tmp_path), "data/a.png") == (200, b"png")
    assert service.image(spark, str(tmp_path), "data/none.png")[0] == 404 and service.image(spark, str(tmp_path), "../data/../../etc/passwd")[0] == 404


def test_growth_of_boxes_over_their_pages(spark):
    codec = RawGrey()
    grey = np.full((300, 300), 255, np.uint8)
    grey[100:140, 120:180] = 0
    pages = spark.createDataFrame([("d", 1, bytearray(codec.pack(grey))), ("d", 1, bytearray(codec.pack(grey))), ("d", 3, None)], "doc_id STRING, page INT, png BINARY")
    figs = spark.createDataFrame([("d", p, o, 130.0, 120.0, 150.0, 138.0, 0.0, 0.0, 300.0, "x") for p, o in ((1, 0), (1, 1), (2, 0), (3, 0))], "doc_id STRING, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, top DOUBLE, left DOUBLE, right DOUBLE, caption STRING")
    want = images.grown(images.prefix_sums(grey), [130, 120, 150, 138], 0, 0, 300)
    got = {(r["page"], r["ord"]): [r["x0"], r["y0"], r["x1"], r["y1"]] for r in images.expand_by_content(figs, pages, codec).collect()}
    assert got == {(1, 0): want, (1, 1): want, (2, 0): [130, 120, 150, 138], (3, 0): [130, 120, 150, 138]}
    wide = spark.createDataFrame([(bytearray(codec.pack(np.zeros((10, 2048), np.uint8))),), (bytearray(b"x"),), (None,)], "png BINARY")
    assert [None if r[0] is None else codec.grey(bytes(r[0])).shape for r in wide.select(images.payloads(F.col("png"), codec)).collect()] == [(5, 1024), None, None]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_growth_over_dark_pixels_is_growth_over_prefix_sums(seed):
    rng = np.random.default_rng(seed)
    grey = np.full((300, 280), 255, np.uint8)
    for x, y, w, h in rng.integers(0, 270, (rng.integers(0, 8), 4)):
        grey[y : y + h // 3, x : x + w // 3] = rng.integers(0, 255)
    x0, y0, top, left = (int(v) for v in rng.integers(0, 260, 4))
    box, right = [x0, y0, min(280, x0 + int(rng.integers(0, 90))), min(300, y0 + int(rng.integers(0, 90)))], int(rng.integers(0, 281))
    allow = int(rng.choice([4, 20, 200]))
    assert images.grown(grey < images.WHITE, box, top, left, right, allow=allow) == images.grown(images.prefix_sums(grey), box, top, left, right, allow=allow)
    assert (ThinGrey().grey(ThinGrey().pack(grey)) == grey).all()


def test_each_raster_is_read_once_a_pass(spark, tmp_path):
    from lumenfig.operators import extract

    class Counted(ThinGrey):
        def grey(self, content):
            (tmp_path / uuid.uuid4().hex).touch()
            return super().grey(content)

    page = "doc_id STRING, page INT, ord INT, "
    xy = "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
    boxes = spark.createDataFrame([("d", 2, 0, 3, 0.9, 100.0, 100.0, 300.0, 200.0)], f"{page}cls INT, score DOUBLE, {xy}")
    blocks = spark.createDataFrame([("d", 2, 0, "Figure 1: yield", 100.0, 210.0, 300.0, 230.0), ("d", 3, 0, "plain words", 100.0, 210.0, 300.0, 230.0)], f"{page}text STRING, {xy}")
    none = spark.createDataFrame([], f"doc_id STRING, page INT, {xy}")
    pages = spark.createDataFrame([("d", 2, bytearray(ThinGrey().pack(np.zeros((620, 620), np.uint8))))], "doc_id STRING, page INT, png BINARY")
    got = extract.figures(pages, boxes, blocks, none, none, 620, 620, Counted()).collect()
    assert [(r["page"], r["id"], r["caption"]) for r in got] == [(2, 1, "Figure 1: yield")] and len(list(tmp_path.iterdir())) == 1


def test_rasters_are_never_broadcast(spark):
    codec = RawGrey()
    grey = np.full((300, 300), 255, np.uint8)
    grey[100:140, 120:180] = 0
    pages = spark.range(3).mapInPandas(lambda frames: (pd.DataFrame({"doc_id": "d", "page": f["id"], "png": [codec.pack(grey)] * len(f)}) for f in frames), "doc_id STRING, page INT, png BINARY")
    figs = spark.range(2000).select(F.lit("d").alias("doc_id"), (F.col("id") % 200).cast("int").alias("page"), F.col("id").cast("int").alias("ord"), *[F.lit(v).alias(c) for c, v in zip(images.EDGES, (130.0, 120.0, 150.0, 138.0, 0.0, 0.0, 300.0))])
    got = images.expand_by_content(figs, pages, codec)
    assert got.where("y0 < 120").count() == 30 and got.count() == 2000
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and "BuildLeft" not in plan and "Inner" not in plan


def test_least_score_comes_after_the_limit(spark):
    hits = spark.createDataFrame([(i, v) for i, v in enumerate((0.9, 0.8, 0.7, 0.7, 0.7))], "id INT, score DOUBLE")
    assert search.above(hits).count() == 2


def test_gaps_of_rows(spark):
    rows = [("a", i, float(40 <= i <= 46)) for i in range(100)] + [("b", i, float(i in (0, 1, 2, 98, 99))) for i in range(100)]
    df = spark.createDataFrame(rows, "key STRING, at INT, value DOUBLE")
    assert {tuple(r) for r in images.gap_islands(df, "key", "at", lambda: F.col("value") >= 1).collect()} == {("a", 1), ("b", 0)}


def test_nearest_of_the_test_vectors(spark):
    import os

    data = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(data):
        pytest.skip("no test data")
    rows = spark.read.parquet(data)
    got = search.knn(rows, rows.where("vec_id = 0").first()["embedding"], "vec_id").collect()
    assert [r["vec_id"] for r in got] == [0, 365, 334, 387, 423]
    assert [r["score"] for r in got] == pytest.approx([1.0, 0.684997, 0.681361, 0.665569, 0.648467], abs=1e-6)
