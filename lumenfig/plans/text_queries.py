"""Queries over texts, checks, index, votes and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfig.fakes import HashEmbedder, Script
from lumenfig.functions import text as T
from lumenfig.functions import validators as V
from lumenfig.operators import enrich, index, ratings, search
from lumenfig.sources import files, manifests
from lumenfig.sources.tables import table
from lumenfig.workdir import Workdir


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, n, caption, q): every question of every record."""
    return _manifest(spark, sf_dir).select("rec_id", "caption", F.posexplode("questions").alias("n", "q"))


def _panels(column: str) -> Column:
    """A number of panels from a number of the row, null where that is null."""
    return F.pmod(F.col(column), F.lit(4)).cast("int")


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every passage, whether it is one sentence, and its clean length."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.word_count(F.col("text")).alias("words"), T.is_one_sentence(F.col("text")).alias("one"), F.length(T.clean(F.col("text"))).alias("size"))


def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with white space collapsed; quotes around a text and a model's preamble removed."""
    d = _manifest(spark, sf_dir)
    said = F.concat(F.lit(' Here is the revised output: "'), F.col("description2"), F.lit('"\n'))
    quoted = F.concat(F.lit('"'), F.col("description3"), F.lit('" '))
    return d.select("rec_id", T.clean(F.col("caption")).alias("caption"), T.model_output(said).alias("said"), T.unquoted(quoted).alias("unquoted"))


def description_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each description made from the caption fails."""
    d = _manifest(spark, sf_dir)
    return d.select("rec_id", V.caption_description_failure(F.col("description2"), F.col("caption")).alias("reason"))


def image_description_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each description made with the image fails; records have zero to three panels by their page."""
    d = _manifest(spark, sf_dir)
    return d.select("rec_id", V.image_description_failure(F.col("description3"), _panels("page")).alias("reason"))


def passage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of every passage: Spanish, numbered figures, filler, pipeline, length, single panels."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", V.looks_spanish(t).alias("spanish"), V.mentions_figures(t).alias("figures"), V.looks_generic(t).alias("generic"), V.stray_pipeline(t, F.col("source")).alias("pipeline"), V.too_long(t).alias("long"),
        V.contradicts_panels(t, _panels("doc_id")).alias("single"),
    )


def anchor_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten anchor words of every caption, with their place."""
    d = _manifest(spark, sf_dir).select("rec_id", F.posexplode(T.anchor_terms(F.col("caption"))).alias("place", "term"))
    return d


def anchored_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question has an anchor of its caption."""
    return _asked(spark, sf_dir).select("rec_id", "n", T.has_anchor(F.col("q"), T.anchor_terms(F.col("caption"))).alias("anchored"))


def bad_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question is rejected; records have zero to three panels by their number."""
    return _asked(spark, sf_dir).select("rec_id", "n", V.bad_question(F.col("q"), F.col("caption"), _panels("rec_id")).alias("bad"))


def normalized_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a large first letter and one mark at the end."""
    return _asked(spark, sf_dir).select("rec_id", "n", T.normalize_question(F.lower("q")).alias("q"), T.with_mark(F.coalesce("q", F.lit(""))).alias("marked"))


def similar_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the two questions of a record are, by matching blocks."""
    d = _manifest(spark, sf_dir).where("size(questions) = 2").select("rec_id", F.col("questions")[0].alias("a"), F.col("questions")[1].alias("b"))
    return d.select("rec_id", F.round(T.similarity("a", "b"), 6).alias("ratio"))


def question_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question pairs from a model's answer, read whole, between braces, or not at all."""
    d = _manifest(spark, sf_dir).select("rec_id", F.col("caption").alias("c"))
    body = F.to_json(F.struct(F.coalesce("c", F.lit("")).alias("q1"), F.lit("Why so?").alias("q2")))
    kind = F.col("rec_id") % 3
    answer = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise("no json")
    pair = T.question_pair(answer)
    return d.select("rec_id", pair["q1"].alias("q1"), pair["q2"].alias("q2"))


def caption_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of figure that each caption suggests."""
    return _manifest(spark, sf_dir).select("rec_id", T.hint(F.col("caption")).alias("hint"))


def fallback_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general questions of every caption."""
    q = T.fallback_questions(F.col("caption"), F.col("collector"))
    return _manifest(spark, sf_dir).select("rec_id", q[0].alias("q1"), q[1].alias("q2"))


def labels_and_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether passages and captions look like labels, figure captions or table captions."""
    return _manifest(spark, sf_dir).select("rec_id", T.looks_like_label(F.col("caption")).alias("label"), T.looks_like_label(F.col("collector")).alias("short_label"), T.is_figure_caption(F.col("caption")).alias("figure"), T.is_table_caption(F.col("caption")).alias("in_table"))


def panel_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that name their panels first."""
    p = (F.col("rec_id") % 5).cast("int")
    d = _manifest(spark, sf_dir).where("description2 is not null")
    return d.select("rec_id", T.panel_prefix(p).alias("prefix"), T.with_panel_prefix(F.col("description2"), p).alias("text"))


def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is embedded, for every record."""
    return _manifest(spark, sf_dir).select("rec_id", T.full_text(*[F.col(c) for c in ("caption", "description2", "description3", "questions")]).alias("full_text"))


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents of the manifest, the first delivery of each key."""
    m = index.first_of_key(_manifest(spark, sf_dir).withColumn("k", T.figure_key(F.col("doc_id"), F.col("id"))), "k", ["rec_id"])
    return index.index_rows(m).drop("questions")


def index_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index keys without a manifest record."""
    return index.orphans(table(spark, sf_dir, "ragi_images"), index.index_rows(_manifest(spark, sf_dir)), "figure_key")


def index_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and captions of the index after an insert of the new ones."""
    old = table(spark, sf_dir, "ragi_images").select("figure_key", "caption")
    new = index.index_rows(_manifest(spark, sf_dir)).select("figure_key", "caption")
    return index.insert_if_absent(old, new, "figure_key")


def index_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and captions of the index after the manifest's rows took the place of theirs."""
    old = table(spark, sf_dir, "ragi_images").select("figure_key", "caption")
    new = index.index_rows(_manifest(spark, sf_dir)).select("figure_key", "caption")
    return index.upsert(old, new, "figure_key")


def index_without_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's rows that still have a record."""
    kept = index.without_orphans(table(spark, sf_dir, "ragi_images"), index.index_rows(_manifest(spark, sf_dir)), "figure_key")
    return kept.select("figure_key", "doc_id", "caption")


def index_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of new keys only, made after the anti-join."""
    new = index.absent(index.index_rows(_manifest(spark, sf_dir)), table(spark, sf_dir, "ragi_images"), "figure_key")
    got = index.embedded(index.first_of_key(new, "figure_key", ["page", "image_path"]), HashEmbedder())
    return got.select("figure_key", F.size("embedding").alias("dim"), "error")


def rating_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image addresses of votes, however their path was written, and whether the path leaves its root."""
    p = F.col("image_path")
    return table(spark, sf_dir, "rating").select("image_path", T.image_url(p, "http://host").alias("url"), T.escapes_root(p).alias("outside"))


def rating_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes as they are exported."""
    return ratings.export_rows(table(spark, sf_dir, "rating"))


def rating_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each vote is in range."""
    return table(spark, sf_dir, "rating").select("query", "image_path", "score", ratings.valid(F.col("score")).alias("valid"))


def rating_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as the page asks them, and as part of an address."""
    q = F.col("query")
    return table(spark, sf_dir, "rating").select("query", T.asked_as(q).alias("asked"), T.url_part(q).alias("part"), T.percent(F.col("score") / 7.0).alias("label"))


def content_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum and data address of every passage's bytes."""
    d = table(spark, sf_dir, "documents")
    data = F.encode("text", "UTF-8")
    return d.select("doc_id", F.md5(data).alias("md5"), F.md5(T.data_url(data, F.lit("a.jpg"))).alias("url_md5"))


def paths_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, names and addresses of every record, made from its paper, page and number."""
    m = _manifest(spark, sf_dir)
    return m.select(
        "rec_id", T.crop_name(F.col("page"), F.col("id")).alias("crop"), T.page_name(F.col("page")).alias("page_file"), T.paper_url(F.col("doc_id"), "https://papers.example.org/pdf").alias("url"), T.to_posix(F.col("image_path")).alias("posix"), T.figure_key(F.col("doc_id"), F.col("id")).alias("key"),
        T.short_caption(F.col("caption")).alias("short"), T.iso_local(F.col("extracted_at")).alias("at"),
    )


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of the embeddings for the vector of vec_id 0."""
    return _knn(spark, sf_dir, search.TOP_K)


def knn_topk_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 2, as the command line asks."""
    return _knn(spark, sf_dir, search.TOP_K_CLI)


def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the five figures most similar to the first one, those that reach the service's least score."""
    rows = table(spark, sf_dir, "ragi_images").dropDuplicates(["figure_key"])
    query = rows.where(search.usable(F.col("embedding"), 64)).orderBy("figure_key").select("embedding").first()[0]
    return search.above(search.knn(rows, query, "figure_key")).select("figure_key", F.round("score", 4).alias("score"))


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    query = rows.where(F.col("vec_id") == 0).first()["embedding"]
    return search.knn(rows, query, "vec_id", k=k).select("vec_id", F.round("score", 4).alias("score"))


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of the embeddings for the vector of vec_id 0 over an index laid out by cells, with all of them probed."""
    rows = table(spark, sf_dir, "embeddings")
    query = rows.where(F.col("vec_id") == 0).first()["embedding"]
    made = search.Cells.build(rows, f"{Workdir(spark, 'cells').path}/index", len(query))
    return made.knn(query, "vec_id", probes=len(made.centres)).select("vec_id", F.round("score", 4).alias("score"))


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of all vectors for every fiftieth."""
    rows = table(spark, sf_dir, "embeddings")
    got = search.knn_batch(rows, rows.where(F.col("vec_id") % 50 == 0), "vec_id", "vec_id")
    return got.select("query_key", "hit_key", "rank", F.round("score", 4).alias("score"))


def knn_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the figure index for one of its own vectors, as the service returns them; repeated rows count once."""
    rows = table(spark, sf_dir, "ragi_images").dropDuplicates(["figure_key"])
    query = rows.where(search.usable(F.col("embedding"), 64)).orderBy("figure_key").select("embedding").first()[0]
    hits = search.knn(rows, query, "figure_key")
    return hits.select(T.image_url(F.col("image_path"), "http://host").alias("image_url"), "image_path", "doc_id", "page", "source_pdf_url", F.round("score", 4).alias("score"))


#: Questions that the scripted model asks after a rejection.
ASKED = "How does the line change over the settings shown?", "Which curve lies highest at the threshold in this chart?"
#: What the scripted model answers after a rejection, and at first.
REPAIRED, DESCRIBED = "The chart compares two invented measures across several quiet settings.", "A bar chart compares several measures of one system over many settings."


def generated_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions generated with checks and repair by a scripted model."""
    model = Script([("Reason:", REPAIRED), ("taxonomy", RuntimeError("down")), ("timeline", "Too short.")], DESCRIBED)
    rows = _manifest(spark, sf_dir).select("rec_id", "caption", "description2")
    return enrich.describe_captions(rows, model).select("rec_id", "description2", "reason", "error")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked first about each record, by its caption, its image, and for questions."""
    c, n = F.coalesce("caption", F.lit("")), F.coalesce(_panels("page"), F.lit(1))
    d = _manifest(spark, sf_dir)
    return d.select("rec_id", enrich.caption_prompt(c).alias("by_caption"), enrich.image_prompt(c, n, F.col("collector")).alias("by_image"), enrich.question_prompt(c, n, F.col("collector"), T.anchor_terms(c)).alias("questions"))


def needed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose description is still to be made, and queries of nothing but white space are counted as blank."""
    return _manifest(spark, sf_dir).select("rec_id", enrich.needs(F.col("description2"), False).alias("needed"), enrich.needs(F.col("description2"), True).alias("forced"), (T.strip(F.col("caption")) == "").alias("blank"))


def _with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _manifest(spark, sf_dir)
    there = d.where("rec_id % 2 = 0 and image_path is not null").select(F.concat(F.when(F.col("rec_id") % 4 == 0, F.lit("/root/")).otherwise(""), F.when(F.col("rec_id") % 4 == 0, T.data_path(F.col("image_path"))).otherwise(T.to_posix(F.col("image_path")))).alias("path"))
    rows = d.select("rec_id", "doc_id", "caption", "image_path", F.lit(None).cast("string").alias("path_rel"), F.lit(None).cast("string").alias("file"))
    return files.with_image(rows, there, "/root")


def record_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place at which each record's image is found, as its path says or in the data folder."""
    return _with_images(spark, sf_dir).select("rec_id", "image_file")


def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each paper, those without a caption, and those with an image."""
    return manifests.counted(_with_images(spark, sf_dir))


def generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions generated with checks and repair by a scripted model: general ones where no answer passes, none where it is down."""
    model = Script([("Sketch", "no json"), ("Ablation", RuntimeError("down")), ("Reason:", '{"q1": "%s", "q2": "%s"}' % ASKED)], "{}")
    rows = _manifest(spark, sf_dir).select("rec_id", "caption", F.lit(None).cast("binary").alias("image"), F.lit(1).alias("panels"), F.lit(None).cast("string").alias("figure_type"))
    return enrich.ask_questions(rows, model).select("rec_id", "questions", "reason", "error")


QUERIES = {
    f.__name__: f
    for f in (
        text_measures, cleaned_text, description_failures, image_description_failures, passage_flags, anchor_terms, anchored_questions, bad_questions, normalized_questions, similar_questions, question_json, caption_hints, fallback_questions, labels_and_captions, panel_prefixes,
        full_texts, index_documents, index_orphans, index_inserted, index_upserted, index_without_orphans, index_embedded, rating_paths, rating_export, rating_valid, rating_labels, content_md5, paths_and_names, knn_topk, knn_topk_cli, knn_threshold, knn_cells, knn_batch, knn_hits,
        generated_descriptions, generated_questions, prompts, needed_values, record_images, record_counts,
    )
}

_WS = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"
_NWS = "[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"


def _words(t: str) -> str:
    return f"len(regexp_extract_all(coalesce({t}, ''), '{_NWS}+'))"


def _strip(t: str) -> str:
    return f"regexp_replace(coalesce({t}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(t: str) -> str:
    return _strip(f"regexp_replace(coalesce({t}, ''), '{_WS}+', ' ', 'g')")


def _one(t: str) -> str:
    return f"(len(list_filter(regexp_split_to_array(coalesce({t}, ''), '[.!?]+'), lambda p: {_strip('p')} <> '')) = 1)"


_SPANISH = V.SPANISH.split("(?<![\\p{L}\\p{N}_])")[1].split("(?![\\p{L}\\p{N}_])")[0]


def _spanish(t: str) -> str:
    return f"(regexp_matches(lower(coalesce({t}, '')), '(^|[^\\p{{L}}\\p{{N}}_]){_SPANISH}($|[^\\p{{L}}\\p{{N}}_])') OR regexp_matches(lower(coalesce({t}, '')), '[ñáéíóúü]'))"


def _generic(t: str, filler: str) -> str:
    return f"({_strip(t)} = '' OR regexp_matches(coalesce({t}, ''), '{filler}') OR {_words(t)} < 7)"


_FIG = "(?i)\\b(fig\\.?|figure)\\s*[0-9]+\\b"
_ANCHORS = f"""
    w AS (SELECT rec_id, unnest(regexp_extract_all(lower(coalesce(caption, '')), '[a-z][a-z-]{{3,}}')) AS t, generate_subscripts(regexp_extract_all(lower(coalesce(caption, '')), '[a-z][a-z-]{{3,}}'), 1) AS p FROM manifest),
    c AS (SELECT rec_id, t, count(*) AS n, min(p) AS p FROM w WHERE t NOT IN ({", ".join(f"'{x}'" for x in T.STOP_WORDS)}) GROUP BY ALL),
    anchors AS (SELECT rec_id, t AS term, row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, length(t) DESC, p) - 1 AS place FROM c QUALIFY place < 10)"""
_ASKED = "asked AS (SELECT rec_id, caption, unnest(questions) AS q, generate_subscripts(questions, 1) - 1 AS n FROM manifest)"


def _has(t: str, parts) -> str:
    return "(" + " OR ".join(f"contains({t}, '{p}')" for p in parts) + ")"


def _case(groups, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{said}'" for test, said in groups) + f" ELSE '{otherwise}' END"


def _fallback(i: int) -> str:
    c, t = _strip("lower(coalesce(caption, ''))"), _strip("lower(coalesce(collector, ''))")
    return _case([(f"({_has(c, p)} OR {_has(t, p)})" if typed else _has(c, p), q[i]) for p, typed, *q in T.FALLBACKS[:-1]], T.FALLBACKS[-1][2 + i])


_HINT = _case([(_has("lower(coalesce(caption, chr(32)))", p), s) for p, s in T.HINTS], T.OTHER_HINT)


def _label(c: str) -> str:
    return f"({c} <> '' AND NOT regexp_matches(lower({c}), '^(figure|fig\\.|fig |table|tabla)') AND {_words(c)} <= 10 AND NOT regexp_matches({c}, '^\\[[0-9]+\\]$'))"


def _general(i: int) -> str:
    c = _strip("lower(coalesce(caption, ''))")
    return _case([(_has(c, p), q[i]) for p, _, *q in T.FALLBACKS[:-1]], T.FALLBACKS[-1][2 + i])


_UNIT = "len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"
_SCORE = "(1 + list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2"
_PATH = "replace(coalesce({p}, ''), '\\', '/')"


def _data(p: str) -> str:
    s = _PATH.format(p=p)
    return f"ltrim(CASE WHEN contains({s}, '/data/') THEN string_split({s}, '/data/')[-1] WHEN contains({s}, 'data/') THEN string_split({s}, 'data/')[-1] ELSE {s} END, '/')"


def _top(k: int) -> str:
    return f"SELECT e.vec_id, round({_SCORE}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_SCORE} DESC, e.vec_id LIMIT {k}"


_IMAGES = f"""
        WITH m AS (SELECT rec_id, doc_id, caption, image_path, {_PATH.format(p="image_path")} AS p, {_data("image_path")} AS d FROM manifest),
        there AS (SELECT DISTINCT CASE WHEN rec_id % 4 = 0 THEN '/root/' || d ELSE p END AS path FROM m WHERE rec_id % 2 = 0 AND image_path IS NOT NULL),
        found AS (SELECT rec_id, doc_id, caption, CASE WHEN p <> '' THEN coalesce(a.path, b.path, c.path) END AS image_file
            FROM m LEFT JOIN there a ON a.path = p LEFT JOIN there b ON b.path = '/root/' || d LEFT JOIN there c ON c.path = '/root/' || coalesce(doc_id, '') || '/' || p)"""
_QUOTES = "^([\"“”])(.+)([\"“”])$"
_NEW = "new AS (SELECT concat_ws('_', doc_id, id) AS figure_key, coalesce(caption, '') AS caption FROM manifest), old AS (SELECT figure_key, caption FROM ragi_images)"
_FULL = f"""concat_ws(' ', CASE WHEN {_strip("caption")} <> '' THEN 'Caption: ' || {_strip("caption")} END, CASE WHEN {_strip("description2")} <> '' THEN 'Description: ' || {_strip("description2")} END,
        CASE WHEN {_strip("description3")} <> '' THEN 'Description: ' || {_strip("description3")} END,
        CASE WHEN len(questions) > 0 THEN 'Questions: ' || coalesce(array_to_string(list_filter(list_transform(questions, lambda q: {_strip("q")}), lambda q: q <> ''), ' | '), '') END)"""

SQL = {
    "text_measures": f"SELECT doc_id, {_words('text')} AS words, {_one('text')} AS one, length({_clean('text')}) AS size FROM documents",
    "cleaned_text": f"""
        SELECT rec_id, {_clean("caption")} AS caption,
            CASE WHEN description2 IS NULL THEN '' ELSE {_strip("regexp_replace(" + _clean("' Here is the revised output: ' || chr(34) || description2 || chr(34) || chr(10)") + ", '(?i)^(here is (the )?(revised|rewritten) output:\\s*)', '')")} END AS said,
            CASE WHEN description3 IS NULL THEN '' ELSE {_strip("regexp_replace(" + _clean("chr(34) || description3 || chr(34) || ' '") + f", '{_QUOTES}', '\\2')")} END AS unquoted FROM manifest""",
    "description_failures": f"""
        SELECT rec_id, CASE WHEN {_strip("description2")} = '' THEN 'empty' WHEN {_spanish("description2")} THEN 'spanish' WHEN regexp_matches(description2, '{_FIG}') THEN 'figure reference'
            WHEN contains(lower(description2), 'pipeline') AND NOT contains(lower(coalesce(caption, '')), 'pipeline') THEN 'pipeline' WHEN NOT {_one("description2")} THEN 'sentences' WHEN {_words("description2")} > 28 THEN 'length'
            WHEN {_generic("description2", V.CAPTION_FILLER)} THEN 'generic' END AS reason FROM manifest""",
    "image_description_failures": f"""
        SELECT rec_id, CASE WHEN {_strip("description3")} = '' THEN 'empty' WHEN regexp_matches(description3, '{_FIG}') THEN 'figure reference' WHEN NOT {_one("description3")} THEN 'sentences' WHEN {_words("description3")} > 28 THEN 'length'
            WHEN {_generic("description3", V.IMAGE_FILLER)} THEN 'generic' WHEN page % 4 > 1 AND regexp_matches(description3, '{V.SINGLE_PANEL}') THEN 'panels' END AS reason FROM manifest""",
    "passage_flags": f"""
        SELECT doc_id, {_spanish("text")} AS spanish, coalesce(regexp_matches(text, '{_FIG}'), false) AS figures, {_generic("text", V.CAPTION_FILLER)} AS generic, contains(lower(coalesce(text, '')), 'pipeline') AND NOT contains(lower(coalesce(source, '')), 'pipeline') AS pipeline,
            {_words("text")} > 28 AS long, doc_id % 4 > 1 AND coalesce(regexp_matches(text, '{V.SINGLE_PANEL}'), false) AS single FROM documents""",
    "anchor_terms": f"WITH {_ANCHORS} SELECT rec_id, place, term FROM anchors",
    "anchored_questions": f"""
        WITH {_ANCHORS}, {_ASKED} SELECT rec_id, n, {_has("lower(coalesce(q, ''))", T.ALWAYS_ANCHOR)} OR EXISTS (SELECT 1 FROM anchors a WHERE a.rec_id = asked.rec_id AND contains(lower(coalesce(q, '')), a.term)) AS anchored FROM asked""",
    "bad_questions": f"""
        WITH {_ASKED} SELECT rec_id, n, {_strip("q")} = '' OR NOT suffix({_strip("q")}, '?') OR {_words("q")} NOT BETWEEN 6 AND 18 OR regexp_matches({_strip("q")}, '{_FIG}') OR regexp_matches({_strip("q")}, '{V.GENERAL_QUESTION}') OR regexp_matches({_strip("q")}, '{V.BANNED_QUESTION}')
            OR (regexp_matches(coalesce(q, ''), '{V.MODEL_NAME}') AND NOT regexp_matches(coalesce(caption, ''), '{V.MODEL_NAME}')) OR (rec_id % 4 = 1 AND regexp_matches({_strip("q")}, '{V.SEVERAL_PANELS}')) AS bad FROM asked""",
    "normalized_questions": f"""
        WITH {_ASKED}, u AS (SELECT rec_id, n, q, {_strip("regexp_replace(" + _clean("lower(q)") + f", '{_QUOTES}', '\\2')")} AS t FROM asked), b AS (SELECT *, CASE WHEN suffix(t, '?') THEN {_strip("left(t, length(t) - 1)")} ELSE t END AS s FROM u)
        SELECT rec_id, n, CASE WHEN t = '' THEN '' ELSE upper(left(s, 1)) || substr(s, 2) || '?' END AS q, CASE WHEN suffix(coalesce(q, ''), '?') THEN q ELSE coalesce(q, '') || '?' END AS marked FROM b""",
    "question_json": f"""
        SELECT rec_id, CASE WHEN rec_id % 3 < 2 THEN {_strip("regexp_replace(" + _clean("caption") + f", '{_QUOTES}', '\\2')")} END AS q1, CASE WHEN rec_id % 3 < 2 THEN 'Why so?' END AS q2 FROM manifest""",
    "caption_hints": f"SELECT rec_id, {_HINT} AS hint FROM manifest",
    "fallback_questions": f"SELECT rec_id, {_fallback(0)} AS q1, {_fallback(1)} AS q2 FROM manifest",
    "labels_and_captions": f"""
        WITH l AS (SELECT rec_id, caption, {_clean("caption")} AS c, {_clean("collector")} AS s FROM manifest)
        SELECT rec_id, {_label("c")} AS label, {_label("s")} AS short_label,
            regexp_matches(coalesce(caption, ''), '(?i)^\\s*(?:Figure|Fig\\.?|Figura)\\s*[A-Za-z0-9]+[\\.\\:\\-]\\s+') AS figure, regexp_matches(coalesce(caption, ''), '(?i)^\\s*(?:Table|Tabla)\\b') AS in_table FROM l""",
    "panel_prefixes": """
        WITH p AS (SELECT rec_id, description2 AS t, CASE rec_id % 5 WHEN 2 THEN 'Two-panel' WHEN 3 THEN 'Three-panel' WHEN 4 THEN 'Four-panel' ELSE '' END AS prefix FROM manifest WHERE description2 IS NOT NULL)
        SELECT rec_id, prefix, CASE WHEN prefix <> '' AND t <> '' AND NOT starts_with(lower(t), lower(prefix)) THEN prefix || ' ' || lower(left(t, 1)) || substr(t, 2) ELSE t END AS text FROM p""",
    "full_texts": f"SELECT rec_id, {_FULL} AS full_text FROM manifest",
    "index_documents": f"""
        SELECT concat_ws('_', doc_id, id) AS figure_key, doc_id, source_pdf, source_pdf_url, page, image_path, coalesce(caption, '') AS caption, coalesce(description2, '') AS description2, coalesce(description3, '') AS description3, {_FULL} AS full_text
        FROM (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY concat_ws('_', doc_id, id) ORDER BY rec_id) = 1)""",
    "index_orphans": "SELECT DISTINCT figure_key FROM ragi_images WHERE figure_key NOT IN (SELECT concat_ws('_', doc_id, id) FROM manifest)",
    "index_inserted": f"WITH {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE figure_key NOT IN (SELECT figure_key FROM old)",
    "index_upserted": f"WITH {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE figure_key NOT IN (SELECT figure_key FROM new)",
    "index_without_orphans": "SELECT figure_key, doc_id, caption FROM ragi_images WHERE figure_key IN (SELECT concat_ws('_', doc_id, id) FROM manifest)",
    "index_embedded": "SELECT DISTINCT concat_ws('_', doc_id, id) AS figure_key, 64 AS dim, CAST(NULL AS VARCHAR) AS error FROM manifest WHERE concat_ws('_', doc_id, id) NOT IN (SELECT figure_key FROM ragi_images)",
    "rating_paths": f"SELECT image_path, 'http://host/images/' || {_data('image_path')} AS url, list_contains(string_split({_data('image_path')}, '/'), '..') OR {_data('image_path')} IN ('', '.') AS outside FROM rating",
    "rating_export": "SELECT coalesce(timestamp, '') AS \"Timestamp\", coalesce(query, '') AS \"Query\", coalesce(image_path, '') AS \"Ruta_Imagen\", coalesce(CAST(score AS VARCHAR), '') AS \"Estrellas\" FROM rating",
    "rating_valid": "SELECT query, image_path, score, coalesce(score BETWEEN 1 AND 5, false) AS valid FROM rating",
    "rating_labels": "SELECT query, 'show me an image about ' || query AS asked, url_encode(query) AS part, CAST(CAST(round(score / 7.0 * 100) AS INTEGER) AS VARCHAR) || '%' AS label FROM rating",
    "content_md5": "SELECT doc_id, md5(text) AS md5, md5('data:image/jpeg;base64,' || base64(encode(text))) AS url_md5 FROM documents",
    "paths_and_names": """
        SELECT rec_id, printf('p%04d_figure_%05d.png', page, id) AS crop, printf('page_%04d.png', page) AS page_file, 'https://papers.example.org/pdf/' || doc_id || '.pdf' AS url, replace(coalesce(image_path, ''), '\\', '/') AS posix, concat_ws('_', doc_id, id) AS key, left(coalesce(caption, ''), 120) || '...' AS short,
            CASE WHEN extracted_at IS NULL THEN '' WHEN microsecond(extracted_at) % 1000000 = 0 THEN strftime(extracted_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(extracted_at, '%Y-%m-%dT%H:%M:%S.%f') END AS at FROM manifest""",
    "knn_topk": _top(5),
    "knn_topk_cli": _top(2),
    "knn_threshold": f"""
        WITH d AS (SELECT * FROM ragi_images QUALIFY row_number() OVER (PARTITION BY figure_key) = 1), u AS (SELECT * FROM d WHERE {_UNIT}), q AS (SELECT embedding FROM u ORDER BY figure_key LIMIT 1),
        t AS (SELECT e.figure_key, {_SCORE} AS s FROM u e, q ORDER BY s DESC, e.figure_key LIMIT 5) SELECT figure_key, round(s, 4) AS score FROM t WHERE s >= 0.75""",
    "prompts": f"""
        WITH {_ANCHORS}, a AS (SELECT rec_id, list(term ORDER BY term) AS terms FROM anchors GROUP BY rec_id),
        m AS (SELECT manifest.rec_id, coalesce(caption, '') AS c, {_HINT} AS hint, CAST(coalesce(page % 4, 1) AS INTEGER) AS n, CASE WHEN coalesce(collector, '') <> '' THEN chr(10) || 'Kind: ' || collector ELSE '' END AS kind, coalesce(array_to_string(a.terms[1:8], ', '), '') AS terms
            FROM manifest LEFT JOIN a ON a.rec_id = manifest.rec_id)
        SELECT rec_id, 'Write one English sentence of at most 28 words on what the figure with this caption shows, without figure numbers. ' || hint || chr(10) || 'Caption: ' || c AS by_caption,
            'Describe the image in one English sentence of at most 28 words, without figure numbers.' || CASE n WHEN 2 THEN ' Begin with ''Two-panel''.' WHEN 3 THEN ' Begin with ''Three-panel''.' ELSE '' END || kind || chr(10) || 'Caption: ' || c AS by_image,
            'Write two different search questions of 6 to 18 words on the figure as JSON {{"q1": "...", "q2": "..."}}. Use words of the caption: ' || terms || chr(10) || 'Panels: ' || n || kind || chr(10) || 'Caption: ' || c AS questions FROM m""",
    "needed_values": f"SELECT rec_id, {_strip('description2')} = '' AS needed, true AS forced, {_strip('caption')} = '' AS blank FROM manifest",
    "record_images": f"{_IMAGES} SELECT rec_id, image_file FROM found",
    "record_counts": f"{_IMAGES} SELECT doc_id, count(*) AS records, count(*) FILTER ({_strip('caption')} = '') AS blank, count(image_file) AS pictured FROM found GROUP BY doc_id",
    "generated_questions": f"""
        SELECT rec_id, CASE WHEN {_strip("caption")} = '' THEN ['{enrich.NO_CAPTION[0]}', '{enrich.NO_CAPTION[1]}'] WHEN contains(caption, 'Sketch') THEN [{_general(0)}, {_general(1)}] WHEN NOT contains(caption, 'Ablation') THEN ['{ASKED[0]}', '{ASKED[1]}'] END AS questions,
            CASE WHEN {_strip("caption")} <> '' AND contains(caption, 'Sketch') THEN 'no pair' END AS reason, CASE WHEN contains(caption, 'Ablation') AND NOT contains(caption, 'Sketch') THEN 'RuntimeError: down' END AS error FROM manifest""",
    "generated_descriptions": f"""
        WITH m AS (SELECT rec_id, description2, {_strip("caption")} = '' AS blank, {_HINT} || chr(10) || 'Caption: ' || coalesce(caption, '') AS p FROM manifest)
        SELECT rec_id, CASE WHEN blank THEN '' WHEN contains(p, 'taxonomy') THEN description2 WHEN contains(p, 'timeline') THEN '{REPAIRED}' ELSE '{DESCRIBED}' END AS description2, CAST(NULL AS VARCHAR) AS reason,
            CASE WHEN NOT blank AND contains(p, 'taxonomy') THEN 'RuntimeError: down' END AS error FROM m""",
    "knn_cells": _top(5),
    "knn_batch": f"""
        SELECT q.vec_id AS query_key, e.vec_id AS hit_key, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORE} DESC, e.vec_id) AS rank, round({_SCORE}, 4) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= 5""",
    "knn_hits": f"""
        WITH d AS (SELECT * FROM ragi_images QUALIFY row_number() OVER (PARTITION BY figure_key) = 1), u AS (SELECT * FROM d WHERE {_UNIT}), q AS (SELECT embedding FROM u ORDER BY figure_key LIMIT 1)
        SELECT 'http://host/images/' || {_data("e.image_path")} AS image_url, e.image_path, e.doc_id, e.page, e.source_pdf_url, round({_SCORE}, 4) AS score FROM u e, q ORDER BY {_SCORE} DESC, e.figure_key LIMIT 5""",
}
