"""The queries over these operators, by problem, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfig.llm import cut_text, history, leaks, near_copies, packing, page_noise, pii, residue, vantage
from lumenfig.sources.tables import table
from lumenfig.workdir import Workdir


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of later batches and the accepted record that each repeats."""
    return history.repeated_deliveries(table(spark, sf_dir, "manifest").select("rec_id", "batch_no", "doc_id", "id", "md5"))


def p1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of later batches whose captions are, to at least 0.8 of their words, made of runs of five words or more from captions delivered before."""
    found = history.covered_by_history(table(spark, sf_dir, "manifest"), "rec_id", "batch_no", "caption")
    return found.select(F.col("key").alias("rec_id"), "n_words", F.col("n_covered").cast("int").alias("n_covered"), F.col("match").alias("rec_id_a"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of figures that are among each other's five most similar, with a cosine of at least 0.9."""
    return vantage.mutual(vantage.nearest(table(spark, sf_dir, "ragi_images"), "figure_key"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose captions share at least 0.7 of their distinct words."""
    return near_copies.record_pairs(near_copies.alike(table(spark, sf_dir, "manifest"), "rec_id", F.col("caption")))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every record with a caption, and the links of its class of equal word sets."""
    found = near_copies.alike(table(spark, sf_dir, "manifest"), "rec_id", F.col("caption"))
    return near_copies.groups(found).select(F.col("id").alias("rec_id"), "group_id", "links")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other figures of every usable figure, in order, however unlike they are; none is missed."""
    return vantage.nearest(table(spark, sf_dir, "ragi_images"), "figure_key", least=None, factor=1.0).select("key_a", "key_b", "place")


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise.repaired(table(spark, sf_dir, "manifest"), "rec_id", F.col("caption"), F.col("collector"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose caption has traces of scanning or page layout."""
    return _repaired(spark, sf_dir).where("size(traces) > 0").select(F.col("key").alias("rec_id"))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every caption as clean running text, and the kinds of traces it had."""
    return _repaired(spark, sf_dir).select(F.col("key").alias("rec_id"), F.col("text").alias("caption"), F.array_join("traces", ", ").alias("traces"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions and questions that are or contain residue of the machinery that should have made them."""
    found = residue.residue(table(spark, sf_dir, "manifest"), "rec_id", ["description2", "description3", "questions"])
    return found.select(F.col("key").alias("rec_id"), "field")


_CUT_FIELDS = ["caption", "description2", "description3"]


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_text.cut_values(table(spark, sf_dir, "manifest"), "rec_id", _CUT_FIELDS, "collector", ["description2", "description3", "questions"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions and descriptions whose end is missing."""
    return _cuts(spark, sf_dir).select(F.col("key").alias("rec_id"), "field")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut values per collector and field."""
    found = cut_text.cut_shares(table(spark, sf_dir, "manifest"), _cuts(spark, sf_dir), _CUT_FIELDS, "collector")
    return found.withColumnRenamed("source", "collector")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every passage, for each kind of container."""
    sizes = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    sizes = Workdir(spark, "packing").keep(sizes, "sizes")
    return packing.packed(sizes, table(spark, sf_dir, "pack_size"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers of each kind are used, and how full they are."""
    return packing.fill(p7_packed(spark, sf_dir), table(spark, sf_dir, "pack_size"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and the test items with which they share a run of at least 12 words."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage without its leaked spans."""
    return leaks.without_leaks(table(spark, sf_dir, "documents"), _leaks(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and the kinds of personal mentions they contain."""
    found = pii.redacted(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), F.explode("kinds").alias("kind"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with its personal mentions replaced by placeholders."""
    return pii.redacted(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_near, p2_found, p2_neighbours, p3_found, p3_groups, p4_found, p4_repaired, p5_found, p6_found, p6_shares,
        p7_packed, p7_fill, p8_found, p8_cleaned, p9_found, p9_redacted,
    )
}

_WORDS = "regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}]+')"

_SIMILAR = """
        e AS (SELECT figure_key, min(embedding) AS v FROM ragi_images WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
            AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 GROUP BY figure_key),
        l AS (SELECT figure_key, v, sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) AS n FROM e),
        d AS (SELECT figure_key, list_transform(v, lambda x: CAST(x::DOUBLE / n AS FLOAT))::DOUBLE[] AS v FROM l),
        s AS (SELECT a.figure_key AS a, b.figure_key AS b, list_dot_product(a.v, b.v) AS c FROM d a JOIN d b ON a.figure_key <> b.figure_key),
        t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS place FROM s QUALIFY place <= 5)"""

#: SQL for those that are exact set or vector operations; it compares everything with everything and is meant for small data.
SQL: dict[str, str] = {
    "p1_found": """
        WITH RECURSIVE s AS (
            SELECT rec_id, batch_no, regexp_replace(regexp_replace(lower(coalesce(md5, '')), '^\\s*(md5\\s*[:=]|0x)', ''), '[^0-9a-z]', '', 'g') AS m, id,
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(doc_id, '')), '\\s+', '', 'g'), '^.*[/:]', ''), '\\.pdf$', ''), 'v[0-9]+$', '') AS p
            FROM manifest WHERE rec_id IS NOT NULL AND batch_no IS NOT NULL
        ), n AS (
            SELECT rec_id, batch_no, list_filter([
                CASE WHEN regexp_matches(m, '^[0-9a-f]{32}$') AND len(list_distinct(string_split(m, ''))) > 1 AND m <> 'd41d8cd98f00b204e9800998ecf8427e' THEN 'm:' || m END,
                CASE WHEN p <> '' AND id IS NOT NULL THEN 'f:' || p || '#' || id END], lambda k: k IS NOT NULL) AS keys FROM s
        ), first AS (SELECT k, min(rec_id) AS o FROM (SELECT rec_id, unnest(keys) AS k FROM n WHERE batch_no <= 0) GROUP BY k),
        later AS (SELECT rec_id, keys, row_number() OVER (ORDER BY batch_no, rec_id) AS i FROM n WHERE batch_no > 0),
        walk AS (
            SELECT CAST(0 AS BIGINT) AS i, coalesce(list(k ORDER BY k), []) AS ks, coalesce(list(o ORDER BY k), []) AS os, CAST(NULL AS BIGINT) AS b, CAST([] AS BIGINT[]) AS hits FROM first
            UNION ALL
            SELECT i, CASE WHEN len(hits) = 0 THEN ks || keys ELSE ks END, CASE WHEN len(hits) = 0 THEN os || list_transform(keys, lambda k: b) ELSE os END, b, hits
            FROM (SELECT l.i, w.ks, w.os, l.keys, l.rec_id AS b, list_distinct(list_filter(list_transform(l.keys, lambda k: w.os[list_position(w.ks, k)]), lambda x: x IS NOT NULL)) AS hits FROM walk w JOIN later l ON l.i = w.i + 1)
        )
        SELECT unnest(hits) AS rec_id_a, b AS rec_id_b FROM walk""",
    "p3_groups": f"""
        WITH RECURSIVE s AS (SELECT rec_id, list_sort(list_distinct({_WORDS.format(t="caption")})) AS w FROM manifest),
        c AS (SELECT w, len(w) AS n, min(rec_id) AS id FROM s WHERE len(w) > 0 GROUP BY w),
        near AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, len(list_intersect(a.w, b.w)) AS i FROM c a JOIN c b ON a.id <> b.id AND 10 * a.n >= 7 * b.n AND 10 * b.n >= 7 * a.n),
        links AS (SELECT a, b FROM near WHERE 10 * i >= 7 * (n - i)),
        reach AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT s.rec_id, g.group_id, coalesce(l.links, 0) AS links FROM s JOIN c USING (w) JOIN (SELECT a, min(b) AS group_id FROM reach GROUP BY a) g ON g.a = c.id
        LEFT JOIN (SELECT a, count(*) AS links FROM links GROUP BY a) l ON l.a = c.id""",
    "p2_neighbours": f"WITH {_SIMILAR} SELECT a AS key_a, b AS key_b, CAST(place AS INTEGER) AS place FROM t",
    "p1_near": f"""
        WITH t AS (SELECT rec_id, batch_no, {_WORDS.format(t="caption")} AS w FROM manifest WHERE caption IS NOT NULL),
        g AS (SELECT rec_id, batch_no, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rec_id, batch_no, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t WHERE len(w) >= 5)),
        m AS (SELECT x.rec_id, x.i, min(y.rec_id) AS a FROM g x JOIN g y ON x.g = y.g AND y.batch_no < x.batch_no GROUP BY x.rec_id, x.i),
        c AS (SELECT rec_id, min(a) AS rec_id_a, count(DISTINCT p) AS n_covered FROM (SELECT rec_id, a, unnest(generate_series(i, i + 4)) AS p FROM m) GROUP BY rec_id)
        SELECT rec_id, len(w) AS n_words, n_covered, rec_id_a FROM c JOIN t USING (rec_id) WHERE n_covered >= 0.8 * len(w)""",
    "p2_found": """
        WITH d AS (SELECT figure_key, min(embedding::DOUBLE[]) AS v FROM ragi_images WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
            AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 GROUP BY figure_key),
        s AS (SELECT a.figure_key AS a, b.figure_key AS b, list_cosine_similarity(a.v, b.v) AS c FROM d a JOIN d b ON a.figure_key <> b.figure_key),
        t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
        SELECT x.a AS figure_key_a, x.b AS figure_key_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.c >= 0.9""",
    "p3_found": f"""
        WITH s AS (SELECT rec_id, list_distinct({_WORDS.format(t="caption")}) AS w FROM manifest), n AS (SELECT rec_id, w, len(w) AS n FROM s WHERE len(w) > 0),
        shared AS (SELECT a.rec_id AS a, b.rec_id AS b, a.n AS na, b.n AS nb, len(list_intersect(a.w, b.w)) AS i FROM n a JOIN n b ON a.rec_id < b.rec_id AND 10 * a.n >= 7 * b.n AND 10 * b.n >= 7 * a.n)
        SELECT a AS rec_id_a, b AS rec_id_b FROM shared WHERE 10 * i >= 7 * (na + nb - i)""",
    "p8_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents), e AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM eval_item),
        dr AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) AS r FROM d WHERE len(w) >= 12),
        er AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) AS r FROM e WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (r)""",
}
