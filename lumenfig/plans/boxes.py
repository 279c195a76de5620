"""Pages of boxes made from order lines with integer arithmetic, so that every engine sees the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfig.sources.tables import table

_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

SQL = f"""
    lines AS (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 1 AS ord FROM lineitem
    ), boxes AS (
        SELECT 'd' || CAST(l_orderkey % 40 AS VARCHAR) AS doc_id, CAST(l_orderkey AS INTEGER) AS page, CAST(ord AS INTEGER) AS ord,
            CAST((CAST(l_quantity AS BIGINT) * 7 + l_linenumber) % 10 AS INTEGER) AS cls, l_quantity / 100 AS score,
            CAST((l_partkey * 37 % 3) * 160 + (CAST(l_quantity AS BIGINT) % 5) * 3 AS DOUBLE) AS x0,
            CAST((l_partkey * 53 % 4) * 120 + (l_linenumber % 4) * 3 AS DOUBLE) AS y0,
            CAST((l_partkey * 37 % 3) * 160 + (CAST(l_quantity AS BIGINT) % 5) * 3 + 100 + (l_suppkey % 3) * 40 AS DOUBLE) AS x1,
            CAST((l_partkey * 53 % 4) * 120 + (l_linenumber % 4) * 3 + 60 + (l_suppkey % 4) * 25 AS DOUBLE) AS y1,
            CASE (l_linenumber + l_partkey) % 6
                WHEN 0 THEN 'Figure ' || CAST(l_partkey % 9 AS VARCHAR) || ': yield of part ' || CAST(l_partkey % 5 AS VARCHAR)
                WHEN 1 THEN 'Table ' || CAST(l_partkey % 9 AS VARCHAR) WHEN 2 THEN 'see https://papers.example.org' WHEN 3 THEN 'axis label'
                WHEN 4 THEN '[' || CAST(l_partkey % 30 AS VARCHAR) || ']'
                ELSE repeat('plain words of running text ', CAST(l_partkey % 14 AS INTEGER)) || 'end' END AS text
        FROM lines
    )"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, ord, cls, score, x0, y0, x1, y1, text): up to a dozen boxes on each page."""
    n, part, line, supp = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    x0, y0 = (part * 37 % 3) * 160 + (n % 5) * 3, (part * 53 % 4) * 120 + (line % 4) * 3
    kind, figure = (line + part) % 6, (part % 9).cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("Figure "), figure, F.lit(": yield of part "), (part % 5).cast("string")))
        .when(kind == 1, F.concat(F.lit("Table "), figure))
        .when(kind == 2, F.lit("see https://papers.example.org"))
        .when(kind == 3, F.lit("axis label"))
        .when(kind == 4, F.concat(F.lit("["), (part % 30).cast("string"), F.lit("]")))
        .otherwise(F.concat(F.repeat(F.lit("plain words of running text "), (part % 14).cast("int")), F.lit("end")))
    )
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("d"), (F.col("l_orderkey") % 40).cast("string")).alias("doc_id"), F.col("l_orderkey").cast("int").alias("page"), order.cast("int").alias("ord"),
        ((n * 7 + line) % 10).cast("int").alias("cls"), (F.col("l_quantity") / 100).alias("score"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + 100 + (supp % 3) * 40).cast("double").alias("x1"), (y0 + 60 + (supp % 4) * 25).cast("double").alias("y1"), text.alias("text"),
    )


def inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def iou(a: str, b: str) -> str:
    return f"(CASE WHEN {inter(a, b)} > 0 THEN {inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)}) ELSE 0 END)"


def ios(a: str, b: str) -> str:
    return f"({inter(a, b)} / least({area(a)}, {area(b)}))"


def across(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"


def upright(a: str, b: str) -> str:
    return f"greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


def v_overlap(a: str, b: str) -> str:
    return f"({upright(a, b)} / least({a}.y1 - {a}.y0, {b}.y1 - {b}.y0))"
