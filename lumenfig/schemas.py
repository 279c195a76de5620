"""Schemas of the tables, as DDL."""

MANIFEST = (
    "id INT, doc_id STRING, source_pdf STRING, source_pdf_url STRING, page INT, image_path STRING, caption STRING, md5 STRING, "
    "description2 STRING, description3 STRING, questions ARRAY<STRING>"
)
#: Columns of earlier versions, still read where present.
LEGACY = "path_rel STRING, file STRING, figure_type STRING"
#: Columns of earlier versions, dropped.
DROPPED = ["description3_model", "description3_used_image", "description3_panels", "questions_model", "questions_used_image"]
PAGE = "doc_id STRING, page INT, width INT, height INT, png BINARY"
DETECTION = "doc_id STRING, page INT, ord INT, cls INT, score DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
BLOCK = "doc_id STRING, page INT, ord INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
DRAWING = "doc_id STRING, page INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
