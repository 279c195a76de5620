"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of Unicode letters or digits; callers lower-case it.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in order, lower-cased; none for null."""
    low = text.lower() if text else ""
    # A letter that lower case makes two of, as the capital i with a dot, mustn't divide its word.
    return WORD.findall(low) if len(low) == len(text or "") else [w.lower() for w in WORD.findall(text)]


def word_set(text: Column) -> Column:
    """The distinct words of a text, inside the JVM; an empty array for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(found)


def paper_of(doc_id: Column) -> Column:
    """Paper without its version, however it is spelled: prefix, path, file ending, case, spaces.

    Null where nothing is left. Identifiers of other forms are kept whole.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(doc_id, F.lit(""))), r"(?U)\s+", "")
    bare = F.regexp_replace(bare, r"^.*[/:]", "")
    bare = F.regexp_replace(bare, r"\.pdf$", "")
    bare = F.regexp_replace(bare, r"v\d+$", "")
    return F.when(bare != "", bare)


def checksum_of(md5: Column) -> Column:
    """The 32 hexadecimal digits of a checksum, however spelled; null for stand-ins.

    Stand-ins are values that are no checksum at all, one digit repeated, and
    the checksum of no bytes.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(md5, F.lit(""))), r"^(?U)\s*(md5\s*[:=]|0x)", "")
    bare = F.regexp_replace(bare, r"[^0-9a-z]", "")
    real = bare.rlike(r"^[0-9a-f]{32}$") & ~bare.rlike(r"^(.)\1{31}$") & (bare != "d41d8cd98f00b204e9800998ecf8427e")
    return F.when(real, bare)


#: A task's counts of cells, packed by slices of the table; and in how many slices a table is cut.
CELLS, SLICES = "slice INT, at BINARY, n BINARY", 64


def packed_cells(held: np.ndarray) -> list[pa.Array]:
    """The columns of ``CELLS`` for a table of counts, whose size is a multiple of ``SLICES``: places and counts of the full cells of each slice."""
    width = len(held) // SLICES
    rows = [(i, at, held[i * width + at]) for i in range(SLICES) for at in [np.flatnonzero(held[i * width : (i + 1) * width])] if len(at)]
    return [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[2].astype(np.int64).tobytes() for r in rows], pa.binary())]


def summed_cells(packed: DataFrame, size: int) -> np.ndarray:
    """The table of ``size`` cells that the tasks' packed counts add up to; as many bytes times eight come to the driver, and no rows."""
    width = size // SLICES

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(width, np.int64)
        for at, n in zip(pdf["at"], pdf["n"]):
            held[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        return pd.DataFrame([(int(pdf["slice"].iloc[0]), held.tobytes())], columns=["slice", "n"])

    out = np.zeros(size, np.int64)
    for i, n in packed.groupBy("slice").applyInPandas(total, "slice INT, n BINARY").collect():
        out[i * width : (i + 1) * width] = np.frombuffer(n, np.int64)
    return out
