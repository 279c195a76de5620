"""Template residue, filler, error messages and notices in place of content.

Two n-gram channels, each a likelihood ratio against natural prose:

* characters, lower-cased with digits alike: the filler model and the notice model
  are fitted on texts of known kind, prose on all values of the corpus. Stretches are
  localised by windows whose mean log ratio is high, and a value is excluded if such
  stretches cover ``cover`` of any of its sentences.
* shapes, with runs of letters and digits collapsed: the slot model is fitted on
  the ways in which templating languages write a slot. The best-scoring stretch decides, however short,
  since one unfilled slot spoils a value.

Prose is counted over all distinct values, so that copies don't make a text prose, and without the stretches
whose characters the filler and notice models know almost throughout, so that residue that is frequent in
many wordings or behind many descriptions doesn't either. Shapes count by the root of a value's copies: prose
with brackets is repeated at times, and one text's copies are still few beside the corpus.
The counts are kept in 2^18 hashed cells per channel, whatever the corpus, so what is broadcast is bounded.

Null and blank values are no cases. Values are read whole. Repeated values are each judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfig.llm.common import CELLS as CELL_COUNTS
from lumenfig.llm.common import packed_cells, summed_cells
from lumenfig.llm.residue_seeds import BLIND_WORDS, FILLER, MARKERS, NOTICES, SLOTS, UNSET

CELLS = 1 << 18
#: Characters of a gram in each channel; of a window; log ratio of a gram unknown to a model.
GRAM, SHAPE_GRAM, WINDOW, UNKNOWN = 5, 4, 16, -2.5
#: Share of a window's grams that residue's models know, from which it isn't counted as prose.
KNOWN = 0.9
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*\s*")
_MARKER = re.compile(r"\b(?:" + "|".join(MARKERS) + r")\b|" + UNSET)


#: Ends of a value in a batch that is joined to one string, so that all work on characters is vectorised.
_OPEN, _SHUT = "\x02", "\x03\x03\x03"


def joined(texts: list[str]) -> str:
    """Values as one string, each with its ends marked; marks inside a value become spaces."""
    whole = "".join(texts)
    if "\x02" in whole or "\x03" in whole:
        texts = [re.sub("[\x02\x03]", " ", t) for t in texts]
    big = _OPEN + (_SHUT + _OPEN).join([t.strip() for t in texts]) + _SHUT
    return re.sub(r"\s{2,}|[^\S ]", " ", big)


def plain(big: str) -> np.ndarray:
    """The character channel: lower case, digits as 0, white space as one space."""
    code = np.frombuffer(big.lower().encode("utf-32-le"), np.uint32)
    return np.where((code >= 49) & (code <= 57), np.uint32(48), code)


_KINDS = np.array([(c.isalnum() and not 0xD800 <= i < 0xE000) + 2 * c.isupper() + 4 * c.isdigit() for i in range(1 << 16) for c in [chr(i)]], np.uint8)


def shape(big: str) -> np.ndarray:
    """The shape channel: a run of letters and digits is 0 (digits), A (capitals, two or more) or a; markers are ~; the rest stays."""
    s = _MARKER.sub("~", big)
    s = re.sub(r"\b(?:fill in|filled in|INSERT|HERE|YOUR)\b", "\x07", s)
    s = re.sub(r"_{3,}", "___", s)
    code = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    kind = np.where(code < 1 << 16, _KINDS[np.minimum(code, (1 << 16) - 1)], 1)
    word = (kind & 1).astype(bool)
    first = word & ~np.r_[False, word[:-1]]
    starts = np.flatnonzero(first)
    out = code.copy()
    if len(starts):
        runs = np.cumsum(first)[word] - 1
        size = np.bincount(runs, minlength=len(starts))
        upper = np.bincount(runs, (kind[word] & 2) > 0, len(starts)) == size
        digit = np.bincount(runs, (kind[word] & 4) > 0, len(starts)) == size
        out[starts] = np.where(digit, ord("0"), np.where(upper & (size > 1), ord("A"), ord("a")))
    return out[~word | first]


def cells(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of joined values, and which of them lie within one value."""
    h = np.zeros(len(code) - n + 1, np.uint64)
    for i in range(n):
        h = (h + code[i : i + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    within = np.ones(len(h), bool)
    for p in range(1, n):
        within[: len(h)] &= code[p : p + len(h)] != 2
    return (h % np.uint64(CELLS)).astype(np.int64), within


def windows(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stop, span, full) of the window that begins at each of n grams. A window ends where its value does, so short values have short windows."""
    starts, at = np.r_[np.flatnonzero(code == 2), len(code)], np.arange(n)
    value = np.searchsorted(starts, at, "right")
    stop = np.minimum(np.minimum(at + WINDOW, np.maximum(starts[value] - GRAM + 1, at + 1)), n)
    size = starts[value] - starts[value - 1] - GRAM + 1
    return stop, stop - at, stop - at >= np.minimum(WINDOW, np.maximum(size, 1))


def _unlike_residue(code: np.ndarray, h: np.ndarray, within: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which grams lie in no window whose grams are known almost throughout."""
    stop, span, full = windows(code, len(h))
    total = np.r_[0, np.cumsum(known[h] & within)]
    high = (total[stop] - total[:-1] >= KNOWN * span) & full & within
    edge = np.bincount(np.flatnonzero(high), minlength=len(h) + 1) - np.bincount(stop[high], minlength=len(h) + 1)
    return np.cumsum(edge[:-1]) == 0


def counted(texts: list[str], known: np.ndarray | None = None, copies: np.ndarray | None = None) -> np.ndarray:
    """How often each cell occurs, characters first, then shapes. known: cells of residue, whose stretches don't count as characters. copies of each text, for its shapes."""
    out = np.zeros(2 * CELLS, np.int64)
    if texts:
        big = joined(texts)
        for at, view, n in ((0, plain, GRAM), (CELLS, shape, SHAPE_GRAM)):
            code = view(big)
            h, within = cells(code, n)
            if known is not None and view is plain:
                within = within & _unlike_residue(code, h, within, known)
            times = None
            if copies is not None and view is shape:
                times = np.rint(np.sqrt(copies))[np.cumsum(code == 2)[: len(h)][within] - 1]
            out[at : at + CELLS] = np.bincount(h[within], times, CELLS)
    return out


def _marked_cells(slots: list[str]) -> np.ndarray:
    """Shape cells of the slots, without grams that hold only words, spaces and stops: these say nothing about a slot."""
    code = shape(joined(slots))
    h, within = cells(code, SHAPE_GRAM)
    telling = np.zeros(len(h), bool)
    odd = ~np.isin(code, np.frombuffer("aA0 .,:;\x02\x03".encode("utf-32-le"), np.uint32))
    for p in range(SHAPE_GRAM):
        telling |= odd[p : p + len(h)]
    return np.bincount(h[within & telling], minlength=CELLS)


def _seeds() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    blind = [" ".join(rng.choice(BLIND_WORDS, 12)).capitalize() + "." for _ in range(200)]
    names = ["name", "TITLE", "figure_type", "FIGURE_TYPE", "x"]
    slots = []
    for s in [*SLOTS, *MARKERS, "undefined"]:
        for n in names:
            slot = s.replace("~", n)
            slots += [slot, f"{slot}.", f"{slot}: {slot}", f"the {slot} of", f"the {slot} Name of", f"Name {slot} the", f"A {slot} of {slot}", f"the {slot}, and", f"20 {slot} the", f"of {slot} 20", f"a {slot}", f"{slot} the", f"{slot} Name"]
    return {"filler": counted(FILLER * 20 + blind)[:CELLS], "notice": counted(NOTICES)[:CELLS], "slot": _marked_cells(slots)}


class Residue:
    """Log-ratio tables of the fitted models."""

    def __init__(self, chars: np.ndarray, shapes: np.ndarray) -> None:
        """chars, shapes: how often each cell occurs in the corpus, per channel."""
        self.tables: dict[str, np.ndarray] = {}
        for name, held in _seeds().items():
            prose = (shapes if name == "slot" else chars) + 0.5
            prose = prose / prose.sum()
            own = held / held.sum()
            weight = np.exp(UNKNOWN)
            ratio = np.log(own * (1 - weight) / prose + weight)
            self.tables[name] = np.minimum(ratio, 6.0).astype(np.float32)

    def judge(self, values: list[str], least: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """Per value the greatest share of a sentence that is filler or notice, and the score of its best slot."""
        share, slot = np.zeros(len(values)), np.zeros(len(values))
        if not values:
            return share, slot
        big = joined(values)
        code = plain(big)
        starts = np.r_[np.flatnonzero(code == 2), len(code)]
        at, within = cells(code, GRAM)
        edge = np.zeros(len(code) + 1, np.int32)
        for name in ("filler", "notice"):
            score = np.where(within, self.tables[name][at], np.float32(0)).astype(np.float64)
            total = np.r_[0.0, np.cumsum(score)]
            stop, span, full = windows(code, len(score))
            high = (total[stop] - total[:-1] >= least * span) & full & within
            np.add.at(edge, np.flatnonzero(high), 1)
            np.add.at(edge, np.minimum(stop[high] + GRAM - 1, len(code)), -1)
        marked = np.cumsum(edge[:-1]) > 0
        touched = np.unique(np.searchsorted(starts, np.flatnonzero(marked), "right") - 1)
        for i in touched.tolist():
            a, b = starts[i] + 1, starts[i + 1] - 3
            text = code[a:b].tobytes().decode("utf-32-le", "replace")
            for m in _SENTENCE.finditer(text):
                if m.end() > m.start():
                    share[i] = max(share[i], float(marked[a + m.start() : a + m.end()].mean()))
        code = shape(big)
        starts = np.flatnonzero(code == 2)
        at, within = cells(code, SHAPE_GRAM)
        score = np.where(within, self.tables["slot"][at], 0).astype(np.float64)
        gain = np.add.reduceat(np.maximum(score, 0), np.minimum(starts, len(score) - 1))
        for i in np.flatnonzero(gain > 6.0).tolist():
            part = score[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(score)]
            total = np.cumsum(part)
            slot[i] = (total - np.minimum.accumulate(np.r_[0.0, total[:-1]])).max()
        return share, slot


def fit(values: DataFrame) -> Residue:
    """The models, with prose counted over the distinct values of the column ``text``, without stretches of residue."""
    seeds = _seeds()
    known = (seeds["filler"] > 0) | (seeds["notice"] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            held += counted(batch.column(0).to_pylist(), known, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays(packed_cells(held), names=["slice", "at", "n"])

    table = summed_cells(values.where("text is not null and text != ''").groupBy("text").count().mapInArrow(run, CELL_COUNTS), 2 * CELLS).astype(np.float64)
    return Residue(table[:CELLS], table[CELLS:])


def entries(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text): one row per value; a list gives a row for each of its entries."""
    kinds = dict(df.dtypes)

    def listed(f: str) -> Column:
        return F.col(f) if kinds[f].startswith("array") else F.array(F.col(f))

    each = F.array(*[F.struct(F.lit(f).alias("field"), listed(f).alias("texts")) for f in fields])
    rows = df.select(F.col(key).alias("key"), F.explode(each).alias("x"))
    return rows.select("key", "x.field", F.explode("x.texts").alias("text")).where("text is not null and trim(text) != ''")


def residue(df: DataFrame, key: str, fields: list[str], cover: float = 0.6, slot: float = 9.7) -> DataFrame:
    """(key, field, share, slot): values that are or hold residue, one row however many entries are hit."""
    rows = entries(df, key, fields)
    return judged(rows, fit(rows), cover, slot)


def judged(rows: DataFrame, models: Residue, cover: float = 0.6, slot: float = 9.7) -> DataFrame:
    """The same for rows of (key, field, text) with models fitted before."""
    rows = rows.select("key", "field", "text")
    held = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, best = held.value.judge(batch.column(2).to_pylist())
            hit = pa.array(np.flatnonzero((share >= cover) | (best >= slot)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(hit), batch.column(1).take(hit), pa.array(share).take(hit), pa.array(best).take(hit)],
                names=["key", "field", "share", "slot"],
            )

    kind = dict(rows.dtypes)["key"]
    hits = rows.mapInArrow(run, f"key {kind}, field STRING, share DOUBLE, slot DOUBLE")
    return hits.groupBy("key", "field").agg(F.max("share").alias("share"), F.max("slot").alias("slot"))
