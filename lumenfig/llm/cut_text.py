"""Values that lost their end, and how often each source cuts.

Two kinds of evidence, both counted over all values:

* Lengths. Per source and field, in characters and in bytes, the hazard of a length is the share of the
  values at least that long that end there without a stop. A window gives the hazard of the lengths around it, and the chance of so many ends is bounded by
  the Chernoff bound of the binomial. Benjamini and Hochberg's rule picks the significant lengths of each source and field.
* Endings. Texts are read as tokens in which names and numbers are alike. For contexts of one to three
  tokens, and of six in which longer words are alike too, it is counted how often a value or sentence ends after them and how often
  it goes on; and for the words before a stop, how often the sentence goes on after it, as after an abbreviation. Values cut by a limit don't count.

A value without a final stop is a case of the kind

* ``limit`` if it has a significant length and its ending is not too final for it: the odds of the length (ends above
  the expected ones, to the expected ones) times those of the ending (going on, to ending) are above one;
* ``transfer`` if its last word or context hardly ever ends anything, if its last
  word is hardly ever more than the beginning of longer ones, or if it ends in an abbreviation's stop;
* ``mark`` if a mark of omission stands at its end.

Titles that by nature have no stop end like many others, and are whole.
Page numbers after the end are set aside. The counts are kept in hashed cells, a fixed
number for each length of context, so what is broadcast is bounded, as are the words (at least one in a million tokens). Null and blank values are no cases; an unknown source (null)
is a source of its own. Values are read whole; repeated values are each judged alike.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfig.llm.common import CELLS as CELL_COUNTS
from lumenfig.llm.common import packed_cells, summed_cells
from lumenfig.llm.residue import entries, fit, judged
from lumenfig.workdir import Workdir

#: Hashed cells for contexts of one, two and three tokens, of six rough ones, and of the words before a stop.
CELLS = (1 << 18, 1 << 19, 1 << 19, 1 << 19, 1 << 18)
#: Share of the words beginning alike below which a word is taken for a beginning; share of ends below which a short word never ends anything; most that an ending says against a length.
FRAGMENT, NEVER, FINAL = 0.02, 0.003, 0.95
_TOKEN = re.compile(r"\x02|\d+(?:[.,]\d+)*[^\W\d_]?\b|[^\W_]+(?:[-'’][^\W_]+)*|[^\w\s]|_")
_PAGE = r"(?s)\s*(\[p\. ?\d+\]|[-–—] ?\d+ ?[-–—]|\n\s*(?:[Pp]age )?\d+|(?<=[.!?])\s+\d{1,4})\s*$"
#: Marks of omission at the end of a value, and stops.
_OMITTED = re.compile(r"(?:…|\.\.\.|\[|>>|�|\(|-->?|\\)\s*$")
_STOPPED = re.compile(r"[.!?][\"'”’)\]]*\s*$")


class _Read:
    """Texts of one batch as tokens, each text between two marks."""

    def __init__(self, texts: list[str], fields: list[str]) -> None:
        seen: dict[str, int] = {}
        tokens = _TOKEN.findall("\x02" + "\x02".join(t.replace("\x02", " ") for t in texts) + "\x02")
        self.code = np.fromiter((seen.setdefault(t, len(seen)) for t in tokens), np.int64, len(tokens))
        self.names = list(seen)
        own, low, rough = (np.zeros(len(seen), np.uint64) for _ in range(3))
        end, word = np.zeros(len(seen), bool), np.zeros(len(seen), bool)
        for t, i in seen.items():
            kind = "0" if t[0].isdigit() else t if not t[0].isalpha() or t.islower() else "N"
            own[i], low[i] = _hash(kind), _hash("0" if t[0].isdigit() else t.lower())
            rough[i] = _hash("w") if kind == t and len(t) > 3 else own[i]
            end[i], word[i] = t in "\x02.!?", t.isalpha() and t.islower()
        self.end, self.word = end[self.code], word[self.code]
        self.marks = np.flatnonzero(self.code == seen["\x02"])
        # Words before a stop, which are followed by the end or a capital, or by something that goes on.
        stop, first = self.code == seen.get(".", -1), np.array([t == "\x02" or t[0].isupper() for t in seen], bool)[self.code]
        self.stopped = 1 + np.flatnonzero(stop[1:-1] & np.array([t[0].isalpha() for t in seen], bool)[self.code[:-2]])
        self.ended = first[self.stopped + 1]
        self.before = (low[self.code[self.stopped - 1]] % np.uint64(CELLS[4])).astype(np.int64)
        self.bracket = seen.get("(", -1)
        opening = np.r_[True, self.end[:-1]]
        field = np.array([_hash(f) for f in fields] + [0], np.uint64)[np.cumsum(self.code == seen["\x02"]) - 1]
        self.exact, self.rough = np.where(opening, low[self.code], own[self.code]), rough[self.code]
        self.cells = [c for c in self._chain(self.exact, field, 3)] + [self._chain(self.rough, field, 6)[-1]]

    @staticmethod
    def _chain(token: np.ndarray, field: np.ndarray, most: int) -> list[np.ndarray]:
        """Cells of the last one to ``most`` tokens up to each position."""
        out, h = [], field.copy()
        for n in range(most):
            h = (h ^ np.r_[np.zeros(min(n, len(token)), np.uint64), token[: max(0, len(token) - n)]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            out.append((h % np.uint64(CELLS[min(n, 3)])).astype(np.int64))
        return out


_hash = xxhash.xxh3_64_intdigest


class Endings:
    """How often a context ends something and how often it goes on, and the words of the corpus."""

    def __init__(self, ends: list[np.ndarray], goes: list[np.ndarray], words: dict[str, int]) -> None:
        self.ends, self.goes, self.words = ends, goes, sorted(words)
        self.upto = np.r_[0, np.cumsum([words[w] for w in self.words])]

    def _begins(self, word: str) -> bool:
        """Is a word hardly ever more than the beginning of longer ones?"""
        i, j = bisect_left(self.words, word), bisect_left(self.words, word + "\U0010ffff")
        own = self.upto[i + 1] - self.upto[i] if i < j and self.words[i] == word else 0
        return j > i and own < FRAGMENT * (self.upto[j] - self.upto[i])

    def judge(self, texts: list[str], fields: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: does its ending say that it goes on, and the share of endings among what the longest known context did."""
        if not texts:
            return np.zeros(0, bool), np.zeros(0)
        read = _Read(texts, fields)
        last, size = read.marks[1:] - 1, np.diff(read.marks) - 1
        share, many = [], []
        for n, fewest in ((0, 5), (1, 5), (2, 5), (3, 8)):
            cell = read.cells[n][last]
            e, g = np.maximum(self.ends[n][cell] - 1, 0), self.goes[n][cell]
            share.append(np.where((e + g >= fewest) & (size > n), (e + 0.25) / (e + g + 0.5), np.nan))
            many.append(e + g)
        one, two, three, rough = share
        short = np.where(np.isnan(two), one, two)
        with np.errstate(invalid="ignore"):
            goes_on = np.where(
                np.isnan(three) & np.isnan(rough),
                short < 0.1,
                np.where(np.isnan(rough), three < 0.2, np.where(np.isnan(three), rough < 0.1, ((three < 0.2) & (rough < 0.5)) | ((rough < 0.05) & (three < 0.5)))),
            )
            # Short words, as articles and conjunctions, that hardly ever end anything, however often cut values made an end of them.
            goes_on |= (one < NEVER) & (many[0] >= 100) & np.array([len(read.names[c]) <= 3 for c in read.code[last]])
        final = np.where(np.isnan(three), np.where(np.isnan(short), 0.5, short), three)
        for i in np.flatnonzero(read.word[last] & (size > 0)).tolist():
            if self._begins(read.names[read.code[last[i]]]):
                goes_on[i], final[i] = True, 0.0
        stops = np.flatnonzero(np.array([read.names[c] == "." for c in read.code[last]]) & (size > 1))
        for i in stops.tolist():
            at = np.searchsorted(read.stopped, last[i])
            if at < len(read.stopped) and read.stopped[at] == last[i]:
                e, g = max(self.ends[4][read.before[at]] - 1, 0), self.goes[4][read.before[at]]
                goes_on[i] = g >= 5 and e < 0.1 * (e + g)
            else:
                goes_on[i] = False
        return goes_on & (size > 0), final

    def abbreviations(self) -> list[str]:
        """Words after whose stop a sentence hardly ever ends."""
        cell = np.array([_hash(w) % CELLS[4] for w in self.words], np.int64)
        e, g = self.ends[4][cell], self.goes[4][cell]
        return [self.words[i] for i in np.flatnonzero((g >= 5) & (np.maximum(e - 1, 0) < 0.1 * (e + g)))]


def endings(rows: DataFrame) -> Endings:
    """The counts over every value (text, field); words are those that are at least one in a million tokens."""
    starts = np.cumsum([0, *[2 * c for c in CELLS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = np.zeros(starts[-1], np.int64), Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            read = _Read(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            inside = ~read.end[:-1]
            tables = [cell[:-1][inside] + np.where(read.end[1:][inside], 0, CELLS[n]) for n, cell in enumerate(read.cells)]
            tables.append(read.before + np.where(read.ended, 0, CELLS[4]))
            for n, at in enumerate(tables):
                held[starts[n] : starts[n + 1]] += np.bincount(at, minlength=2 * CELLS[n])
            # Neither what a value may have been cut to, nor the letters of panels in brackets.
            within = read.word & ~np.r_[read.code[1:] == read.code[0], True] & ~np.r_[False, read.code[:-1] == read.bracket]
            for i, n in zip(*[x.tolist() for x in np.unique(read.code[within], return_counts=True)]):
                words[read.names[i]] += n
        none = [pa.nulls(len(words), pa.int32()), *[pa.nulls(len(words), pa.binary())] * 2]
        names = ["slice", "at", "n", "word", "count"]
        cells = packed_cells(held)
        yield pa.RecordBatch.from_arrays([*cells, pa.nulls(len(cells[0]), pa.string()), pa.nulls(len(cells[0]), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([*none, pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=names)

    work = Workdir(rows.sparkSession, "endings")
    counts = work.keep(rows.select("text", "field").mapInArrow(run, f"{CELL_COUNTS}, word STRING, count LONG"), "counts")
    table = summed_cells(counts.where("slice is not null").select("slice", "at", "n"), int(starts[-1])).astype(np.float32)
    tokens = float(table[: 2 * CELLS[0]].sum())
    known = counts.where("word is not null").groupBy("word").agg(F.sum("count").alias("n")).where(f"n >= {max(3.0, tokens / 1e6)}")
    words = {r[0]: r[1] for r in known.collect()}
    ends = [table[a : a + c] for a, c in zip(starts, CELLS)]
    goes = [table[a + c : a + 2 * c] for a, c in zip(starts, CELLS)]
    return Endings(ends, goes, words)


def significant_lengths(sizes: DataFrame, reach: int = 10, rate: float = 0.01, fewest: int = 5) -> DataFrame:
    """(source, field, unit, size, odds): lengths at which significantly more values end without a stop than around them.

    sizes: source, field, unit, size, open; one row per value and unit. All values at least that long are at risk. odds: ends
    above the expected ones, to the expected ones.
    """
    group = ["source", "field", "unit"]
    counts = sizes.groupBy(*group, "size").agg(F.count("*").alias("all"), F.count_if("open").alias("n"))
    by = Window.partitionBy(*group).orderBy("size")
    risk = F.sum("all").over(by.rowsBetween(0, Window.unboundedFollowing))
    sides = [by.rangeBetween(-reach, -1), by.rangeBetween(1, reach)]
    # Another significant length close by, as where blanks before a limit are stripped, doesn't make this one look usual.
    near = sum(F.coalesce(F.sum("n").over(w), F.lit(0)) for w in sides) - F.coalesce(F.greatest(*[F.max("n").over(w) for w in sides]), F.lit(0))
    rows = counts.select(*group, "size", "n", risk.alias("risk"), near.alias("near"))
    hazard, base = F.col("n") / F.col("risk"), F.least(F.lit(0.999), (F.col("near") + 1) / (2 * reach * F.col("risk") + 1))
    rest = F.when(hazard < 1, (1 - hazard) * F.log((1 - hazard) / (1 - base))).otherwise(0.0)
    bound = F.when(hazard > base, F.exp(-F.col("risk") * (hazard * F.log(hazard / base) + rest))).otherwise(1.0)
    rows = rows.withColumn("p", bound).withColumn("odds", hazard / base - 1)
    whole = Window.partitionBy(*group)
    rank = F.row_number().over(whole.orderBy("p", "size"))
    rows = rows.withColumn("rank", rank).withColumn("m", F.count("*").over(whole))
    last = F.max(F.when(F.col("p") <= rate * F.col("rank") / F.col("m"), F.col("rank"))).over(whole)
    return rows.withColumn("last", last).where(f"rank <= last and n >= {fewest}").select(*group, "size", "odds")


def cut_values(df: DataFrame, key: str, fields: list[str], source: str, spoiled: list[str]) -> DataFrame:
    """(key, field, source, text, kind): values whose end is missing, and what says so (limit, transfer, mark).

    Values that are residue of the machinery are no cases. Their models count the fields in ``spoiled``.
    """
    work = Workdir(df.sparkSession, "cut")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.explode(each).alias("x"))
    rows = rows.select("key", "source", "x.field", "x.text").where("key is not null and text is not null and trim(text) != ''")
    found = work.keep(_cut(rows), "found")
    residue = judged(found, fit(entries(df, key, spoiled)))
    return found.join(residue.select("key", "field"), ["key", "field"], "left_anti").select("key", "field", "source", "text", "kind")


def cut_shares(df: DataFrame, cut: DataFrame, fields: list[str], source: str) -> DataFrame:
    """(source, field, n, n_cut, share): how many of a source's values are cut."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    rows = df.select(F.col(source).cast("string").alias("source"), F.explode(each).alias("x")).where("x.text is not null and trim(x.text) != ''")
    total = rows.groupBy("source", "x.field").agg(F.count("*").alias("n"))
    cuts = cut.groupBy("source", "field").agg(F.count("*").alias("n_cut")).select(F.col("source").alias("s"), F.col("field").alias("f"), "n_cut")
    both = total.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")), "left")
    hits = F.coalesce("n_cut", F.lit(0))
    return both.select("source", "field", "n", hits.alias("n_cut"), F.round(hits / F.col("n"), 6).alias("share"))


def _cut(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    bare = F.regexp_replace("text", _PAGE, "")
    # Most values end in a plain stop, before which no page number stands.
    plain = F.col("text").endswith(".") & ~F.col("text").endswith("..")
    rows = rows.withColumn("bare", F.when(plain, F.col("text")).when(F.length(F.trim(bare)) > 0, bare).otherwise(F.col("text")))
    rows = rows.withColumn("open", ~plain & (~F.col("bare").rlike(_STOPPED.pattern) | F.col("bare").rlike(_OMITTED.pattern)))
    units = F.array(
        F.struct(F.lit("characters").alias("unit"), F.length("text").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("size"))
    )
    limits = significant_lengths(rows.select("source", "field", "open", F.explode(units).alias("u")).select("source", "field", "u.unit", "u.size", "open"))
    limits = Workdir(spark, "limits").keep(limits, "limits")
    lists = limits.groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "unit", "size"), "odds"))).alias("odds"))
    own = [F.element_at("odds", F.concat_ws(" ", F.lit(u), size)) for u, size in (("characters", F.length("text")), ("bytes", F.octet_length("text")))]
    same = rows["source"].eqNullSafe(lists["source"]) & (rows["field"] == lists["field"])
    rows = rows.join(F.broadcast(lists) if limits.count() <= 100_000 else lists, same, "left").select(
        "key", rows["field"], rows["source"], "text", "bare", "open", F.coalesce(F.greatest(*own), F.lit(0.0)).alias("odds")
    )
    counted = endings(rows.where("not open or odds = 0").select(F.col("bare").alias("text"), "field"))
    held = spark.sparkContext.broadcast(counted)
    last = F.lower(F.regexp_extract("bare", r"([\p{L}]+)\.$", 1))
    abbreviated = F.array_contains(F.lit(counted.abbreviations() or [""]), last) & (last != "")
    asked = rows.where(F.col("open") | abbreviated).select("key", "field", "source", "text", "bare", "open", "odds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare, odds = batch.column(4).to_pylist(), batch.column(6).to_numpy()
            goes_on, final = held.value.judge(bare, batch.column(1).to_pylist())
            open_ = np.array(batch.column(5).to_pylist(), bool)
            mark = np.fromiter((bool(_OMITTED.search(t)) for t in bare), bool, len(bare))
            final = np.minimum(final, FINAL)
            limit = open_ & (odds * (1 - final) > final)
            kind = np.where(mark, "mark", np.where(limit, "limit", np.where(goes_on, "transfer", "")))
            yield batch.select([0, 1, 2, 3]).append_column("kind", pa.array(kind.tolist(), pa.string())).filter(pa.array(kind != ""))

    kind = dict(rows.dtypes)["key"]
    return asked.mapInArrow(run, f"key {kind}, field STRING, source STRING, text STRING, kind STRING")
