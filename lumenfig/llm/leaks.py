"""Passages of held-out test items inside a corpus, found with a generalised suffix automaton.

The words of all test items build one automaton: each state is a set of word
runs that end at the same places of the items, and knows which items those are.
A passage is read once, word by word; the automaton gives, at each word, the longest run
ending there that occurs in any item. A run of ``min_words`` or more is a leak of all
items that hold it, which the state's nearest ancestor with runs of that length knows.

Spans of one item that overlap are united. :func:`without_leaks` cuts them out, or drops a passage that
is mostly leak.

The items are read in blocks of at most ``block_words`` words, each an automaton of its own, and ``PASS`` blocks are
broadcast for one scan of the corpus, so the size of what is broadcast is bounded whatever the number of items; an
item longer than a block is split into pieces that overlap by ``min_words - 1`` words.

Null and empty passages and items have no leaks. Repeated passages are each reported under their own id,
repeated items under all of theirs. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfig.llm.common import WORD, words


#: Automata that one scan of the corpus takes along.
PASS = 4


class Automaton:
    """A generalised suffix automaton over words, in flat tables: a step from state s by word w is the entry (s << 32) + w."""

    def __init__(self, min_words: int) -> None:
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        self.step: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.own: dict[int, set[int]] = {}
        self._out: list[list[int]] = [[]]

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        return len(self.length) - 1

    def _go(self, at: int, word: int, to: int) -> None:
        if (at << 32) + word not in self.step:
            self._out[at].append(word)
        self.step[(at << 32) + word] = to

    def _split(self, at: int, word: int) -> int:
        """The state for runs of one word more than those of ``at``, split off where it holds longer ones too."""
        to = self.step[(at << 32) + word]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(self.length[at] + 1, self.link[to])
        for w in self._out[to]:
            self._go(copy, w, self.step[(to << 32) + w])
        self.link[to] = copy
        while at != -1 and self.step.get((at << 32) + word) == to:
            self.step[(at << 32) + word] = copy
            at = self.link[at]
        return copy

    def add(self, text: list[str], item: int) -> None:
        last = 0
        for word in text:
            w = self.ids.setdefault(word, len(self.ids))
            if (last << 32) + w in self.step:
                last = self._split(last, w)
            else:
                new = self._state(self.length[last] + 1, 0)
                at = last
                while at != -1 and (at << 32) + w not in self.step:
                    self._go(at, w, new)
                    at = self.link[at]
                if at != -1:
                    self.link[new] = self._split(at, w)
                last = new
            if self.length[last] >= self.min_words:
                self.own.setdefault(last, set()).add(item)

    def finish(self) -> Automaton:
        """Gives each state all items that hold its runs, as far as these are long enough."""
        del self._out
        for s in sorted(self.own, key=self.length.__getitem__, reverse=True):
            self._hand_up(s)
        return self

    def _hand_up(self, s: int) -> None:
        up, items = self.link[s], self.own[s]
        while up > 0 and self.length[up] >= self.min_words:
            held = self.own.setdefault(up, set())
            if items <= held:
                break
            held |= items
            up = self.link[up]

    def matches(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, item) at each word, for each item of which a long enough run ends there; its longest such run."""
        code = np.fromiter((self.ids.get(w, -1) for w in text), np.int64, len(text))
        edge = np.flatnonzero(np.diff(np.r_[False, code >= 0, False]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.min_words:
                continue
            state = length = 0
            for i, w in enumerate(code[a:b].tolist(), a):
                while state and (state << 32) + w not in self.step:
                    state = self.link[state]
                    length = self.length[state]
                to = self.step.get((state << 32) + w)
                if to is not None:
                    state, length = to, length + 1
                    at, n, told = state, length, set()
                    while n >= self.min_words:
                        own = self.own.get(at, told)
                        for item in own - told:
                            yield i, n, item
                        told |= own
                        at = self.link[at]
                        n = self.length[at]


def automata(items: DataFrame, key: str, text: str, min_words: int, block_words: int) -> Iterator[Automaton]:
    """Automata of all items, each of a bounded number of words; the items come in a stream."""
    now, held = Automaton(min_words), 0
    for row in items.select(F.col(key), F.col(text)).where(f"{key} is not null and {text} is not null").toLocalIterator():
        found = words(row[1])
        for i in range(0, max(1, len(found)), block_words):
            piece = found[i : i + block_words + min_words - 1]
            if held and held + len(piece) > block_words:
                yield now.finish()
                now, held = Automaton(min_words), 0
            now.add(piece, row[0])
            held += len(piece)
    if held:
        yield now.finish()


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", min_words: int = 12, block_words: int = 500_000) -> DataFrame:
    """(doc_id, item_id, longest, spans): passages and the items they share a run of min_words words with.

    longest counts words; spans are [start, end) of characters in the passage, in order, that the
    item's runs cover.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null and text != ''")
    out: DataFrame | None = None
    blocks = automata(items, item_key, text, min_words, block_words)
    while made := list(islice(blocks, PASS)):
        held = spark.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, item, longest, spans = [], [], [], []
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = words(value)
                    best: dict[int, int] = {}
                    ends: dict[int, list[list[int]]] = {}
                    for sam in held.value:
                        for end, length, i in sam.matches(found):
                            best[i] = max(best.get(i, 0), length)
                            at, start = ends.setdefault(i, []), end - length + 1
                            if at and at[-1][0] <= start <= at[-1][1]:
                                at[-1][1] = max(at[-1][1], end + 1)
                            elif at and start <= at[-1][0] <= end + 1:
                                at[-1] = [start, max(at[-1][1], end + 1)]
                            else:
                                at.append([start, end + 1])
                    if best:
                        places = [m.span() for m in WORD.finditer(value)]
                        for i in best:
                            ids.append(doc)
                            item.append(i)
                            longest.append(best[i])
                            spans.append([[places[a][0], places[b - 1][1]] for a, b in ends[i]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(longest, pa.int32()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                    names=["doc_id", "item_id", "longest", "spans"],
                )

        part = rows.mapInArrow(run, "doc_id LONG, item_id LONG, longest INT, spans ARRAY<ARRAY<INT>>")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id LONG, item_id LONG, longest INT, spans ARRAY<ARRAY<INT>>")
    # An item that was split over automata has a row for each; its spans may overlap and are only cut out together.
    return out.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.flatten(F.collect_list("spans")).alias("spans"))


def without_leaks(docs: DataFrame, found: DataFrame, doc_key: str = "doc_id", text: str = "text", most: float = 0.5) -> DataFrame:
    """(doc_id, text, cut): every passage without its leaks; text is null where more than ``most`` of it leaked.

    cut counts the characters removed.
    """
    spans = found.select("doc_id", F.explode("spans").alias("span")).groupBy("doc_id").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    rows = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(spans, "doc_id", "left")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"), F.lit(0).alias("cut"))

    def step(s, span):
        a, b = F.greatest(s["at"], span[0]), F.greatest(s["at"], span[1])
        return F.struct(
            F.concat(s["kept"], F.substring(F.col("text"), s["at"] + 1, a - s["at"])).alias("kept"),
            b.cast("int").alias("at"),
            (s["cut"] + b - a).cast("int").alias("cut"),
        )

    state = F.aggregate(F.coalesce("spans", F.array().cast("array<array<int>>")), start, step)
    whole = F.concat(F.col("s.kept"), F.substring(F.col("text"), F.col("s.at") + 1, F.length("text")))
    rows = rows.withColumn("s", state).withColumn("cut", F.col("s.cut"))
    return rows.select("doc_id", F.when(F.col("cut") <= most * F.length("text"), whole).alias("text"), "cut")
