"""Records whose word sets are alike, found with keys that no such pair can miss.

1. Every text becomes the sorted 64-bit hashes of its distinct words; equal sets have one number ``c`` (a hash of these),
   and a task hands on each set it meets once, so copies cost next to nothing. c and words are taken as equal if their
   64-bit hashes are.
2. Words are counted in hashed cells (a table of bounded size), and the words of all sets are put in one order: by the count of
   their cell, then by hash, so rare words come first. Any order would be exact; this one makes the keys telling.
3. Of n words, two sets that are alike share at least o = ceil(n num / den). The first two words that they share
   then stand among the first n - o + 2 of either set, and the first of them among the first n - o + 1. If that word is rare,
   it is a key by itself; else the second is not rare either, and the two together are a key. So the keys of a set are
   its rare words among the first n - o + 1, and the pairs of other words among the first n - o + 2. Sets of more than
   ``LONG`` words would have too many pairs: there, and for all sets that can be like one of these, every word
   of the first n - o + 1 is a key; so for sets so small that one shared word is enough.
4. Keys travel packed, a few binary rows per task and part, each with its set's size and a parity
   sketch of ``BITS`` bits. Sets that differ in d words have sketches that differ in at most d bits, so a part hands on
   only pairs whose sizes and sketches allow them to be alike. A run of equal keys
   longer than ``BLOCK`` leaves its part as blocks, and each two of these meet in a task of their own.
5. Every candidate is verified exactly on the sets themselves.

Null texts and texts without words take no part. Repeated rows are members of one
class. Empty tables give empty results. Texts are used whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfig.llm.common import CELLS as CELL_COUNTS
from lumenfig.llm.common import packed_cells, summed_cells, words
from lumenfig.workdir import Workdir

#: Members of a run of equal keys that a part pairs itself; keys that a part holds at most, on average.
BLOCK, PART_KEYS = 1024, 2_000_000
#: Words of a set from which single words are its keys; keys of a set, on average.
LONG, SET_KEYS = 120, 20
#: Sets that hold a word of a rare cell; least and most cells that words are counted in.
RARE, CELLS = 32, (1 << 14, 1 << 22)
#: Sets that a task remembers, so as to hand on each once.
SEEN = 1_000_000
#: Bits of a set's parity sketch.
BITS = 128

_PAIRS = "key LONG, block INT, blocks INT, a BINARY, b BINARY, sketch BINARY, size BINARY"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, c, hashes): hashes are null for a set that the task has handed on before."""
    seen: set[int] = set()
    for batch in batches:
        known: dict[str, int] = {}
        ids, cs, packed = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set(words(text))
            if not found:
                continue
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            held = np.unique(np.fromiter((known[w] for w in found), np.uint64, len(found))).tobytes()
            c = xxhash.xxh3_64_intdigest(held, 7) - (1 << 63)
            ids.append(i)
            cs.append(c)
            packed.append(None if c in seen else held)
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(c)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cs, pa.int64()), pa.array(packed, pa.binary())], names=["id", "c", "hashes"])


def _flat(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row): the hashes of all sets in a row, and whose they are."""
    sizes = np.fromiter((len(x) // 8 for x in packed), np.int64, len(packed))
    return np.frombuffer(b"".join(packed), np.uint64), np.repeat(np.arange(len(packed)), sizes)


def _cell_counts(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, np.int64)
        for batch in batches:
            held += np.bincount((_flat(batch.column(0).to_pylist())[0] % np.uint64(cells)).astype(np.int64), minlength=cells)
        yield pa.RecordBatch.from_arrays(packed_cells(held), names=["slice", "at", "n"])

    return run


def prefix_keys(hashes: np.ndarray, doc: np.ndarray, rows: int, counts: np.ndarray, rare: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all sets: doc names the set of each hash; counts are those of the cells."""
    held = counts[(hashes % np.uint64(len(counts))).astype(np.int64)]
    order = np.lexsort((hashes, held, doc))
    hashes, often = hashes[order], held[order] > rare
    size = np.bincount(doc, minlength=rows)
    shared = -(-size * num // den)
    nth = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
    single = (size * den > LONG * num) | (shared < 2)
    alone = (single[doc] | ~often) & (nth < (size - shared + 1)[doc])
    out_rows, keys = [doc[alone]], [_spread(hashes[alone])]
    first = often & (size <= LONG)[doc] & (nth < (size - shared + 2)[doc])
    hashes, doc = hashes[first], doc[first]
    for d in range(1, len(doc)):
        at = np.flatnonzero(doc[:-d] == doc[d:])
        if not len(at):
            break
        out_rows.append(doc[at])
        keys.append(_spread(_spread(hashes[at]) * np.uint64(3) + _spread(hashes[at + d] ^ np.uint64(0x5851F42D4C957F2D))))
    return np.concatenate(out_rows), np.concatenate(keys)


def _spread(keys: np.ndarray) -> np.ndarray:
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sketches(hashes: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Per set ``BITS`` bits, each the parity of how many of its words fall on it."""
    bit = ((_spread(hashes) >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(doc * BITS + bit, minlength=rows * BITS) & 1).astype(bool).reshape(rows, BITS)
    return np.packbits(odd, axis=1).view(np.uint64)


def _packed_keys(counts, rare: int, parts: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes, doc = _flat(batch.column(1).to_pylist())
            row, key = prefix_keys(hashes, doc, len(ids), counts.value, rare, num, den)
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((key, part))
            part, row, low = part[order], row[order], (key[order] >> np.uint64(32)).astype(np.uint32)
            sketch, size = sketches(hashes, doc, len(ids)), np.bincount(doc, minlength=len(ids)).astype(np.uint32)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]

            def packed(of: np.ndarray) -> pa.Array:
                return pa.array([of[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())

            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), packed(low), packed(ids[row]), packed(sketch[row]), packed(size[row])], names=["part", "keys", "ids", "sketch", "size"])

    return run


class _Allowed:
    """Whether sizes and sketches of two sets allow them to be alike."""

    def __init__(self, sketch: np.ndarray, size: np.ndarray, num: int, den: int) -> None:
        self.sketch, self.size, self.num, self.den = sketch, size.astype(np.int64), num, den

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.size[a], self.size[b]
        ok = np.minimum(x, y) * self.den >= np.maximum(x, y) * self.num
        return ok & (np.bitwise_count(self.sketch[a] ^ self.sketch[b]).sum(1, dtype=np.int64) * (self.den + self.num) <= (x + y) * (self.den - self.num))


def _out(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "block", "blocks", "a", "b", "sketch", "size"]).astype({"key": "Int64", "block": "Int32", "blocks": "Int32"})


def _joined(pdf: pd.DataFrame, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column]), kind)


def _paired(num: int, den: int):
    """Pairs of ids with equal keys that may be alike: two aligned lists; and runs that are too long, as blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, ids, sketch, size = _joined(pdf, "keys", np.uint32), _joined(pdf, "ids", np.int64), _joined(pdf, "sketch", np.uint64).reshape(-1, BITS // 64), _joined(pdf, "size", np.uint32)
        order = np.lexsort((ids, keys))
        order = order[np.r_[True, (keys[order][1:] != keys[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]
        keys, ids, sketch, size = keys[order], ids[order], sketch[order], size[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        out: list[tuple] = []
        part = int(pdf["part"].iloc[0])
        for at, n in zip(starts[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist()):
            for i, x in enumerate(range(at, at + n, BLOCK)):
                y = min(x + BLOCK, at + n)
                out.append(((part << 32) + int(keys[at]), i, -(-n // BLOCK), ids[x:y].tobytes(), None, sketch[x:y].tobytes(), size[x:y].tobytes()))
        few = np.repeat((sizes <= BLOCK) & (sizes > 1), sizes)
        keys, ids = keys[few], ids[few]
        allowed = _Allowed(sketch[few], size[few], num, den)
        at, left, right = np.arange(len(keys)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, BLOCK):
            at = at[at + k < len(keys)]
            at = at[keys[at] == keys[at + k]]
            if not len(at):
                break
            ok = at[allowed(at, at + k)]
            left.append(ids[ok])
            right.append(ids[ok + k])
        pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        if len(pair):
            out.append((None, None, None, pair[:, 0].tobytes(), pair[:, 1].tobytes(), None, None))
        return _out(out)

    return run


def _crossed(num: int, den: int):
    """The pairs of one or two blocks of a long run."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [(np.frombuffer(r.a, np.int64), np.frombuffer(r.sketch, np.uint64).reshape(-1, BITS // 64), np.frombuffer(r.size_, np.uint32)) for r in pdf.rename(columns={"size": "size_"}).drop_duplicates("block").itertuples()]
        (ids, sketch, size), (ids2, sketch2, size2) = blocks[0], blocks[-1]
        allowed = _Allowed(np.r_[sketch, sketch2], np.r_[size, size2], num, den)
        x, y = np.repeat(np.arange(len(ids)), len(ids2)), np.tile(np.arange(len(ids2)), len(ids))
        ok = allowed(x, y + len(ids)) & ((ids[x] < ids2[y]) if len(blocks) == 1 else True)
        a, b = ids[x[ok]], ids2[y[ok]]
        return _out([(None, None, None, np.minimum(a, b).tobytes(), np.maximum(a, b).tobytes(), None, None)])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["a", "b"])


def _verified(num: int, den: int):
    """The pairs (a, b, hashes of either) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, of), (y, of2) = _flat(batch.column(2).to_pylist()), _flat(batch.column(3).to_pylist())
            row, both = np.r_[of, of2], np.r_[x, y]
            order = np.lexsort((both, row))
            row, both = row[order], both[order]
            same = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=batch.num_rows)
            size = np.bincount(row, minlength=batch.num_rows)
            yield batch.select([0, 1]).filter(pa.array(den * same >= num * (size - same)))

    return run


class Likeness:
    """Classes of one table's texts and the links between them."""

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        #: (id, c) of every record with words; (a, b): links between the numbers of classes, a < b.
        self.members, self.links = members, links
        #: (c, class_id, size): a class is named by its smallest record.
        self.classes = members.groupBy("c").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))


def alike(df: DataFrame, key: str, text: Column, num: int = 7, den: int = 10) -> Likeness:
    """Links of all classes whose sets of words have at least num/den of their union in common."""
    work = Workdir(df.sparkSession, "alike")
    rows = df.select(F.col(key).cast("long").alias("id"), text.alias("text")).where("id is not null and text is not null")
    rows = work.keep(rows.mapInArrow(_sets, "id LONG, c LONG, hashes BINARY"), "sets")
    sets = rows.where("hashes is not null").select("c", "hashes")
    total, bytes_ = sets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()
    cells = min(CELLS[1], max(CELLS[0], 1 << (8 * total).bit_length()))
    counts = np.minimum(summed_cells(sets.select("hashes").mapInArrow(_cell_counts(cells), CELL_COUNTS), cells), 1 << 31).astype(np.uint32)
    held = df.sparkSession.sparkContext.broadcast(counts)
    rare = max(RARE, 2 * bytes_ // 8 // cells)
    parts = max(12, -(-total * SET_KEYS // PART_KEYS))
    packed = sets.mapInArrow(_packed_keys(held, rare, parts, num, den), "part INT, keys BINARY, ids BINARY, sketch BINARY, size BINARY")
    found = work.keep(packed.groupBy("part").applyInPandas(_paired(num, den), _PAIRS), "found")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cross = found.where("key is not null").withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    cross = cross.groupBy("key", "low", "high").applyInPandas(_crossed(num, den), _PAIRS)
    pairs = work.keep(found.where("key is null").unionByName(cross).select("a", "b").mapInArrow(_unpacked, "a LONG, b LONG").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = work.keep(sets.join(ends, "c", "left_semi").groupBy("c").agg(F.any_value("hashes").alias("hashes")), "wanted")
    both = pairs.join(wanted.select(F.col("c").alias("a"), F.col("hashes").alias("x")), "a").join(wanted.select(F.col("c").alias("b"), F.col("hashes").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_verified(num, den), "a LONG, b LONG")
    return Likeness(rows.select("id", "c"), work.keep(links, "links"))


def groups(found: Likeness) -> DataFrame:
    """(id, group_id, links): each record's group, named by its smallest record, and the number of links of its class.

    Groups are the connected parts of the links. In each round a class takes the least label among its own, its neighbours' and its
    label's label, so chains shrink by halves; each round is written to the shared folder and only counts go to the driver.
    """
    work = Workdir(found.links.sparkSession, "groups")
    classes = work.keep(found.classes, "classes")
    named = found.links.join(classes.select(F.col("c").alias("a"), F.col("class_id").alias("x")), "a").join(classes.select(F.col("c").alias("b"), F.col("class_id").alias("y")), "b")
    named = named.select(F.col("x").alias("a"), F.col("y").alias("b"))
    both = work.keep(named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = work.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        up = labels.select(F.col("a").alias("label"), F.col("label").alias("up"))
        step = labels.join(near, "a").join(up, "label", "left")
        new = work.keep(step.select("a", F.least("label", "near", F.coalesce("up", F.col("label"))).alias("new"), "label"), f"step{turn}")
        if not new.where("new != label").limit(1).count():
            break
        labels = new.select("a", F.col("new").alias("label"))
        if turn > 2:
            work.drop(f"step{turn - 2}")
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    known = labels.join(degree, "a").select(F.col("a").alias("class_id"), "label", "links")
    rows = found.members.join(classes.join(known, "class_id", "left"), "c")
    return rows.select("id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def record_pairs(found: Likeness) -> DataFrame:
    """(rec_id_a, rec_id_b): all pairs of records, of linked classes and within a class.

    A class of many records meets itself in blocks of about ``BLOCK`` records, each two of them in a group of their own.
    """
    m = found.members
    again = m.join(found.classes.where("size > 1").select("c", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "c")
    again = again.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = again.select("c", F.col("own").alias("i"), F.col("other").alias("j"), "id")
    y = again.select("c", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("id2"))
    within = x.join(y, ["c", "i", "j"]).where("id < id2").select("id", "id2")
    across = found.links.join(m.select(F.col("c").alias("a"), "id"), "a").join(m.select(F.col("c").alias("b"), F.col("id").alias("id2")), "b").select("id", "id2")
    both = within.unionByName(across)
    return both.select(F.least("id", "id2").alias("rec_id_a"), F.greatest("id", "id2").alias("rec_id_b"))
