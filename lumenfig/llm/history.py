"""Checks each new batch against all accepted history with immutable suffix arrays.

Every accepted batch becomes one segment, a set of files in the shared folder, one for each shard: the concatenated text
as word hashes, the starts of its suffixes in sorted order (four bytes each, sorted as deep as ``least`` words), and
for each start the earliest record with these words. A segment is never changed. The two newest are merged into one while
the older isn't at least twice as large, so there are at most log2 of the history's size, a word is rewritten at most as
often, and a large first batch isn't rewritten for small ones.

A new batch sends its own stretches to the shards; a task opens the files of its shard and looks each window of
``least`` words up by binary search. On a file system of the machine or a mounted one files are mapped, so a lookup reads log2 of
the shard's pages; elsewhere a task reads its shard's files. History's records are never read again, nor shuffled, and
:meth:`History.open` goes on with a history that another session wrote.

Two ways to cut texts into stretches:

* whole fields (``least=None``): a field is one stretch of four words, its checksum, in the shard of
  its hash; a match covers the field. Used for identities.
* substrings (``least=L`` words): the stretches are the longest in which all windows of L words have the same least
  word hash, which names the shard. So equal windows meet in one shard, and a text is stored about twice.
  Windows that history holds are united per record into its coverage.

Word hashes have 32 bits; windows are taken as equal if all their hashes are. Nulls, and texts shorter than L words,
identify nothing and are accepted. Repeated rows of one record count once. Empty batches and an empty history give no matches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfig.llm.common import checksum_of, paper_of, words
from lumenfig.workdir import Workdir, qualified

#: Words of a whole field, which is its checksum.
FIELD_WORDS = 4
#: Stretches of one shard, packed: word hashes, words of each stretch, its record, its place there.
PACKED = "shard INT, salt INT, text BINARY, sizes BINARY, owners BINARY, at BINARY"
#: Parts in which a shard's stretches of a batch are looked up, so that a hot shard isn't one task's.
SALTS = 8


def _file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path in it; Hadoop's names of object stores are known by their plain ones."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Shard:
    """A segment's file of one shard."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> None:
        self.text, self.starts, self.owners = text, starts, owners

    @classmethod
    def made(cls, text: np.ndarray, starts: np.ndarray, owners: np.ndarray, least: int) -> Shard:
        """The suffixes that begin at ``starts``, sorted; of those with the same first ``least`` words the earliest owner's. Text that no start needs is left out."""
        order = np.lexsort([owners, *(text[starts + j] for j in reversed(range(least)))])
        starts, owners = starts[order], owners[order]
        fresh = np.ones(len(starts), bool)
        if len(starts):
            fresh[1:] = np.any([text[starts[1:] + j] != text[starts[:-1] + j] for j in range(least)], 0)
        starts, owners = starts[fresh], owners[fresh]
        used = np.zeros(len(text) + 1, np.int64)
        np.add.at(used, starts, 1)
        np.add.at(used, starts + least, -1)
        used = np.cumsum(used[:-1]) > 0
        return cls(text[used], (np.cumsum(used) - 1)[starts].astype(np.int32), owners)

    def write(self, path: str) -> int:
        """Writes the file under a name of its own, then gives it the one it is looked for: a task that runs twice does no harm."""
        fs, at = _file_system(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        part = f"{at}.{uuid.uuid4().hex[:8]}"
        with fs.open_output_stream(part) as out:
            out.write(np.array([len(self.text), len(self.starts)], np.int64).tobytes())
            for x, kind in ((self.owners, np.int64), (self.starts, np.int32), (self.text, np.uint32)):
                out.write(x.astype(kind).tobytes())
        try:
            fs.move(part, at)
        except OSError:
            # Not every file system puts one file in another's place; the one that is there says the same.
            if fs.get_file_info(at).type == arrow_fs.FileType.NotFound:
                raise
            fs.delete_file(part)
        return len(self.text)

    @classmethod
    def open(cls, path: str) -> Shard | None:
        fs, at = _file_system(path)
        if fs.get_file_info(at).type == arrow_fs.FileType.NotFound:
            return None
        if isinstance(fs, arrow_fs.LocalFileSystem):
            held = np.memmap(at, np.uint8, "r")
        else:
            with fs.open_input_file(at) as f:
                held = np.frombuffer(f.read(), np.uint8)
        words_, n = held[:16].view(np.int64).tolist()
        a, b = 16 + 8 * n, 16 + 12 * n
        return cls(held[b : b + 4 * words_].view(np.uint32), held[a:b].view(np.int32), held[16:a].view(np.int64))

    def find(self, text: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
        """Per window of ``text`` the earliest owner of the same words here, or the greatest number where there is none."""
        none = np.iinfo(np.int64).max
        if not len(self.starts) or not len(starts):
            return np.full(len(starts), none)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.starts))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            own = self._order(text, starts, np.minimum(middle, len(self.starts) - 1), least)
            low, high = np.where(open_ & (own > 0), middle + 1, low), np.where(open_ & (own <= 0), middle, high)
        at = np.minimum(low, len(self.starts) - 1)
        return np.where((low < len(self.starts)) & (self._order(text, starts, at, least) == 0), self.owners[at], none)

    def _order(self, text: np.ndarray, starts: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
        """Whether each window comes after (1), is equal to (0) or comes before (-1) the suffix at ``at``."""
        own, out = self.starts[at], np.zeros(len(starts), np.int8)
        for j in range(least):
            todo = np.flatnonzero(out == 0)
            if not len(todo):
                break
            x, y = text[starts[todo] + j], self.text[own[todo] + j]
            out[todo] = (x > y).astype(np.int8) - (x < y)
        return out


def _window_starts(sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stretch) of all windows of ``least`` words."""
    many = np.maximum(sizes - least + 1, 0)
    stretch = np.repeat(np.arange(len(sizes)), many)
    begin = np.cumsum(sizes) - sizes
    return begin[stretch] + np.arange(len(stretch)) - (np.cumsum(many) - many)[stretch], stretch


def _packed_rows(shard: np.ndarray, salt: np.ndarray, text: np.ndarray, sizes: np.ndarray, owners: np.ndarray, at: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    """One row for each shard and salt, of stretches of ``text``."""
    order = np.lexsort((salt, shard))
    shard, salt, sizes, owners, at, begin = (x[order] for x in (shard, salt, sizes, owners, at, begin))
    word = np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text = text[word]
    cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])]) if len(shard) else np.zeros(0, np.int64)
    ends, upto = np.r_[cuts[1:], len(shard)], np.r_[0, np.cumsum(sizes)]

    def packed(x: np.ndarray, kind: type) -> pa.Array:
        x = x.astype(kind)
        return pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())

    texts = pa.array([text[upto[a] : upto[b]].astype(np.uint32).tobytes() for a, b in zip(cuts, ends)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[cuts], pa.int32()), pa.array(salt[cuts], pa.int32()), texts, packed(sizes, np.int32), packed(owners, np.int64), packed(at, np.int32)], names=["shard", "salt", "text", "sizes", "owners", "at"]
    )


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(16)


def _stretches(shards: int, least: int):
    """Packed stretches of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            code: list[int] = []
            sizes = []
            for t in batch.column(1).to_pylist():
                found = words(t)
                for w in found:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF
                code += [known[w] for w in found]
                sizes.append(len(found))
            text, owners = np.array(code, np.uint32), batch.column(0).to_numpy(zero_copy_only=False)
            start, doc = _window_starts(np.array(sizes, np.int64), least)
            lead = _spread(text)[start[:, None] + np.arange(least)].min(1) if len(start) else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (doc[1:] != doc[:-1])]) if len(start) else np.zeros(0, np.int64)
            many = np.diff(np.r_[first, len(start)])
            begin, of = start[first], doc[first]
            at = begin - (np.cumsum(sizes) - sizes)[of] if len(of) else begin
            yield _packed_rows((lead[first] % np.uint64(shards)).astype(np.int64), owners[of] % SALTS, text, many + least - 1, owners[of], at, begin)

    return run


def _whole_fields(shards: int):
    """Packed stretches of fields, whose checksums come as 16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32), batch.num_rows
            owners = batch.column(0).to_numpy(zero_copy_only=False)
            shard = (_spread(text[::FIELD_WORDS]) % np.uint64(shards)).astype(np.int64)
            # Identities are distinct, so no shard is hot.
            yield _packed_rows(shard, np.zeros(n, np.int64), text, np.full(n, FIELD_WORDS), owners, np.zeros(n, np.int64), np.arange(n) * FIELD_WORDS)

    return run


#: Stretches that a task remembers, so as to send each to its segment once.
SEEN = 1_000_000


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed stretches without those that the task has passed on before for a record as early, so what very many records share isn't one task's load."""
    seen: dict[int, int] = {}
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        text, sizes, owners, at = _read(rows)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(text)) - np.repeat(begin, sizes)
        mixed = _spread(text) * np.uint64(0x9E3779B97F4A7C15) ^ _spread(place.astype(np.uint64) + np.uint64(1))
        marks = np.add.reduceat(mixed * (mixed >> np.uint64(32) | np.uint64(1)), begin) if len(sizes) else np.zeros(0, np.uint64)
        keep = np.zeros(len(sizes), bool)
        for i, (mark, owner) in enumerate(zip(marks.tolist(), owners.tolist())):
            if seen.get(mark, owner + 1) > owner:
                keep[i], seen[mark] = True, owner
        if len(seen) > SEEN:
            seen.clear()
        of = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in rows["sizes"]])
        yield _packed_rows(rows["shard"].to_numpy()[of][keep], rows["salt"].to_numpy()[of][keep], text, sizes[keep], owners[keep], at[keep], begin[keep])


def _read(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, sizes, owners, at) of packed rows."""
    return tuple(np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("text", np.uint32), ("sizes", np.int32), ("owners", np.int64), ("at", np.int32)))


class History:
    """The accepted texts, as segments of suffix arrays below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 32, least: int | None = None) -> None:
        self.spark, self.shards, self.least = spark, shards, least
        self.path = qualified(spark, path or Workdir(spark, "history").path)
        #: (name, words) of the segments, the oldest first.
        self.segments: list[tuple[str, int]] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history that another session has left at ``path``: of its numbered lists of segments the last."""
        fs, at = _file_system(qualified(spark, path))
        lists = [f.path for f in fs.get_file_info(arrow_fs.FileSelector(at)) if f.base_name.startswith("segments-") and f.base_name.endswith(".json")]
        with fs.open_input_stream(max(lists)) as f:
            said = json.loads(f.read())
        made = cls(spark, path, said["shards"], said["least"])
        made.segments, made.version = [(n, w) for n, w in said["segments"]], said["version"]
        return made

    @property
    def window(self) -> int:
        return self.least or FIELD_WORDS

    def stretches(self, rows: DataFrame, owner: str, text: Column) -> DataFrame:
        """The packed stretches of a batch; whole fields come as a checksum of 16 bytes, others as texts."""
        rows = rows.select(F.col(owner).cast("long").alias("owner"), text.alias("text")).where("owner is not null and text is not null")
        return rows.mapInArrow(_whole_fields(self.shards) if self.least is None else _stretches(self.shards, self.least), PACKED)

    def lookup(self, stretches: DataFrame) -> DataFrame:
        """(owner, start, stop, match): runs of words of a record that history holds, and the earliest record that holds any of their windows."""
        paths, least = [f"{self.path}/{name}" for name, _ in self.segments], self.window

        def probe(pdf: pd.DataFrame) -> pd.DataFrame:
            text, sizes, owners, at = _read(pdf)
            start, stretch = _window_starts(sizes, least)
            match = np.full(len(start), np.iinfo(np.int64).max)
            for path in paths:
                held = Shard.open(f"{path}/{int(pdf['shard'].iloc[0])}.seg")
                if held is not None:
                    match = np.minimum(match, held.find(text, start, least))
            hit = np.flatnonzero(match < np.iinfo(np.int64).max)
            begin = (np.cumsum(sizes) - sizes)[stretch]
            first = np.flatnonzero(np.r_[True, (start[hit][1:] != start[hit][:-1] + 1) | (stretch[hit][1:] != stretch[hit][:-1])]) if len(hit) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(hit)][: len(first)] - 1
            a, b = hit[first], hit[last]
            least_match = np.minimum.reduceat(match[hit], first) if len(first) else np.zeros(0, np.int64)
            place = at[stretch[a]] + start[a] - begin[a]
            return pd.DataFrame({"owner": owners[stretch[a]], "start": place, "stop": place + start[b] - start[a] + least, "match": least_match})

        return stretches.groupBy("shard", "salt").applyInPandas(probe, "owner LONG, start INT, stop INT, match LONG")

    def add(self, stretches: DataFrame) -> None:
        """A new segment, then merges of the newest while the one before isn't twice as large."""
        least, to = self.window, f"{self.path}/segment{self.version}"

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            text, sizes, owners, _ = _read(pdf)
            start, stretch = _window_starts(sizes, least)
            shard = int(pdf["shard"].iloc[0])
            return pd.DataFrame({"words": [Shard.made(text, start, owners[stretch], least).write(f"{to}/{shard}.seg")]})

        if self.least is not None:
            stretches = stretches.mapInArrow(_once, PACKED)
        made = stretches.groupBy("shard").applyInPandas(build, "words LONG").agg(F.sum("words")).first()[0]
        gone: list[str] = []
        if made:
            self.segments.append((f"segment{self.version}", int(made)))
        self._save()
        while len(self.segments) > 1 and self.segments[-2][1] < 2 * self.segments[-1][1]:
            gone += [name for name, _ in self.segments[-2:]]
            self._merge_last()
        for name in gone:
            fs, at = _file_system(f"{self.path}/{name}")
            fs.delete_dir(at)

    def _merge_last(self) -> None:
        paths, least, to = [f"{self.path}/{name}" for name, _ in self.segments[-2:]], self.window, f"{self.path}/segment{self.version}"

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    held = [h for p in paths if (h := Shard.open(f"{p}/{shard}.seg")) is not None]
                    if not held:
                        continue
                    shift = np.cumsum([0, *(len(h.text) for h in held)])
                    starts = np.concatenate([h.starts.astype(np.int64) + d for h, d in zip(held, shift)])
                    made = Shard.made(np.concatenate([h.text for h in held]), starts, np.concatenate([h.owners for h in held]), least)
                    yield pa.RecordBatch.from_arrays([pa.array([made.write(f"{to}/{shard}.seg")], pa.int64())], names=["words"])

        made = self.spark.range(0, self.shards, 1, min(self.shards, 64)).mapInArrow(merge, "words LONG").agg(F.sum("words")).first()[0]
        self.segments[-2:] = [(f"segment{self.version}", int(made))]
        self._save()

    def _save(self) -> None:
        """A new list of segments; the last one counts, so a session that fails leaves the one before."""
        self.version += 1
        fs, at = _file_system(self.path)
        fs.create_dir(at, recursive=True)
        said = {"shards": self.shards, "least": self.least, "segments": self.segments, "version": self.version}
        with fs.open_output_stream(f"{at}/part-{self.version}") as out:
            out.write(json.dumps(said).encode())
        fs.move(f"{at}/part-{self.version}", f"{at}/segments-{self.version:09d}.json")


def coverage(found: DataFrame) -> DataFrame:
    """(owner, covered, match): words of a record that history holds in runs, runs united; and the earliest record with any of them."""
    before = Window.partitionBy("owner").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("stop").over(before), F.lit(0))
    gain = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), seen))
    return found.withColumn("gain", gain).groupBy("owner").agg(F.sum("gain").alias("covered"), F.min("match").alias("match"))


#: Shared identities of a batch that one task settles in order; beyond that, rounds come first.
IN_ORDER = 2_000_000


def _in_order(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(owner, field): records taken in order, each accepted unless an identity of it is taken; the identities of the accepted."""
    held = list(pdfs)
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True).sort_values("owner", kind="stable")
    taken: set[bytes] = set()
    kept: list[tuple[int, bytes]] = []
    owners, fields = pdf["owner"].tolist(), [bytes(x) for x in pdf["field"]]
    i = 0
    while i < len(owners):
        j = i
        while j < len(owners) and owners[j] == owners[i]:
            j += 1
        if not taken.intersection(fields[i:j]):
            taken.update(fields[i:j])
            kept += [(owners[i], f) for f in fields[i:j]]
        i = j
    yield pd.DataFrame(kept, columns=["owner", "field"])


def _settle(work: Workdir, open_: DataFrame, left: int, name: str) -> DataFrame:
    """(owner, field): of records that share identities with others of their batch, the accepted ones' identities.

    As long as there are more than one task can hold, a round accepts every record that comes first for all its identities and takes out
    those that share one with it. A hot identity is settled by one round; what is left then goes in order in one task. left: rows of open_, or more.
    """
    out: list[DataFrame] = []
    turn = 0
    while left > IN_ORDER:
        turn += 1
        lead = open_.join(open_.groupBy("field").agg(F.min("owner").alias("first")), "field")
        won = lead.groupBy("owner").agg(F.min(F.col("owner") == F.col("first")).alias("won")).where("won").select("owner")
        taken = work.keep(open_.join(won, "owner", "left_semi"), f"{name}-taken{turn}")
        hit = open_.join(taken.select("field"), "field", "left_semi").select("owner").distinct()
        out.append(taken)
        open_ = work.keep(open_.join(hit, "owner", "left_anti"), f"{name}-open{turn}")
        left = open_.count()
        if turn > 1:
            work.drop(f"{name}-open{turn - 1}")
    out.append(open_.repartition(1).mapInPandas(_in_order, "owner LONG, field BINARY"))
    kept = out[0]
    for df in out[1:]:
        kept = kept.unionByName(df)
    return work.keep(kept, name)


#: Identities that a shard holds at most, on average.
SHARD_KEYS = 500_000


def repeated_deliveries(records: DataFrame, shards: int | None = None) -> DataFrame:
    """(rec_id_a, rec_id_b): each record of a later batch and the accepted record it repeats.

    records: rec_id, batch_no, doc_id, id, md5. The number of shards follows the number of records unless given. Two records agree if their
    checksums are equal or they are the same figure of the same paper, in whatever
    version. A record without either is accepted. Where several accepted
    records of batch 0 share an identity, the earliest stands for them, so a record has at most
    one row for each of its two identities. Rows without rec_id or batch_no take no part.
    """
    spark = records.sparkSession
    work = Workdir(spark, "deliveries")
    figure = F.concat_ws("#", paper_of(F.col("doc_id")), F.col("id").cast("string"))
    rows = records.where("rec_id is not null and batch_no is not null").select(
        F.col("rec_id").cast("long").alias("owner"), "batch_no", checksum_of(F.col("md5")).alias("sum"), F.when(paper_of(F.col("doc_id")).isNotNull() & F.col("id").isNotNull(), figure).alias("figure")
    )
    marks = F.array_compact(F.array(F.concat(F.lit("0:"), "sum"), F.concat(F.lit("1:"), "figure")))
    fields = rows.select("owner", "batch_no", F.explode(marks).alias("mark"))
    fields = fields.select("owner", "batch_no", F.left("mark", F.lit(1)).cast("long").alias("kind"), F.unhex(F.md5("mark")).alias("field"))
    sizes = records.where("rec_id is not null").groupBy("batch_no").count().where("batch_no is not null").collect()
    history = History(spark, shards=shards or max(12, -(-2 * sum(r[1] for r in sizes) // SHARD_KEYS)))
    out: DataFrame | None = None
    last = max((r[0] for r in sizes), default=0)
    for n in sorted(r[0] for r in sizes):
        own = fields.where(F.col("batch_no") == n).select("owner", "kind", "field")
        # Each distinct identity is looked up once, as that of its earliest record.
        least = own.groupBy("field").agg(F.min(2 * F.col("owner") + F.col("kind")).alias("nth"), (F.min("owner") != F.max("owner")).alias("shared"))
        if n <= 0:
            history.add(history.stretches(least.select(F.shiftright("nth", 1).alias("owner"), "field"), "owner", F.col("field")))
            continue
        match = history.lookup(history.stretches(least, "nth", F.col("field"))).select(F.col("owner").alias("nth"), "match")
        told = least.join(match, "nth", "left").where("shared or match is not null").select("field", "match")
        seen = work.keep(own.select("owner", "field").join(told, "field"), f"seen{n}")
        old = seen.where("match is not null").select("owner").distinct()
        contested = seen.where("match is null").join(old, "owner", "left_anti").select("owner", "field")
        taken = _settle(work, contested, seen.where("match is null").count(), f"taken{n}")
        both = seen.where("match is null").join(taken.select("field", F.col("owner").alias("first")), "field").where("first < owner").select("first", "owner")
        repeats = seen.where("match is not null").select(F.col("match").alias("first"), "owner").unionByName(both)
        gone = seen.select("owner").distinct().join(taken.select("owner").distinct(), "owner", "left_anti")
        if n != last:
            history.add(history.stretches(own.join(gone, "owner", "left_anti"), "owner", F.col("field")))
        out = repeats if out is None else out.unionByName(repeats)
    if out is None:
        return spark.createDataFrame([], "rec_id_a LONG, rec_id_b LONG")
    return out.select(F.col("first").alias("rec_id_a"), F.col("owner").alias("rec_id_b")).distinct()


def covered_by_history(records: DataFrame, key: str, batch: str, text: str, least: int = 5, share: float = 0.8, shards: int | None = None) -> DataFrame:
    """(key, n_words, n_covered, match): records of later batches of whose words at least ``share`` stand in runs of ``least`` words or more
    that texts of earlier batches hold, and the earliest such record.

    Records of one batch aren't compared with each other. Texts of fewer words have no runs.
    """
    spark = records.sparkSession
    work = Workdir(spark, "covered")
    rows = records.select(F.col(key).cast("long").alias("key"), F.col(batch).alias("batch"), F.col(text).alias("text")).where("key is not null and batch is not null and text is not null")
    sizes = rows.groupBy("batch").agg(F.sum(F.length("text") / 6)).collect()
    history = History(spark, shards=shards or max(12, int(2 * sum(r[1] for r in sizes)) // (32 * SHARD_KEYS)), least=least)
    out = spark.createDataFrame([], "key LONG, n_words INT, n_covered LONG, match LONG")
    count = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    last = max((r[0] for r in sizes), default=0)
    for n in sorted(r[0] for r in sizes):
        own = rows.where(F.col("batch") == n)
        made = work.keep(history.stretches(own, "key", F.col("text")), f"stretches{n}")
        if history.segments:
            found = coverage(history.lookup(made)).withColumnRenamed("owner", "key")
            hits = own.select("key", count.alias("n_words")).join(found, "key").where(F.col("covered") >= share * F.col("n_words"))
            out = out.unionByName(work.keep(hits.select("key", "n_words", F.col("covered").alias("n_covered"), "match"), f"hits{n}"))
        if n != last:
            history.add(made)
        work.drop(f"stretches{n}")
    return out
