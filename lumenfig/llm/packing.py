"""Fills containers of fixed capacity with items of varying length, by minimum bin slack.

Lengths are counted in tokens of a public tokenizer, whose vocabulary file is a
parameter and is sent to the executors. Items are dealt into windows of about
``window`` items by a hash, and each window is packed by itself, so a window
wastes at most its last containers. In a window only the counts of each length
matter: for each container the longest remaining item is set, a bitset of
reachable sums is grown over the remaining lengths (each count in binary parts), the sum
closest to capacity is taken, and its counts are traced back. The same mix is used as often as the
counts allow. Windows spread over the cluster; nothing is gathered.

An item longer than the capacity, and no other, is divided: into pieces of the
full capacity, each a container of its own, and a remainder that is packed like any item.
Null and empty texts have no tokens and are not packed. Repeated rows are items of their own; equal
lengths are taken in the order of their ids, so the result doesn't depend on row order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A public byte-level vocabulary; another file of the same library may be named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@cache
def _tokenizer(name: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(SparkFiles.get(name))
    made.encode_special_tokens = True
    return made


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens) of every text with at least one token."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = _tokenizer(name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = []
            for i in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in made.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "tokens"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null and text != ''")
    return rows.mapInArrow(run, "id LONG, tokens LONG").where("tokens > 0")


def least_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths and how many of each, number of containers filled so), until nothing remains; no length exceeds capacity."""
    left = dict(counts)
    order = sorted((n for n in left if left[n]), reverse=True)
    while order:
        longest = order[0]
        room = capacity - longest
        mask, reach = (1 << (room + 1)) - 1, 1
        steps: list[tuple[int, int, int]] = []
        for n in order:
            if n > room:
                continue
            many, part = left[n] - (n == longest), 1
            while many > 0 and n <= room:
                k = min(part, many, room // n)
                steps.append((n, k, reach))
                reach |= (reach << (n * k)) & mask
                many, part = (many - k, part * 2) if k == min(part, many) else (0, part)
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        used: Counter[int] = Counter({longest: 1})
        for n, k, before in reversed(steps):
            if not before >> at & 1:
                used[n] += k
                at -= n * k
        times = min(left[n] // k for n, k in used.items())
        yield dict(used), times
        for n, k in used.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]


def _pack(capacities: dict[str, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "tokens"])
        ids, sizes, window = pdf["id"].to_numpy(), pdf["tokens"].to_numpy(), int(pdf["window"].iloc[0])
        out: list[tuple[str, int, int, int, int, int]] = []
        for pack, capacity in capacities.items():
            made = 0
            shelf: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for i, n in zip(ids.tolist(), sizes.tolist()):
                whole, rest = divmod(n, capacity) if n > capacity else (0, n)
                for piece in range(whole):
                    out.append((pack, window, made, i, piece, capacity))
                    made += 1
                if rest:
                    shelf[rest].append((i, whole, rest))
            for items in shelf.values():
                items.reverse()
            for used, times in least_slack({n: len(x) for n, x in shelf.items()}, capacity):
                for _ in range(times):
                    for n, k in used.items():
                        for _ in range(k):
                            i, piece, size = shelf[n].pop()
                            out.append((pack, window, made, i, piece, size))
                    made += 1
        return pd.DataFrame(out, columns=["pack", "window", "container", "doc_id", "piece", "tokens"])

    return run


def packed(sizes: DataFrame, packs: DataFrame, window: int = 20_000, total: int | None = None) -> DataFrame:
    """(pack, window, container, doc_id, piece, tokens): every item's container of each kind.

    sizes: id, tokens. packs: pack, capacity; a few kinds, read to the driver (more
    than 1,000 are refused). A container is named by its pack, window and number.
    """
    kinds = packs.where("pack is not null and capacity > 0").select("pack", "capacity").distinct().limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 kinds of containers")
    capacities = {r[0]: int(r[1]) for r in sorted(kinds)}
    total = sizes.count() if total is None else total
    windows = max(1, -(-total // window))
    return (
        sizes.withColumn("window", F.pmod(F.xxhash64("id"), F.lit(windows)).cast("int"))
        # A window takes far longer than its few bytes tell, so windows are dealt out by number and not merged by size.
        .repartition(windows, "window")
        .groupBy("window")
        .applyInPandas(_pack(capacities), "pack STRING, window INT, container INT, doc_id LONG, piece INT, tokens LONG")
    )


def fill(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack, containers, tokens, filled): how full the containers of each kind are."""
    used = rows.groupBy("pack", "window", "container").agg(F.sum("tokens").alias("tokens"))
    used = used.groupBy("pack").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(packs.select("pack", "capacity").distinct(), "pack").select(
        "pack", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled")
    )
