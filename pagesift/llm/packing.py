"""Packing texts into containers of fixed capacity: hierarchical residual packing.

Every partition packs its items best-fit in chunks of bounded size, without an
exchange. Bins that are nearly full are done; each of the others becomes one item
of the next round, in which ever fewer, fuller groups of bins meet. Only bins move
between rounds, one row each; the items are told their container at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.tokens import DEFAULT_FILE, encoding
from pagesift.plans.stages import drop_stage, stage


def _sizes(file: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(file)
        for batch in batches:
            keys, pieces, sizes = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or text.isspace():
                    continue
                n = len(enc.encode_ordinary(text))
                for piece, at in enumerate(range(0, n, capacity)):
                    keys.append(key)
                    pieces.append(piece)
                    sizes.append(min(capacity, n - at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), pa.array(pieces, pa.int32()), pa.array(sizes, pa.int32())], ["item", "piece", "tokens"]
            )

    return run


def token_pieces(texts: DataFrame, capacity: int, file: str = DEFAULT_FILE) -> DataFrame:
    """(item, piece, tokens) of every text of ``texts`` (item, text); only a text of more than ``capacity`` tokens has several.

    Piece p holds the tokens from p x capacity on. Null, empty and blank texts have none.
    """
    kind = dict(texts.dtypes)["item"]
    return texts.select("item", "text").mapInArrow(_sizes(file, capacity), f"item {kind}, piece int, tokens int")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, largest first into the fullest bin that still has room."""
    bins_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, out, made = 0, np.empty(len(sizes), np.int64), 0  # rooms: bit r is set if a bin has r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = bins_by_room[room].pop()
            if not bins_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        out[i] = b
        left = room - size
        if left:
            bins_by_room[left].append(b)
            rooms |= 1 << left
    return out


def _round(number: int, capacity: int, group_items: int):
    """(id..., size) rows -> the same with bin and bin_tokens; a chunk of at most ``group_items`` rows is packed at a time.

    The last column is the size. A bin's number tells round, partition and place, so
    it is unique, and the same if the task runs again.
    """

    def packed(rows: pa.Table, made: int) -> tuple[pa.RecordBatch, int]:
        sizes = rows.column(rows.num_columns - 1).to_numpy().astype(np.int64)
        if len(sizes) and sizes.max() > capacity:  # reported by the driver
            bins, filled = np.full(len(sizes), -1, np.int64), sizes
        else:
            at = best_fit(sizes, capacity)
            filled = np.bincount(at, sizes).astype(np.int64)[at]
            bins = at + made + (number << 58) + (TaskContext.get().partitionId() << 34)
            made += int(at.max()) + 1
        columns = [*rows.combine_chunks().columns, pa.array(bins), pa.array(filled.astype(np.int32))]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, [*rows.column_names, "bin", "bin_tokens"]), made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, made = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, group_items - count)
                held.append(part)
                at += part.num_rows
                count += part.num_rows
                if count == group_items:
                    out, made = packed(pa.Table.from_batches(held), made)
                    yield out
                    held, count = [], 0
        if count:
            yield packed(pa.Table.from_batches(held), made)[0]

    return run


def pack(items: DataFrame, capacity: int, *, group_items: int = 20_000, full: float = 0.98, gain: float = 0.01) -> DataFrame:
    """(item, piece, tokens, container, container_tokens) of ``items`` (item, piece, tokens).

    ``group_items``: the most rows, items or open bins, that a task packs at once,
    whatever the sizes; ``full``: a bin at least so full is done; ``gain``: a round that
    merges less than this share of the bins it was given is the last, so items that
    can't share a container end after one fruitless round instead of being gathered.
    A last round has one group only if the open bins are no more than ``group_items``.

    Defined cases: items of ``capacity`` tokens have a container of their own; items
    of no tokens go nowhere; a null item is an item; a larger item raises an error (divide it first); equal
    rows are packed as often as they occur; no items, no rows; other columns are ignored.
    """
    kind = dict(items.dtypes)["item"]
    rows = items.where("tokens > 0").select("item", F.col("piece").cast("int"), F.col("tokens").cast("int"))
    first = stage(rows.mapInArrow(_round(0, capacity, group_items), f"item {kind}, piece int, tokens int, bin long, bin_tokens int"), "packed")
    is_open = F.col("bin_tokens") < full * capacity
    left = first.where(is_open)
    largest, bins = first.agg(F.max("tokens"), F.count_distinct(F.when(is_open, F.col("bin")))).first()
    if largest is not None and largest > capacity:
        drop_stage(first)
        raise ValueError(f"an item has {largest} tokens, a container holds {capacity}")
    moves: list[DataFrame] = []  # (id, bin_tokens of it, bin, bin_tokens) of each round
    left = left.select(F.col("bin").alias("id"), F.col("bin_tokens").alias("size")).distinct()
    while bins > 1:
        groups = max(1, math.ceil(bins / (0.95 * group_items))) if bins > group_items else 1
        met = left.repartition(groups, F.xxhash64("id", F.lit(len(moves)))).sortWithinPartitions("id")
        move = stage(met.mapInArrow(_round(len(moves) + 1, capacity, group_items), "id long, size int, bin long, bin_tokens int"), "moves")
        moves.append(move)
        after, done = move.agg(F.count_distinct("bin"), F.count_distinct(F.when(~is_open, F.col("bin")))).first()
        if groups == 1 or bins - after < gain * bins:
            break
        left = move.where(is_open).select(F.col("bin").alias("id"), F.col("bin_tokens").alias("size")).distinct()
        bins = after - done
    if not moves:
        return first.withColumnsRenamed({"bin": "container", "bin_tokens": "container_tokens"})
    home = moves[-1].select("id", "bin", "bin_tokens")
    for move in moves[-2::-1]:  # where the bin of each bin went in the end
        later = home.select(F.col("id").alias("bin"), F.col("bin").alias("container"), F.col("bin_tokens").alias("container_tokens"))
        home = move.join(later, "bin", "left").select("id", F.coalesce("container", "bin").alias("bin"), F.coalesce("container_tokens", "bin_tokens").alias("bin_tokens"))
    home = home.select(F.col("id").alias("bin"), F.col("bin").alias("container"), F.col("bin_tokens").alias("container_tokens"))
    moved = first.where(is_open).join(home, "bin", "left").select(
        "item", "piece", "tokens", F.coalesce("container", "bin").alias("container"), F.coalesce("container_tokens", "bin_tokens").alias("container_tokens")
    )
    kept = first.where(~is_open).select("item", "piece", "tokens", F.col("bin").alias("container"), F.col("bin_tokens").alias("container_tokens"))
    return kept.unionByName(moved)
