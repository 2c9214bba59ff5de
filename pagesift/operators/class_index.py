"""A persisted index of chunk vectors per class: coarse lists, probed by the nearest centroids, compared exactly.

Every class has its own centroids. A chunk is stored with its list in a versioned
collection, which later loads are merged into. A search sends the chunks to cells
(lists that lie together, of bounded size) and every query to the cells of the lists
it probes, so what moves grows with the chunks and the queries, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.knn import FOUND, class_comparison
from pagesift.operators.ranking import first_in_groups
from pagesift.plans.joins import broadcast_if_small
from pagesift.plans.stages import stage
from pagesift.sources.sinks import open_collection, read_json, upsert, write_json


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _centroids(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; a centroid without members keeps its place."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.maximum(length, 1e-12), c)
    return c.astype(np.float32)


def fit_index(chunks: DataFrame, folder: str, dim: int, *, fit_rows: int = 8_000, most_fit_rows: int = 262_144, seed: int = 7) -> None:
    """Fit the centroids of every class of ``chunks`` (id, label, vector) and write them to ``folder``.

    A class gets a list for the square root of its chunks, fitted on a sample of about 8
    chunks a list, ``fit_rows`` at least and ``most_fit_rows`` at most. Classes are few.
    """
    spark = chunks.sparkSession
    sizes = {r["label"]: r["n"] for r in chunks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    lists = []
    for label, n in sorted(sizes.items()):
        want = min(max(fit_rows, round(8 * n**0.5)), most_fit_rows)
        share = max(1, min(1_000_000, round(1_000_000 * want / n)))
        picked = chunks.where((F.col("label") == label) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share))
        sample = picked.select("id", "vector").limit(2 * want).toArrow().sort_by("id")
        if not sample.num_rows:  # the hash left out all of a few rows
            sample = chunks.where(F.col("label") == label).select("id", "vector").limit(want).toArrow().sort_by("id")
        x = _units(sample.column("vector").combine_chunks(), dim)
        c = _centroids(x, max(1, min(round(n**0.5), len(x) // 8)), 8, np.random.default_rng(seed))
        lists += [(label, i, v.tolist()) for i, v in enumerate(c)]
    spark.createDataFrame(lists, "label int, list int, vector array<float>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    write_json(spark, {"dim": dim, "labels": sorted(sizes)}, f"{folder}/index.json")


def _load(spark: SparkSession, folder: str) -> tuple[int, dict[int, np.ndarray]]:
    """(dim, centroids by class): at most a list for the square root of the chunks."""
    about = read_json(spark, f"{folder}/index.json")
    if about is None:
        raise FileNotFoundError(f"no index in {folder}")
    rows = spark.read.parquet(f"{folder}/centroids").toArrow().sort_by([("label", "ascending"), ("list", "ascending")])
    labels, x = rows.column("label").to_numpy(), rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, about["dim"])
    return about["dim"], {int(y): x[labels == y] for y in np.unique(labels)}


def add_chunks(chunks: DataFrame, folder: str, *, order: str, buckets: int = 64) -> None:
    """Merge ``chunks`` (id, label, vector, ``order``) into the index: the last of each id stays. A class without centroids raises an error."""
    spark = chunks.sparkSession
    dim, centroids = _load(spark, folder)
    schema = chunks.select("id", "label", "vector", order).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                labels, x = part.column(1).to_numpy(), _units(part.column(2), dim)
                own = np.zeros(len(x), np.int32)
                for y in np.unique(labels):
                    mine = labels == y
                    own[mine] = np.argmax(x[mine] @ centroids[int(y)].T, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], [*part.schema.names, "list"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    placed = chunks.select("id", "label", "vector", order).mapInArrow(place, fields + ", list int")
    upsert(spark, f"{folder}/lists", placed, "id", order, "label", buckets=buckets)


def open_index(spark: SparkSession, folder: str, label: int | None = None, refresh: Callable[[], None] | None = None) -> DataFrame:
    """The index's current chunks (id, label, vector, list, ...); ``label`` prunes the classes. See ``open_collection``."""
    return open_collection(spark, f"{folder}/lists", label, refresh)


def _cells(counts: list[tuple[int, int, int]], centroids: dict[int, np.ndarray], cell_rows: int) -> tuple[dict[tuple[int, int], tuple[int, int]], int]:
    """({(label, list): (first cell, cells)}, cells): neighbouring lists share a cell of at most ``cell_rows`` chunks, a longer list has several."""
    where, made = {}, 0
    for label, c in centroids.items():
        sizes = {i: n for y, i, n in counts if y == label}
        axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0] if len(c) > 1 else np.zeros(c.shape[1])
        room = 0
        for i in np.argsort(c @ axis, kind="stable").tolist():
            n = sizes.get(i, 0)
            if n > cell_rows:
                parts = -(-n // cell_rows)
                where[label, i], made, room = (made, parts), made + parts, 0
            elif n:
                if n > room:
                    made, room = made + 1, cell_rows
                where[label, i] = made - 1, 1
                room -= n
    return where, made


def index_neighbours(
    queries: DataFrame, folder: str, k: int, *, probes: float = 0.1, least_probes: int = 24, cell_rows: int = 12_000
) -> DataFrame:
    """(query_id, label, chunk_id, similarity, rank): as ``class_neighbours``, over the index in ``folder``; queries (id, vector) have usable vectors.

    A query probes a share of each class's lists (``least_probes`` at least) and is
    compared exactly with all chunks of their cells. What is lost is in no such cell.
    """
    spark = queries.sparkSession
    dim, centroids = _load(spark, folder)
    index = open_index(spark, folder)
    counts = [tuple(r) for r in index.groupBy("label", "list").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per list
    where, cells = _cells(counts, centroids, cell_rows)
    if not cells:
        return spark.createDataFrame([], FOUND + ", rank int")
    table = spark.createDataFrame([(*at, *to) for at, to in where.items()], "label int, list int, _first int, _n int")
    member = index.join(broadcast_if_small(table), ["label", "list"])
    cell = (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_n"))).cast("int")
    members = member.select(cell.alias("cell"), F.lit(0).alias("role"), "id", "label", "vector")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, who, to = _units(part.column(1), dim), [], []
                for label, c in centroids.items():
                    n = max(1, min(len(c), max(least_probes, int(np.ceil(probes * len(c))) if probes < 1 else int(probes))))
                    near = np.argpartition(-(x @ c.T), n - 1, axis=1)[:, :n]
                    asked = np.zeros((len(x), cells), bool)
                    for i in np.unique(near).tolist():
                        first, several = where.get((label, i), (0, 0))
                        asked[(near == i).any(axis=1), first : first + several] = True
                    r, t = np.nonzero(asked)
                    who.append(r)
                    to.append(t)
                take = pa.array(np.concatenate(who))
                zero = pa.array(np.zeros(len(take), np.int32))
                cell = pa.array(np.concatenate(to).astype(np.int32))
                yield pa.RecordBatch.from_arrays([cell, pa.array(np.ones(len(take), np.int32)), part.column(0).take(take), zero, part.column(1).take(take)], ["cell", "role", "id", "label", "vector"])

    kind = dict(index.dtypes)["vector"]
    schema = f"cell int, role int, id string, label int, vector {kind}"
    asking = queries.select("id", F.col("vector").cast(kind).alias("vector")).mapInArrow(ask, schema)
    met = members.unionByName(asking).repartitionById(min(cells, 100_000), F.col("cell")).sortWithinPartitions("cell", "role")
    # a cell's best of a query travel as one row and are ranked where they meet
    best = met.mapInArrow(_compare(k), "query_id string, label int, chunk_ids array<string>, similarities array<double>")
    pairs = F.inline(F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("similarities").alias("similarity")))
    best = best.repartition("query_id", "label").select("query_id", "label", pairs)
    return first_in_groups(best, ["query_id", "label"], [F.desc("similarity"), F.asc("chunk_id")], k)


def _compare(k: int):
    """Over rows sorted by cell and role: a cell's chunks are kept, its queries stream past them."""
    compare = class_comparison(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, right = None, [], None
        for batch in batches:
            mark = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if mark[a] // 2 != now:
                    now, held, right = mark[a] // 2, [], None
                if mark[a] % 2 == 0:
                    held.append(part.select(["id", "label", "vector"]).rename_columns(["cid", "clabel", "cvector"]))
                elif held:
                    right = right if right is not None else pa.concat_tables(held).combine_chunks()
                    yield from _lists(compare(part.select(["id", "vector"]), right))

    return run


def _lists(found: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, label, chunk_id, similarity), those of a query and class in a row, as one row of lists each."""
    if not found.num_rows:
        return
    found = found.combine_chunks()
    query, label, chunk, similarity = (c.chunk(0) for c in found.columns)
    names = query.dictionary_encode().indices.to_numpy()
    new = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (np.diff(label.to_numpy()) != 0)])
    offsets = pa.array(np.r_[new, found.num_rows].astype(np.int32))
    columns = [query.take(pa.array(new)), label.take(pa.array(new)), pa.ListArray.from_arrays(offsets, chunk), pa.ListArray.from_arrays(offsets, similarity)]
    yield pa.RecordBatch.from_arrays(columns, ["query_id", "label", "chunk_ids", "similarities"])
