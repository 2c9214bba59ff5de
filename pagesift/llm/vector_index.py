"""Most similar vectors of every vector: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample. Every
vector is stored in the list of its nearest centroid; lists that lie together form
a shard, a shard of many vectors several cells. A query goes to the cells of the
``probes`` lists nearest to it, where asymmetric distance tables (exact query
against quantised residuals) rank the list and the best are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pagesift.operators.knn import class_neighbours
from pagesift.plans.stages import stage


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``; empty ones move to random rows."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        order = np.argsort(near, kind="stable")
        ids, first = np.unique(near[order], return_index=True)
        sums[ids] = np.add.reduceat(x[order], first, axis=0)
        n = np.bincount(near, minlength=k)
        c = sums / np.maximum(n, 1)[:, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row, in blocks of rows."""
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def spread_kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, flat: int = 2048) -> np.ndarray:
    """About ``k`` unit centroids; many are fitted in two levels, each part getting as many as its share of the rows."""
    if k <= flat:
        return kmeans(x, k, rounds, rng, unit=True)
    top = kmeans(x, round(k**0.5), rounds, rng, unit=True)
    near = np.argmax(x @ top.T, axis=1)
    parts = [x[near == i] for i in range(len(top))]
    return np.concatenate([kmeans(p, max(1, round(k * len(p) / len(x))), rounds, rng, unit=True) for p in parts if len(p)])


@dataclass
class Index:
    """What every task needs: a centroid per list, one list for the square root of the vectors, and 256 codes per subspace."""

    centroids: np.ndarray
    books: np.ndarray  # (subspaces, codes, width)
    shard: np.ndarray  # of each list
    cells: np.ndarray  # number of each shard
    first: np.ndarray  # cell number of each shard's first cell
    probes: int

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def pad(self, x: np.ndarray) -> np.ndarray:
        short = self.books.shape[0] * self.width - x.shape[1]
        return np.pad(x, ((0, 0), (0, short))) if short else x


def fit(sample: np.ndarray, rows: int, *, probes: float, least_probes: int = 1, sub_width: int = 4, cell_rows: int = 12_000, seed: int = 7) -> Index:
    """Fit on unit vectors ``sample``, drawn from ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    lists = int(np.clip(round(rows**0.5), 1, max(1, len(sample) // 8)))
    c = spread_kmeans(sample, lists, 8, rng)
    near = np.argmax(sample @ c.T, axis=1)
    subs = -(-sample.shape[1] // sub_width)
    rest = sample - c[near]
    rest = np.pad(rest, ((0, 0), (0, subs * sub_width - sample.shape[1])))
    some = rest if len(rest) <= 20_000 else rest[rng.choice(len(rest), 20_000, replace=False)]
    books = [kmeans(np.ascontiguousarray(some[:, i * sub_width : (i + 1) * sub_width]), 256, 4, rng) for i in range(subs)]
    share = np.bincount(near, minlength=len(c)) / max(len(sample), 1) * rows
    shard = np.zeros(len(c), np.int64)
    todo, done = [np.arange(len(c))], 0
    while todo:  # halve along the widest direction until a shard fits a cell, or is one list
        part = todo.pop()
        if len(part) == 1 or share[part].sum() <= cell_rows:
            shard[part] = done
            done += 1
            continue
        axis = np.linalg.svd(c[part] - c[part].mean(0), full_matrices=False)[2][0]
        order = part[np.argsort(c[part] @ axis, kind="stable")]
        cut = int(np.clip(np.searchsorted(np.cumsum(share[order]), share[order].sum() / 2), 1, len(order) - 1))
        todo += [order[:cut], order[cut:]]
    cells = np.maximum(1, np.ceil(np.bincount(shard, share, done) / cell_rows)).astype(np.int64)
    return Index(c, np.stack([_fill(b) for b in books]), shard, cells, np.cumsum(cells) - cells, probe_count(probes, len(c), least_probes))


def probe_count(probes: float, lists: int, least: int = 1) -> int:
    """A number of lists, or a share of them if below 1; ``least`` of them at least."""
    return max(1, min(max(least, int(probes if probes >= 1 else np.ceil(probes * lists))), lists))


def _fill(book: np.ndarray) -> np.ndarray:
    return book if len(book) == 256 else np.concatenate([book, np.full((256 - len(book), book.shape[1]), 1e4, np.float32)])


def usable_rows(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """The rows (id, vector, ...) with an id and a vector of ``dim`` finite numbers, not all 0."""
    vector = batch.column(1)
    ok = pc.and_(pc.is_valid(batch.column(0)), pc.equal(pc.fill_null(pc.list_value_length(vector), -1), dim))
    batch = batch.filter(ok)
    flat = batch.column(1).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls come as NaN
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return batch if good.all() else batch.filter(pa.array(good))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column whose rows all have ``dim`` finite values."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    flat /= np.abs(flat).max(axis=1, keepdims=True)  # else very large values overflow
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


_PLACED = "cell int, role int, id string, list int, probes binary, code binary, off float, vector binary"


def _place(index: Index, dim: int, only: bool):
    """Rows (role 0: a member of the cell; role 1: a query for the cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = usable_rows(batch.slice(at, 4096), dim)
                if not part.num_rows:
                    continue
                x = unit_rows(part.column(1), dim)
                asks = pc.fill_null(part.column(2), False).to_numpy(zero_copy_only=False) if only else np.ones(len(x), bool)
                s = x @ index.centroids.T
                own = np.argmax(s, axis=1)
                near = np.argpartition(-s, index.probes - 1, axis=1)[:, : index.probes] if index.probes < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(x), 1))
                rest = index.pad(x - index.centroids[own])
                w, code, off = index.width, [], np.zeros(len(x), np.float32)
                for m, book in enumerate(index.books):
                    sub = np.ascontiguousarray(rest[:, m * w : (m + 1) * w])
                    k = nearest(sub, book)
                    code.append(k.astype(np.uint8))
                    off += ((sub - book[k]) ** 2).sum(1)
                code = np.stack(code, axis=1)
                home = index.shard[own]
                block = (np.frombuffer(b"".join(_short(i) for i in part.column(0).to_pylist()), np.uint64) >> np.uint64(1)).astype(np.int64)
                mine = index.first[home] + block % index.cells[home]
                cell, who, lists, bounds = _asked(index, np.flatnonzero(asks), near[asks])
                # where a query's own cell is among those it asks, its member row asks
                same = mine[who] == cell
                probes = np.full(len(x), b"", object)
                raw = [lists[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                asked = np.array(raw, object) if raw else np.zeros(0, object)
                probes[who[same]] = asked[same]
                take = pa.array(np.r_[np.arange(len(x)), who[~same]])
                bytes_of = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                others = int((~same).sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[mine, cell[~same]].astype(np.int32)),
                        pa.array(np.r_[np.zeros(len(x)), np.ones(others)].astype(np.int32)),
                        part.column(0).take(take),
                        pa.array(own.astype(np.int32)).take(take),
                        pa.array([*probes.tolist(), *asked[~same].tolist()], pa.binary()),
                        pa.concat_arrays([bytes_of(code), pa.array([b""] * others, pa.binary())]),
                        pa.array(np.sqrt(off)).take(take),
                        bytes_of(x).take(take),
                    ],
                    names=["cell", "role", "id", "list", "probes", "code", "off", "vector"],
                )

    return run


def _asked(index: Index, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells asked, row asking, lists, bounds of each pair's lists) of rows and the lists they probe; a row asks all cells of a shard for the same lists."""
    who = np.repeat(rows, near.shape[1])
    lists = near.ravel().astype(np.int32)
    shard = index.shard[lists]
    order = np.lexsort((shard, who))
    who, lists, shard = who[order], lists[order], shard[order]
    first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (shard[1:] != shard[:-1])]) if len(who) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(who)])
    n = index.cells[shard[first]]  # cells of each pair's shard
    pair = np.repeat(np.arange(len(first)), n)
    cell = index.first[shard[first]][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    if len(pair) > len(first):  # some shards have several cells
        lists = np.concatenate([lists[first[p] : first[p] + size[p]] for p in pair.tolist()])
    return cell, who[first][pair], lists, np.r_[0, np.cumsum(size[pair])]


def _short(text: str) -> bytes:
    return xxhash.xxh3_64_digest(text)


class _Cell:
    """The members of one cell, ordered by list."""

    def __init__(self, index: Index, dim: int, tables: list[pa.RecordBatch]):
        t = pa.Table.from_batches(tables)
        ids = np.array(t.column("id").to_pylist(), object)
        _, one = np.unique(ids.astype(str), return_index=True)  # repeated rows of one vector
        lists = t.column("list").to_numpy()[one]
        order = one[np.argsort(lists, kind="stable")]
        self.index, self.ids = index, ids[order]
        self.lists = t.column("list").to_numpy()[order]
        self.vectors = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float32).reshape(-1, dim)[order]
        self.codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        self.off = t.column("off").to_numpy()[order]
        at, first = np.unique(self.lists, return_index=True)
        self.span = dict(zip(at.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))

    def search(self, ids: np.ndarray, q: np.ndarray, probes: list[bytes], k: int, least: float | None, rerank: int) -> pa.RecordBatch | None:
        index = self.index
        counts = np.array([len(p) // 4 for p in probes])
        asked = np.frombuffer(b"".join(probes), np.int32)
        who = np.repeat(np.arange(len(q)), counts)
        order = np.argsort(asked, kind="stable")
        asked, who = asked[order], who[order]
        padded = index.pad(q)
        w = index.width
        tables = [padded[:, m * w : (m + 1) * w] @ book.T for m, book in enumerate(index.books)]
        qs, xs = [], []
        for at, start, stop in zip(*_segments(asked), strict=True):
            if at not in self.span:
                continue
            a, b = self.span[at]
            rows = who[start:stop]
            rough = np.repeat((q[rows] @ index.centroids[at])[:, None], b - a, axis=1)
            for m, table in enumerate(tables):
                rough += np.take(table[rows], self.codes[a:b, m], axis=1)
            if least is not None:  # no vector is further from its code than its residual
                r, c = np.nonzero(rough + self.off[a:b] >= least - 1e-5)
            elif b - a > rerank:
                c = np.argpartition(-rough, rerank - 1, axis=1)[:, :rerank]
                r, c = np.repeat(np.arange(len(rows)), rerank), c.ravel()
            else:
                r, c = np.repeat(np.arange(len(rows)), b - a), np.tile(np.arange(b - a), len(rows))
            qs.append(rows[r])
            xs.append(c + a)
        if not qs:
            return None
        qi, xi = np.concatenate(qs), np.concatenate(xs)
        s = np.concatenate([np.einsum("ij,ij->i", q[qi[i : i + 65536]], self.vectors[xi[i : i + 65536]], dtype=np.float64) for i in range(0, len(qi), 65536)] or [np.zeros(0)])
        keep = ids[qi] != self.ids[xi]
        if least is not None:
            keep &= s >= least
        qi, xi, s = qi[keep], xi[keep], s[keep]
        order = np.lexsort((self.ids[xi].astype(str), -s, qi))
        qi, xi, s = qi[order], xi[order], s[order]
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, np.int64)
        rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
        best = rank < k
        return pa.RecordBatch.from_arrays([pa.array(ids[qi[best]], pa.string()), pa.array(self.ids[xi[best]], pa.string()), pa.array(s[best])], ["id", "neighbour", "similarity"])


def _segments(x: np.ndarray) -> tuple[list, list, list]:
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[start].tolist(), start.tolist(), [*start[1:].tolist(), len(x)] if len(x) else []


def _search(index: Index, dim: int, k: int, least: float | None, rerank: int):
    """Over rows sorted by (cell, role): members are kept, then queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, now = None, [], None
        for batch in batches:
            cells = batch.column(0).to_numpy()
            roles = batch.column(1).to_numpy()
            for _, start, stop in zip(*_segments(cells * 2 + roles), strict=True):
                part = batch.slice(start, stop - start)
                if cells[start] != cell:
                    if members:
                        yield from own(members)
                    cell, members, now = cells[start], [], None
                if roles[start] == 0:
                    members.append(part)
                    continue
                if members and now is None:
                    now = _Cell(index, dim, members)
                if now is not None:
                    yield from ask(now, part)
        if members:
            yield from own(members)

    def own(members: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Cell(index, dim, members)
        for part in members:
            yield from ask(now, part)

    def ask(now: _Cell, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.num_rows, 512):
            some = part.slice(at, 512)
            some = some.filter(pa.array([len(p) > 0 for p in some.column("probes").to_pylist()]))
            if not some.num_rows:
                continue
            q = np.frombuffer(b"".join(some.column("vector").to_pylist()), np.float32).reshape(-1, dim)
            out = now.search(np.array(some.column("id").to_pylist(), object), q, some.column("probes").to_pylist(), k, least, rerank)
            if out is not None and out.num_rows:
                yield out

    return run


def nearest_vectors(
    vectors: DataFrame,
    dim: int,
    *,
    k: int = 5,
    min_similarity: float | None = None,
    probes: float = 8,
    least_probes: int = 1,
    rerank: int = 10,
    fit_rows: int = 8_000,
    most_fit_rows: int = 262_144,
    ask: str | None = None,
    cell_rows: int = 12_000,
    sub_width: int = 4,
) -> DataFrame:
    """(id, neighbour, similarity): the ``k`` vectors of highest cosine similarity to each vector.

    ``vectors`` has id (string, unique but for equal rows) and vector (array of
    floats); rows without id, or whose vector is null, of another length than
    ``dim``, not finite or all 0, are left out; other columns are ignored. ``ask``: a boolean column; only rows where it
    is true ask, all are searched. ``min_similarity``: leave out less similar
    neighbours; then no member of a probed list is missed, for a vector lies no
    further from its code than its residual's error, which is stored. Otherwise the
    ``rerank`` members of best approximate similarity of each probed list are
    compared exactly. Loss: only through lists not probed (and ``rerank``).
    ``probes``: lists probed by a query, or their share if below 1, but ``least_probes`` at least.
    There is a list for the square root of the vectors. The fit takes a sample of about
    8 vectors a list, ``fit_rows`` at least and ``most_fit_rows`` at most (which serve
    10^9 vectors; of more, the lists grow); the index holds all vectors.

    ``sub_width``: dimensions per code byte; fewer give finer approximate similarities.

    Ties go by the neighbour's id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.count()
    if rows == 0:
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    fit_rows = min(max(fit_rows, round(8 * rows**0.5)), most_fit_rows)
    share = min(1.0, fit_rows / rows)
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("id", "vector")
    sample = _collect(picked.limit(2 * fit_rows), dim)
    if sample.num_rows == 0:  # the hash left out all of a few rows
        sample = _collect(vectors.select("id", "vector").limit(fit_rows), dim)
    if sample.num_rows == 0:
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    sample = sample.sort_by("id")
    index = fit(unit_rows(sample.column("vector"), dim), rows, probes=probes, least_probes=least_probes, cell_rows=cell_rows, sub_width=sub_width)
    cells = int(index.cells.sum())
    placed = vectors.select("id", "vector", *([ask] if ask else [])).mapInArrow(_place(index, dim, ask is not None), _PLACED)
    placed = placed.repartitionById(min(cells, 100_000), F.col("cell")).sortWithinPartitions("cell", "role")  # a cell, a task
    part = placed.mapInArrow(_search(index, dim, k, min_similarity, rerank), "id string, neighbour string, similarity double")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return _first(part, best, k)


def _first(part: DataFrame, best: WindowSpec, k: int) -> DataFrame:
    """The first ``k`` neighbours of each id; a pair found through equal rows of one id counts once."""
    ranked = part.withColumn("_r", F.dense_rank().over(best)).where(F.col("_r") <= k)
    return ranked.dropDuplicates(["id", "neighbour"]).drop("_r")  # within the window's partitions


def _collect(df: DataFrame, dim: int) -> pa.RecordBatch:
    """The usable rows of a bounded sample."""
    batches = [usable_rows(b, dim) for b in df.toArrow().to_batches()]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if any(b.num_rows for b in batches) else pa.RecordBatch.from_pylist([], pa.schema([("id", pa.string()), ("vector", pa.list_(pa.float32()))]))


def brute_force(vectors: DataFrame, dim: int, *, k: int, ask: str, block: int = 20_000) -> DataFrame:
    """The exact answer for the rows where ``ask`` is true, by blocks of them against blocks of all. For measuring the index.

    Similarities are rounded to 12 places, ties go by the neighbour's id.
    """
    usable = vectors.select("id", "vector", ask).mapInArrow(lambda batches: (usable_rows(b, dim) for b in batches), f"id string, vector {dict(vectors.dtypes)['vector']}, asks boolean")
    rows = stage(usable.dropDuplicates(["id"]), "usable")
    found = class_neighbours(rows.where("asks").select("id", "vector"), rows.select("id", F.lit(0).alias("label"), "vector"), k + 1, block=block)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    others = found.where("query_id <> chunk_id").select(F.col("query_id").alias("id"), F.col("chunk_id").alias("neighbour"), "similarity")
    return _first(others, best, k)


def with_copies(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbours of every member of classes of equal vectors, from those of the class's first member.

    ``members``: id, cls (class key), first (the class's smallest id). Only the k + 1
    smallest ids of a class can be among anybody's k best (equal vectors tie, ties go
    by id), so a class of any size adds k rows per member and k + 1 per neighbour.
    """
    place = Window.partitionBy("cls").orderBy("id")
    heads = stage(members.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + 1).drop("_r"), "heads")
    near = found.join(heads.select(F.col("first").alias("neighbour"), F.col("id").alias("other")), "neighbour")
    near = near.select(F.col("id").alias("first"), "other", "similarity")
    several = heads.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first")
    same = heads.join(several, "first", "left_semi").select("first", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    each = members.select("id", "first").join(near.unionByName(same), "first").where("id <> other")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    ranked = each.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return ranked.select("id", F.col("other").alias("neighbour"), "similarity")
