"""Problem 3: the five most similar other chunks of every usable chunk vector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.vector_index import brute_force, nearest_vectors, with_copies
from pagesift.plans.joins import broadcast_if_small
from pagesift.plans.stages import stage
from pagesift.sources.tables import table

K = 5
#: Lists probed: a few hold the neighbours of a similarity of 0.85 or more. Those at any distance (0.4 as a rule
#: here) are looked for in a tenth of the lists, but in 24 at least, as few lists part small collections badly.
CLOSE_PROBES = 8
ANY = {"probes": 0.1, "least_probes": 24, "rerank": 32}
LOSERS = 500_000


def _loaded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """(all rows with their class, the same without vectors, last loaded usable row of each id, dimensions)."""
    runs = table(spark, folder, "materialize_manifest").groupBy("source_name").agg(F.max("embedding_dim").alias("dim"))
    rows = table(spark, folder, "chunk_vectors").join(broadcast_if_small(runs), "source_name", "left")  # a row per run
    rows = rows.where("id IS NOT NULL").select("id", "loaded_at", F.col("embedding").alias("vector"), "dim", F.xxhash64("dim", "embedding").alias("cls"))
    light = rows.select("id", "loaded_at", "cls", "dim", F.coalesce(_ok(), F.lit(False)).alias("ok"))
    last = light.groupBy("id").agg(F.max(F.struct("loaded_at", "cls", "ok", "dim")).alias("s"))
    last = stage(last.where("s.ok").select("id", "s.loaded_at", "s.cls", "s.dim"), "last")
    dims = [r[0] for r in runs.select("dim").distinct().where("dim IS NOT NULL").collect()]
    return rows, light, last, sorted(dims)


def _chosen(rows: DataFrame, light: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (id, loaded_at, cls); the others are taken out by a broadcast of their ids if they are at most LOSERS."""
    losers = stage(light.select("id", "loaded_at", "cls").join(wanted, ["id", "loaded_at", "cls"], "left_anti").distinct(), "losers")
    if losers.count() <= LOSERS:
        return rows.join(F.broadcast(losers), ["id", "loaded_at", "cls"], "left_anti")
    return rows.join(wanted, ["id", "loaded_at", "cls"])


def usable(spark: SparkSession, folder: str) -> tuple[dict[int, DataFrame], DataFrame]:
    """({dim: (id, vector) of one chunk of each class of equal vectors}, (id, cls, first, dim) of all usable chunks).

    Only the last loaded row of an id counts. The classes are found without moving a
    vector; the rows that don't stand for a class are few as a rule and then are
    taken out by a broadcast of their ids (at most LOSERS, counted), else by a join.
    """
    return _classes(*_loaded(spark, folder))


def _classes(rows: DataFrame, light: DataFrame, last: DataFrame, dims: list[int]) -> tuple[dict[int, DataFrame], DataFrame]:
    first = last.groupBy("cls").agg(F.min("id").alias("first"))
    members = stage(last.join(first, "cls").select("id", "cls", "first", "dim", "loaded_at"), "members")
    chosen = _chosen(rows, light, members.where("id = first").select("id", "loaded_at", "cls"))
    return {d: chosen.where(F.col("dim") == d).select("id", "vector") for d in dims}, members


def _ok() -> Column:
    """A vector of the run's size, of finite numbers, not all 0."""
    vector = F.col("vector")
    return (
        (F.size(vector) == F.col("dim"))
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def _neighbours(spark: SparkSession, folder: str, **how) -> DataFrame:
    by_dim, members = usable(spark, folder)
    found = [nearest_vectors(v, d, k=K, **how) for d, v in by_dim.items()]
    both = stage(reduce(DataFrame.unionByName, found), "found")
    return with_copies(both, members.select("id", "cls", "first"), K)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (id_a, id_b), id_a < id_b: one is among the five most similar of the other, at 0.85 or more."""
    near = _neighbours(spark, folder, min_similarity=0.85, probes=CLOSE_PROBES)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _asks(name: str = "id") -> Column:
    return F.pmod(F.xxhash64(name), F.lit(50)) == 0


def _nearest_of_asking(by_dim: dict[int, DataFrame], members: DataFrame) -> DataFrame:
    """(id, neighbour, similarity) of every chunk that asks, copies included: its class is searched for it, if the class's first chunk doesn't ask itself."""
    other = stage(members.where(_asks() & ~_asks("first")).select(F.col("first").alias("id"), F.lit(True).alias("copy_asks")).distinct(), "asking")
    found = []
    for d, v in by_dim.items():
        v = v.join(broadcast_if_small(other), "id", "left").withColumn("ask", _asks() | F.coalesce("copy_asks", F.lit(False)))
        found.append(nearest_vectors(v.select("id", "vector", "ask"), d, k=K, **ANY, ask="ask"))
    both = stage(reduce(DataFrame.unionByName, found), "found")
    return with_copies(both, members.select("id", "cls", "first"), K).where(_asks())


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar of every fiftieth vector (by hash of its id, copies too) against all: id, neighbour, similarity."""
    return _nearest_of_asking(*usable(spark, folder)).withColumn("similarity", F.round("similarity", 6))


def recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per dimension: queries, neighbours found by the index, of them among the exact ones of all usable chunks, recall."""
    rows, light, last, dims = _loaded(spark, folder)
    fast = _nearest_of_asking(*_classes(rows, light, last, dims)).select("id", "neighbour", F.lit(1).alias("hit"))
    fast = stage(fast, "fast")
    every = _chosen(rows, light, last.select("id", "loaded_at", "cls"))
    out = []
    for d in dims:
        v = stage(every.where(F.col("dim") == d).select("id", "vector").withColumn("ask", _asks()), "asking")
        true = brute_force(v, d, k=K, ask="ask")
        joined = true.join(fast, ["id", "neighbour"], "left")
        out.append(joined.agg(F.lit(d).alias("dim"), F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("true_neighbours"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")))
    return reduce(DataFrame.unionByName, out).withColumn("recall", F.round(F.col("hits") / F.greatest("true_neighbours", F.lit(1)), 4))


QUERIES = {"p3_found": found, "p3_neighbours": neighbours, "p3_recall": recall}
SQL = {
    "p3_found": """
WITH loaded AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS r FROM chunk_vectors),
v AS (SELECT l.id, m.embedding_dim AS dim, CAST(l.embedding AS DOUBLE[]) AS e FROM loaded l JOIN materialize_manifest m USING (source_name)
  WHERE l.r = 1 AND l.embedding IS NOT NULL AND len(l.embedding) = m.embedding_dim
  AND len(list_filter(l.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(l.embedding, lambda x: x <> 0)) > 0),
n AS (SELECT id, dim, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM n a JOIN n b ON a.dim = b.dim AND a.id <> b.id),
k AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY round(s, 7) DESC, b) AS r FROM s)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k WHERE r <= 5 AND s >= 0.85""",
}
