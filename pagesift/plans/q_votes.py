"""Queries from chunk vectors and hits to votes and evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.ids import clean_id
from pagesift.operators import evidence, metrics, voting
from pagesift.operators.class_index import add_chunks, fit_index, index_neighbours
from pagesift.operators.knn import class_neighbours
from pagesift.operators.ranking import rank_in_groups
from pagesift.plans.joins import broadcast_if_small
from pagesift.plans.stages import shared_folder, stage
from pagesift.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def vectors(spark, folder) -> DataFrame:
    """The last loaded, usable row of every chunk of the train and the test run, written once: id, source_file, label, source_name, vector."""
    runs = table(spark, folder, "materialize_manifest").groupBy("source_name").agg(F.max("embedding_dim").alias("dim"))
    rows = table(spark, folder, "chunk_vectors").join(broadcast_if_small(runs), "source_name")  # a row per run
    last = rows.groupBy("id").agg(F.max_by(F.struct("source_file", "label", "source_name", "dim", F.col("embedding").alias("vector")), "loaded_at").alias("r"))
    usable = last.select("id", "r.*").where((F.size("vector") == F.col("dim")) & _finite(F.col("vector"))).drop("dim")
    return stage(usable.where(F.col("source_name").isin("original_train", "original_test")), "vectors")


def neighbours(spark, folder, k: int, both: DataFrame | None = None) -> DataFrame:
    """Chunks of the test run against those of the train run: query_id, label, chunk_id, similarity, rank, page, source."""
    both = both or vectors(spark, folder)
    q, c = both.where("source_name = 'original_test'"), both.where("source_name = 'original_train'")
    found = class_neighbours(q.select("id", "vector"), c.select("id", "label", "vector"), k)
    pages = q.select(F.col("id").alias("query_id"), F.col("source_file").alias("page"))
    sources = c.select(F.col("id").alias("chunk_id"), F.col("source_file").alias("source"))
    return found.join(pages, "query_id").join(sources, "chunk_id")


_VECTORS = """cv0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM chunk_vectors),
cv AS (SELECT v.id, v.source_file, v.label, v.source_name, CAST(v.embedding AS DOUBLE[]) AS e FROM cv0 v JOIN materialize_manifest m USING (source_name)
  WHERE v.rn = 1 AND v.embedding IS NOT NULL AND len(v.embedding) = m.embedding_dim
  AND len(list_filter(v.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v.embedding, lambda x: x <> 0)) > 0),
nv AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM cv),
sims AS (SELECT q.id AS query_id, q.source_file AS page, c.label, c.id AS chunk_id, c.source_file AS source,
  round(least(1.0, greatest(0.0, list_dot_product(q.e, c.e) / (q.n * c.n))), 12) AS similarity
  FROM nv q, nv c WHERE q.source_name = 'original_test' AND c.source_name = 'original_train')"""


def _knn(k: int) -> str:
    return f"""{_VECTORS}, knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, chunk_id) AS rank FROM sims) WHERE rank <= {k})"""


_VOTE = f"""WITH {_knn(50)},
best AS (SELECT query_id, page, label, source, max(similarity) AS similarity FROM knn GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, source) AS rank FROM best) WHERE rank <= 10),
scores AS (SELECT page, label, source, 1 - product(1 - similarity) AS score FROM top GROUP BY page, label, source),
sums AS (SELECT page, round(coalesce(sum(score) FILTER (label = 0), 0), 9) AS b, round(coalesce(sum(score) FILTER (label = 1), 0), 9) AS p,
  count(*) FILTER (label = 0) AS unique_benign_sources, count(*) FILTER (label = 1) AS unique_phishing_sources FROM scores GROUP BY page),
votes AS (SELECT page, CAST(p > b AS INTEGER) AS predicted_label, b AS benign_score, p AS phishing_score,
  round(CASE WHEN p + b > 0 THEN p / (p + b) ELSE 0.5 END, 6) AS phishing_probability, unique_benign_sources, unique_phishing_sources,
  abs(p - b) <= 1e-8 + 1e-5 * abs(b) AS tie FROM sums),
truth AS (SELECT source_file AS page, max(label) AS true_label, count(*) AS num_query_chunks FROM nv WHERE source_name = 'original_test' GROUP BY source_file),
judged AS (SELECT * FROM votes JOIN truth USING (page))"""


@query(f"WITH {_knn(1)} SELECT query_id, label, chunk_id, round(similarity, 6) AS similarity FROM knn")
def knn_top1_by_class(spark, folder):
    """The nearest train chunk of each class for every test chunk."""
    return neighbours(spark, folder, 1).select("query_id", "label", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_knn(50)} SELECT query_id, label, chunk_id, round(similarity, 6) AS similarity, rank FROM knn")
def knn_top50_by_class(spark, folder):
    """The 50 nearest of each class."""
    return neighbours(spark, folder, 50).select("query_id", "label", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def _indexed(both: DataFrame, k: int) -> DataFrame:
    """Neighbours of the test run's chunks in an index of the train run's, built from two loads of which the second corrects the first."""
    folder = f"{shared_folder(both.sparkSession)}/index-{uuid.uuid4().hex}"
    q, c = both.where("source_name = 'original_test'"), both.where("source_name = 'original_train'").select("id", "label", "vector")
    fit_index(c, folder, 128)
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    wrong = c.where(~half).select("id", "label", F.transform("vector", lambda x: -x).alias("vector"), F.lit(1).alias("seq"))
    add_chunks(c.where(half).withColumn("seq", F.lit(1)).unionByName(wrong), folder, order="seq")
    add_chunks(c.where(~half).withColumn("seq", F.lit(2)), folder, order="seq")
    return index_neighbours(q.select("id", "vector"), folder, k)


@query()
def knn_index_top50(spark, folder):
    """The 50 nearest of each class from the persisted index, which is approximate."""
    found = _indexed(vectors(spark, folder), 50)
    return found.select("query_id", "label", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def knn_index_recall(spark, folder):
    """Per class: queries, exact neighbours among the first 50, those of them that the index finds, recall."""
    both = vectors(spark, folder)
    q, c = both.where("source_name = 'original_test'"), both.where("source_name = 'original_train'")
    true = class_neighbours(q.select("id", "vector"), c.select("id", "label", "vector"), 50)
    found = _indexed(both, 50).select("query_id", "label", "chunk_id", F.lit(1).alias("hit"))
    counts = true.join(found, ["query_id", "label", "chunk_id"], "left").groupBy("label").agg(
        F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("true_neighbours"), F.count("hit").alias("hits")
    )
    return counts.withColumn("recall", F.round(F.col("hits") / F.greatest("true_neighbours", F.lit(1)), 4))


@query(f"WITH {_knn(50)} SELECT query_id, label, source, round(max(similarity), 6) AS similarity FROM knn GROUP BY query_id, label, source")
def evidence_dedupe(spark, folder):
    """The best similarity of each source per test chunk and class."""
    return voting.best_per_source(neighbours(spark, folder, 50), ["query_id"]).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_knn(50)}, best AS (SELECT query_id, label, source, max(similarity) AS similarity FROM knn GROUP BY ALL)
SELECT query_id, label, source, round(similarity, 6) AS similarity, rank FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, source) AS rank FROM best) WHERE rank <= 10""")
def evidence_top10_sources(spark, folder):
    """The ten best sources per test chunk and class."""
    return voting.top_sources(neighbours(spark, folder, 50), ["query_id"]).withColumn("similarity", F.round("similarity", 6))


def _scores(spark, folder, both: DataFrame | None = None) -> DataFrame:
    return voting.noisy_or(voting.top_sources(neighbours(spark, folder, 50, both), ["page", "query_id"]), "page")


@query(_VOTE + "SELECT page, label, source, round(score, 6) AS score FROM scores")
def noisy_or_scores(spark, folder):
    """The score of every page, class and source."""
    return _scores(spark, folder).withColumn("score", F.round("score", 6))


def _judged(spark, folder) -> DataFrame:
    both = vectors(spark, folder)
    pages = both.where("source_name = 'original_test'").groupBy(F.col("source_file").alias("page"))
    truth = pages.agg(F.max("label").alias("true_label"), F.count(F.lit(1)).alias("num_query_chunks"))
    return voting.page_votes(_scores(spark, folder, both), "page").join(truth, "page")


@query(_VOTE + """SELECT page, true_label, predicted_label, num_query_chunks, round(benign_score, 6) AS benign_score, round(phishing_score, 6) AS phishing_score,
phishing_probability, unique_benign_sources, unique_phishing_sources, tie FROM judged""")
def page_vote(spark, folder):
    """The vote on every test page; the flagship query."""
    rows = _judged(spark, folder).withColumns({c: F.round(c, 6) for c in ("benign_score", "phishing_score")})
    return rows.select(
        "page", "true_label", "predicted_label", "num_query_chunks", "benign_score", "phishing_score",
        "phishing_probability", "unique_benign_sources", "unique_phishing_sources", "tie",
    )


_CONFUSION = """c AS (SELECT count(*) AS total, count(predicted_label) AS valid,
  count(*) FILTER (true_label = 0 AND predicted_label = 0) AS tn, count(*) FILTER (true_label = 0 AND predicted_label = 1) AS fp,
  count(*) FILTER (true_label = 1 AND predicted_label = 0) AS fn, count(*) FILTER (true_label = 1 AND predicted_label = 1) AS tp,
  count(*) FILTER (true_label = 0) AS n0, count(*) FILTER (true_label = 1) AS n1 FROM judged)"""
_RATIOS = """, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS prec,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS rec, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS spec,
  CASE WHEN n0 > 0 THEN tn::DOUBLE / n0 ELSE 0 END AS r0, CASE WHEN n1 > 0 THEN tp::DOUBLE / n1 ELSE 0 END AS r1 FROM c)"""
_METRICS = f"""{_CONFUSION}{_RATIOS}
SELECT total AS num_pages, valid AS valid_predictions, total - valid AS invalid_predictions,
round(CASE WHEN total > 0 THEN valid::DOUBLE / total ELSE 0 END, 6) AS coverage, round(CASE WHEN total > 0 THEN (tn + tp)::DOUBLE / total ELSE 0 END, 6) AS accuracy,
round((r0 + r1) / 2, 6) AS balanced_accuracy, round(r0, 6) AS recall_benign_all, round(r1, 6) AS recall_phishing_all, round(prec, 6) AS precision_valid,
round(rec, 6) AS recall_valid, round(spec, 6) AS specificity_valid, round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 6) AS f1_valid,
tn, fp, fn, tp FROM r"""


@query(_VOTE + ", " + _METRICS)
def vote_metrics(spark, folder):
    """Metrics of the votes."""
    return metrics.classification(_judged(spark, folder), [])


@query(_VOTE + """, ranked AS (SELECT true_label AS y, rank() OVER (ORDER BY phishing_probability) + (count(*) OVER (PARTITION BY phishing_probability) - 1) / 2.0::DOUBLE AS r FROM judged)
SELECT CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) END AS roc_auc FROM ranked""")
def vote_auc(spark, folder):
    """Area under the ROC curve of the page probabilities."""
    return metrics.roc_auc(_judged(spark, folder), "true_label", "phishing_probability")


@query(_VOTE + """, per AS (SELECT y.y AS class, count(*) FILTER (true_label = y.y) AS support, count(*) FILTER (predicted_label = y.y) AS predicted,
  count(*) FILTER (true_label = y.y AND predicted_label = y.y) AS hit FROM judged, (VALUES (0), (1)) y(y) GROUP BY y.y),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hit::DOUBLE / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT CAST(class AS VARCHAR) AS row, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def vote_report(spark, folder):
    """Precision, recall, F1 and support per class and averaged."""
    return metrics.report(_judged(spark, folder), "true_label", "predicted_label", [0, 1])


# --- votes straight from the stored hits ---


def stored_hits(spark, folder) -> DataFrame:
    """Stored hits with a similarity: page, query, label, source, similarity cut to 0..1."""
    s = F.col("similarity")
    rows = table(spark, folder, "evidence_hits").where(s.isNotNull() & ~F.isnan(s))
    return rows.select(clean_id(F.col("page_id")).alias("page"), F.col("query_chunk_index").alias("query"), "label", F.col("train_source").alias("source"), voting.similarity(1 - s).alias("similarity"))


_HITS = """WITH hits AS (SELECT lower(trim(page_id)) AS page, query_chunk_index AS query, label, train_source AS source, max(least(1.0, greatest(0.0, similarity))) AS similarity
  FROM evidence_hits WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, query, label ORDER BY similarity DESC, source) AS rank FROM hits) WHERE rank <= 10),
scores AS (SELECT page, label, source, 1 - product(1 - similarity) AS score FROM top GROUP BY page, label, source),
sums AS (SELECT page, round(coalesce(sum(score) FILTER (label = 0), 0), 9) AS b, round(coalesce(sum(score) FILTER (label = 1), 0), 9) AS p,
  count(*) FILTER (label = 0) AS unique_benign_sources, count(*) FILTER (label = 1) AS unique_phishing_sources FROM scores GROUP BY page)"""


@query(_HITS + """SELECT page, CAST(p > b AS INTEGER) AS predicted_label, round(b, 6) AS benign_score, round(p, 6) AS phishing_score,
round(CASE WHEN p + b > 0 THEN p / (p + b) ELSE 0.5 END, 6) AS phishing_probability, unique_benign_sources, unique_phishing_sources,
abs(p - b) <= 1e-8 + 1e-5 * abs(b) AS tie FROM sums""")
def stored_page_vote(spark, folder):
    """The vote on every page by its stored hits."""
    scores = voting.noisy_or(voting.top_sources(stored_hits(spark, folder), ["page", "query"]), "page")
    return voting.page_votes(scores, "page").withColumns({c: F.round(c, 6) for c in ("benign_score", "phishing_score")})


def chunk_pairs(spark, folder) -> DataFrame:
    """Per page and query chunk: the best benign and phishing similarity and their importance, where both classes answered."""
    best = stored_hits(spark, folder).groupBy("page", F.col("query").alias("query_chunk_index")).agg(
        F.max(F.when(F.col("label") == 0, F.col("similarity"))).alias("benign"), F.max(F.when(F.col("label") == 1, F.col("similarity"))).alias("phishing")
    )
    both = best.where("benign IS NOT NULL AND phishing IS NOT NULL")
    return both.withColumn("importance", F.round(evidence.importance(F.col("benign"), F.col("phishing")), 9))


_PAIRS = """WITH best AS (SELECT lower(trim(page_id)) AS page, query_chunk_index, max(least(1.0, greatest(0.0, similarity))) FILTER (label = 0) AS benign,
  max(least(1.0, greatest(0.0, similarity))) FILTER (label = 1) AS phishing FROM evidence_hits WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY ALL),
pairs AS (SELECT *, round(greatest(benign, phishing) * abs(benign - phishing), 9) AS importance FROM best WHERE benign IS NOT NULL AND phishing IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY importance DESC, query_chunk_index) AS rank FROM pairs)"""


@query(_PAIRS + "SELECT page, query_chunk_index, round(importance, 6) AS importance FROM pairs")
def chunk_importance(spark, folder):
    """The importance of every query chunk."""
    return chunk_pairs(spark, folder).select("page", "query_chunk_index", F.round("importance", 6).alias("importance"))


@query(_PAIRS + "SELECT page, query_chunk_index, CASE WHEN phishing > benign THEN 'PHISHING' WHEN benign > phishing THEN 'BENIGN' ELSE 'TIE' END AS closer_to FROM pairs")
def closer_label(spark, folder):
    """The class each query chunk is closer to."""
    return chunk_pairs(spark, folder).select("page", "query_chunk_index", evidence.closer_class(F.col("benign"), F.col("phishing")).alias("closer_to"))


@query(_PAIRS + "SELECT page, query_chunk_index, round(importance, 6) AS importance, rank FROM ranked WHERE rank <= 8")
def top_n_evidence(spark, folder):
    """The eight most important chunks of each page."""
    return evidence.top_chunks(chunk_pairs(spark, folder), "page", 8).select("page", "query_chunk_index", F.round("importance", 6).alias("importance"), "rank")


@query(_PAIRS + "SELECT k AS top_k, page, query_chunk_index, rank FROM ranked, (VALUES (1), (2), (4), (8), (16)) t(k) WHERE rank <= k")
def k_sweep(spark, folder):
    """The chunks of every K: prefixes of one ranking."""
    ranked = evidence.top_chunks(chunk_pairs(spark, folder), "page", 16)
    return ranked.withColumn("top_k", F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16))))).where("rank <= top_k").select("top_k", "page", "query_chunk_index", "rank")


@query()
def evidence_nested(spark, folder):
    """One evidence document per page."""
    ranked = evidence.top_chunks(chunk_pairs(spark, folder), "page", 8)
    return evidence.nested(ranked, "page", ["query_chunk_index", "importance", "benign", "phishing"])


@query(_PAIRS + """SELECT page, count(*) OVER (PARTITION BY page) AS num_selected_chunks, rank, query_chunk_index, round(importance, 6) AS importance, round(benign, 6) AS benign, round(phishing, 6) AS phishing
FROM ranked WHERE rank <= 8""")
def evidence_nested_rows(spark, folder):
    """The evidence documents taken apart again, place by place."""
    chunk = F.posexplode("selected_chunks").alias("at", "c")
    flat = evidence_nested(spark, folder).select("page", "num_selected_chunks", chunk)
    return flat.where("c.rank = at + 1").select("page", "num_selected_chunks", "c.rank", "c.query_chunk_index", *[F.round(f"c.{c}", 6).alias(c) for c in ("importance", "benign", "phishing")])


@query("SELECT lower(trim(page_id)) AS page, count(DISTINCT query_chunk_index) AS num_page_chunks FROM evidence_hits GROUP BY 1")
def page_run_counts(spark, folder):
    """Query chunks per page."""
    rows = table(spark, folder, "evidence_hits").select(clean_id(F.col("page_id")).alias("page"), "query_chunk_index")
    return rows.distinct().groupBy("page").agg(F.count(F.lit(1)).alias("num_page_chunks"))


@query("""WITH p AS (SELECT DISTINCT lower(trim(page_id)) AS page FROM page_evidence), n AS (SELECT page, row_number() OVER (ORDER BY page) AS r FROM p)
SELECT page, CAST((r - 1) // 250 AS INTEGER) AS shard FROM n""")
def shard_assignment(spark, folder):
    """The shard of every evidence page, 250 to a shard."""
    pages = table(spark, folder, "page_evidence").select(clean_id(F.col("page_id")).alias("page")).distinct()
    return rank_in_groups(pages, [], [F.asc("page")]).select("page", evidence.shard_number(F.col("rank"), 250).alias("shard"))


@query("""SELECT source_name, CAST(ceil(n * p / 100.0::DOUBLE) AS BIGINT) AS milestone FROM (SELECT source_name, count(*) AS n FROM chunk_vectors GROUP BY 1), (VALUES (20), (40), (60), (80), (100)) t(p)""")
def checkpoint_milestones(spark, folder):
    """Row counts at which a run over each source would save its state."""
    rows = table(spark, folder, "chunk_vectors").groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("source_name", F.explode(evidence.milestones(F.col("n"), [20, 40, 60, 80, 100])).alias("milestone"))

