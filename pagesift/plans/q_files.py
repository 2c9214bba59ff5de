"""Queries through file formats and streams; results equal those over the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagesift.functions.ids import clean_id
from pagesift.operators.ranking import rank_in_groups
from pagesift.plans.stages import shared_folder, stage
from pagesift.sources import files, sinks
from pagesift.sources.tables import table
from pagesift.streaming.incremental import incremental_best, incremental_chunks, stream_of

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT top_k, count(*) AS rows, count(predicted_label) AS labelled, CAST(sum(prompt_tokens) AS BIGINT) AS tokens FROM prediction GROUP BY top_k")
def jsonl_shards(spark, folder):
    """Predictions through gzip JSON shards of 250 rows."""
    rows, path = table(spark, folder, "prediction").select("page_id", "top_k", "predicted_label", "prompt_tokens"), _place(spark, "shards")
    sinks.write_shards(rows, path)
    back = files.read_jsonl(spark, path, rows.schema)
    return back.groupBy("top_k").agg(F.count(F.lit(1)).alias("rows"), F.count("predicted_label").alias("labelled"), F.sum("prompt_tokens").alias("tokens"))


@query("SELECT filename, label, url FROM test_1000_balanced_seed42 WHERE filename IS NOT NULL")
def csv_split_table(spark, folder):
    """Listed pages through CSV."""
    rows = table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL").select("filename", "label", "url")
    path = _place(spark, "csv")
    sinks.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.txt' AS filename, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND text <> ''")
def zip_page_scan(spark, folder):
    """Texts through ZIP archives, by their hash."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL AND text <> ''")
    pages = docs.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt")).alias("filename"), F.col("text").alias("html"))
    path = _place(spark, "zip")
    sinks.write_zip_parts(pages, path)
    return files.read_zip_pages(spark, path).select("filename", F.sha2("html", 256).alias("content_hash"))


@query("""SELECT id, label, source_name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS r FROM chunk_vectors) WHERE r = 1""")
def collection_upsert(spark, folder):
    """Two loads merged into a versioned collection, partitioned by class."""
    rows = table(spark, folder, "chunk_vectors").select("id", "label", "source_name", "loaded_at")
    path = _place(spark, "collection")
    middle = rows.agg(F.percentile_approx(F.unix_micros("loaded_at"), 0.5)).first()[0] or 0
    early = F.unix_micros("loaded_at") <= middle
    sinks.upsert(spark, path, rows.where(early), "id", "loaded_at", "label")
    sinks.upsert(spark, path, rows.where(~early), "id", "loaded_at", "label")
    return sinks.open_collection(spark, path).select("id", "label", "source_name")


@query("""SELECT lower(trim(page_id)) AS page, label, round(max(similarity), 6) AS best, count(*) AS hits FROM evidence_hits
WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY 1, 2""")
def incremental_scoring(spark, folder):
    """The best hit of every page and class, over the stored hits as a stream."""
    schema = table(spark, folder, "evidence_hits").schema
    hits = stream_of(spark, f"{folder.rstrip('/')}/evidence_hits.parquet", schema).where("similarity IS NOT NULL AND NOT isnan(similarity)")
    rows = hits.select(clean_id(F.col("page_id")).alias("page"), "label", "similarity")
    return incremental_best(spark, rows).withColumn("best", F.round("best", 6))


@query("SELECT top_k, count(*) AS rows, count(DISTINCT page_id) AS pages FROM prediction GROUP BY top_k")
def jsonl_appended(spark, folder):
    """Predictions appended to gzip JSON lines in two steps."""
    rows, path = table(spark, folder, "prediction").select("page_id", "top_k"), _place(spark, "appended")
    for half in (0, 1):
        sinks.append_jsonl(rows.where(F.pmod(F.xxhash64("page_id"), F.lit(2)) == half), path)
    back = files.read_jsonl(spark, path, rows.schema)
    return back.groupBy("top_k").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("page_id").alias("pages"))


#: The row that the second half of a broken-off run over the vectors goes on from.
RESUMED_ROW = 100


@query(f"""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM
(SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings) WHERE row >= {RESUMED_ROW}""")
def matrix_rows_resumed(spark, folder):
    """Vectors through a matrix of blocks, joined to their ids by row, from the row on where a run broke off."""
    numbered = rank_in_groups(table(spark, folder, "embeddings").select("vec_id", "embedding"), [], [F.asc("vec_id")], "at")
    numbered = stage(numbered.select((F.col("at") - 1).alias("row"), "vec_id", F.col("embedding").alias("vector")), "numbered")
    path = _place(spark, "matrix")
    sinks.write_matrix(numbered.select("row", "vector"), path, 64, block=512)
    whole = files.join_by_row(numbered.select("row", "vec_id"), files.read_matrix(spark, path))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return files.from_row(whole, "row", RESUMED_ROW).select("vec_id", F.round(total, 4).alias("total"))


@query("SELECT top_k, num_pages, accuracy, precision_phishing AS precision, tn, fp, fn, tp FROM topk_metrics")
def published_metrics_files(spark, folder):
    """Published metrics through nested JSON objects, one file a run, flattened again."""
    path = _place(spark, "metrics")
    for i, r in enumerate(table(spark, folder, "topk_metrics").collect()):  # a row per run
        nested = {"precision": r["precision_phishing"], "confusion_matrix": {k: r[k] for k in ("tn", "fp", "fn", "tp")}}
        sinks.write_json(spark, {"top_k": r["top_k"], "num_pages": r["num_pages"], "accuracy": r["accuracy"], "valid_only": nested}, f"{path}/run-{i}.json")
    flat = files.flat_metrics(files.read_json_object(spark, path))
    return flat.select(*[F.col(c).cast("int") for c in ("top_k", "num_pages")], "accuracy", "precision", *[F.col(c).cast("int") for c in ("tn", "fp", "fn", "tp")])


@query("SELECT page_id, top_k, count(*) AS rows FROM prediction GROUP BY ALL")
def resumed_job(spark, folder):
    """Predictions counted by a job that is asked for twice: the second time its stored result is taken, as the signatures agree."""
    path = _place(spark, "job")
    counts = table(spark, folder, "prediction").groupBy("page_id", "top_k").agg(F.count(F.lit(1)).alias("rows"))
    signature = {"job": "count", "by": ["page_id", "top_k"]}
    sinks.resume_or_build(spark, path, signature, lambda: counts)
    return sinks.resume_or_build(spark, path, signature, lambda: counts.where("false"))


@query()
def incremental_chunking(spark, folder):
    """Chunks of all texts, over the documents as a stream."""
    schema = table(spark, folder, "documents").schema
    docs = stream_of(spark, f"{folder.rstrip('/')}/documents.parquet", schema)
    return incremental_chunks(spark, docs.select(F.col("doc_id").cast("string").alias("source_file"), F.col("text").alias("html")))
