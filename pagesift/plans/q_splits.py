"""Queries on listed pages: labels, samples, splits, checks and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.ids import chunk_id, clean_id, page_id, page_number
from pagesift.operators import checks, sampling
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


_STEM = r"regexp_replace(regexp_replace(filename, '^.*[/\\]', ''), '\.[^.]*$', '')"
_PAGE = f"TRY_CAST(nullif(regexp_replace({_STEM}, '[^0-9]', '', 'g'), '') AS BIGINT)"
#: distinct listed pages with a usable label
_LISTED = f"""listed AS (
  SELECT {_PAGE} AS page, min(label) AS label FROM test_1000_balanced_seed42
  WHERE filename IS NOT NULL AND label IN (0, 1) GROUP BY 1 HAVING min(label) = max(label))"""


def listed(spark, folder) -> DataFrame:
    """Page numbers that are listed under one label of 0 and 1."""
    rows = table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL AND label IN (0, 1)")
    pages = rows.select(page_number(F.col("filename")).alias("page"), "label").groupBy("page")
    return pages.agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")


@query("SELECT doc_id, filename, CAST(source = 'verified_online' AS INTEGER) AS derived_label FROM documents WHERE source IS NOT NULL")
def label_derivation(spark, folder):
    """A page's class follows from where its url came from."""
    docs = table(spark, folder, "documents").where("source IS NOT NULL")
    return docs.select("doc_id", "filename", (F.col("source") == "verified_online").cast("int").alias("derived_label"))


@query(r"""SELECT filename, regexp_extract(filename, '([^/\\]*)\.[^.]*$', 1) AS stem FROM test_1000_balanced_seed42
WHERE filename IS NOT NULL AND NOT regexp_matches(filename, '[/\\]$') AND NOT regexp_matches(filename, '(^|[/\\])__MACOSX([/\\]|$)')
AND NOT regexp_matches(filename, '(^|[/\\])\._[^/\\]*$') AND regexp_matches(lower(filename), '(^|[/\\])[0-9]+\.(html|htm|txt)$')""")
def archive_filter(spark, folder):
    """Entries that are pages: no folder, no system part, a page suffix, a stem of digits."""
    name = F.col("filename")
    rows = table(spark, folder, "test_1000_balanced_seed42").where(
        name.isNotNull()
        & ~name.rlike(r"[/\\]$")
        & ~name.rlike(r"(^|[/\\])__MACOSX([/\\]|$)")
        & ~name.rlike(r"(^|[/\\])\._[^/\\]*$")
        & F.lower(name).rlike(r"(^|[/\\])[0-9]+\.(html|htm|txt)$")
    )
    return rows.select("filename", F.regexp_extract("filename", r"([^/\\]*)\.[^.]*$", 1).alias("stem"))


@query(f"""SELECT t.filename, {_PAGE.replace("filename", "t.filename")} AS row_no, d.source FROM test_1000_balanced_seed42 t
JOIN documents d ON d.doc_id = {_PAGE.replace("filename", "t.filename")} WHERE t.filename IS NOT NULL""")
def archive_source_join(spark, folder):
    """An archive file's stem is the row of its source: join by number."""
    files = table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL")
    files = files.select("filename", page_number(F.col("filename")).alias("row_no"))
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("row_no"), "source")
    return files.join(rows, "row_no").select("filename", "row_no", "source")


@query(f"""WITH {_LISTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '42', page)), page) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM listed)
SELECT page, label, CASE WHEN r <= CAST(round(n * 0.2::DOUBLE) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM ranked""")
def stratified_split(spark, folder):
    """A fifth of each class for testing."""
    return sampling.stratified_split(listed(spark, folder), "label", "page", 0.2)


@query(f"""WITH {_LISTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '42', page)), page) AS r FROM listed)
SELECT page, label, CASE WHEN r <= 200 THEN 'train' ELSE 'test' END AS split FROM ranked WHERE r <= 250""")
def fixed_count_split(spark, folder):
    """200 training and 50 test pages of each class."""
    return sampling.fixed_count_split(listed(spark, folder), "label", "page", 200, 50)


@query(f"""WITH {_LISTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '42', page)), page) AS r FROM listed)
SELECT page, label FROM ranked WHERE r <= 100""")
def balanced_sample(spark, folder):
    """100 pages of each class."""
    return sampling.balanced_sample(listed(spark, folder), "label", "page", 100)


@query(f"""WITH {_LISTED} SELECT page, label, row_number() OVER (ORDER BY md5(concat_ws(':', '42', page)), page) - 1 AS position FROM listed""")
def seeded_shuffle(spark, folder):
    """All pages in a seeded order."""
    return sampling.seeded_shuffle(listed(spark, folder), "page")


@query(f"""WITH {_LISTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '42', page)), page) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM listed),
s AS (SELECT label, CASE WHEN r <= CAST(round(n * 0.2::DOUBLE) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM ranked)
SELECT split, count(*) AS pages, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM s GROUP BY split""")
def split_stats(spark, folder):
    """Pages of each class per split."""
    split = sampling.stratified_split(listed(spark, folder), "label", "page", 0.2)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1")
    )


@query("SELECT label, count(*) AS rows FROM test_1000_balanced_seed42 WHERE label IS NULL OR label NOT IN (0, 1) GROUP BY label")
def label_domain_check(spark, folder):
    """Labels other than 0 and 1."""
    return checks.outside_domain(table(spark, folder, "test_1000_balanced_seed42"), "label", [0, 1])


@query(f"""SELECT {_PAGE} AS page, min(label) AS lowest, max(label) AS highest FROM test_1000_balanced_seed42 WHERE filename IS NOT NULL
GROUP BY 1 HAVING min(label) <> max(label)""")
def label_consistency_check(spark, folder):
    """Pages listed under several labels."""
    rows = table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL")
    return checks.inconsistent(rows.select(page_number(F.col("filename")).alias("page"), "label"), "page", "label")


@query("SELECT lower(trim(lang)) AS lang, count(*) AS rows FROM test_1000_balanced_seed42 GROUP BY 1 HAVING count(*) < 100")
def min_population_check(spark, folder):
    """Languages with fewer than 100 rows."""
    rows = table(spark, folder, "test_1000_balanced_seed42").select(clean_id(F.col("lang")).alias("lang"))
    return checks.too_few(rows, "lang", 100)


@query("SELECT filename, count(*) AS rows FROM test_1000_balanced_seed42 WHERE filename IS NOT NULL GROUP BY filename HAVING count(*) > 1")
def duplicate_check(spark, folder):
    """File names listed more than once."""
    return checks.duplicates(table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL"), ["filename"])


@query("""SELECT source_name, count(*) AS chunks, count(embedding) AS vectors, count(*) - count(embedding) AS missing
FROM chunk_vectors GROUP BY source_name""")
def row_alignment_check(spark, folder):
    """Chunk rows and vectors per run; they should be as many."""
    rows = table(spark, folder, "chunk_vectors").groupBy("source_name")
    return rows.agg(
        F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("vectors"), (F.count(F.lit(1)) - F.count("embedding")).alias("missing")
    )


@query("SELECT DISTINCT filename, substr(sha1(filename), 1, 16) AS page_id FROM test_1000_balanced_seed42 WHERE filename IS NOT NULL")
def page_identity(spark, folder):
    """The id of every listed file name."""
    rows = table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL")
    return rows.select("filename", page_id(F.col("filename")).alias("page_id")).distinct()


@query("""SELECT id, source_file, chunk_index, substr(sha1(source_file), 1, 16) || '_' || chunk_index AS chunk_id,
substr(sha1(source_file), 1, 16) || '_' || chunk_index = id AS same FROM chunk_vectors""")
def chunk_identity(spark, folder):
    """The id of every chunk, held against the stored one."""
    made = chunk_id(F.col("source_file"), F.col("chunk_index"))
    rows = table(spark, folder, "chunk_vectors").select("id", "source_file", "chunk_index", made.alias("chunk_id"))
    return rows.withColumn("same", F.col("chunk_id") == F.col("id"))


@query(f"SELECT DISTINCT page, lpad(CAST(page AS VARCHAR), 6, '0') || '.txt' AS name FROM (SELECT {_PAGE} AS page FROM test_1000_balanced_seed42 WHERE filename IS NOT NULL)")
def padded_names(spark, folder):
    """Archive names of page numbers, padded to six digits."""
    pages = table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL").select(page_number(F.col("filename")).alias("page")).distinct()
    return pages.select("page", F.concat(F.lpad(F.col("page").cast("string"), 6, "0"), F.lit(".txt")).alias("name"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_signature(spark, folder):
    """SHA-256 of every text."""
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""SELECT h.hit_id, h.label AS searched, t.label AS page_label FROM evidence_hits h
JOIN (SELECT source_file, min(label) AS label FROM chunk_vectors GROUP BY source_file) t ON t.source_file = h.train_source""")
def page_label_join(spark, folder):
    """Hits with the label that the chunk table has for the page they came from."""
    pages = table(spark, folder, "chunk_vectors").groupBy("source_file").agg(F.min("label").alias("page_label"))
    hits = table(spark, folder, "evidence_hits").select("hit_id", F.col("label").alias("searched"), F.col("train_source").alias("source_file"))
    return hits.join(pages, "source_file").select("hit_id", "searched", "page_label")


@query("""SELECT e.page_id, count(*) AS hits FROM (SELECT lower(trim(page_id)) AS page_id FROM evidence_hits) e
WHERE e.page_id IN (SELECT lower(trim(page_id)) FROM prediction WHERE top_k = 4) GROUP BY e.page_id""")
def sample_semi_join(spark, folder):
    """Hits of the pages of one run, counted per page."""
    pages = table(spark, folder, "prediction").where("top_k = 4").select(clean_id(F.col("page_id")).alias("page_id"))
    hits = table(spark, folder, "evidence_hits").select(clean_id(F.col("page_id")).alias("page_id"))
    # counting first leaves one row of a hot page to be joined
    return hits.groupBy("page_id").agg(F.count(F.lit(1)).alias("hits")).join(pages, "page_id", "left_semi")


_IDS = "SELECT substr(sha1(filename), 1, 16) AS page_id FROM test_1000_balanced_seed42 WHERE filename IS NOT NULL"


@query(f"SELECT DISTINCT page_id FROM ({_IDS}) WHERE page_id NOT IN (SELECT lower(trim(page_id)) FROM prediction)")
def missing_pages_anti(spark, folder):
    """Listed pages without any prediction."""
    ids = page_identity(spark, folder)
    return checks.missing(ids, table(spark, folder, "prediction").select(clean_id(F.col("page_id")).alias("page_id")), "page_id")


@query(f"""WITH a AS ({_IDS}), b AS (SELECT lower(trim(page_id)) AS page_id FROM prediction)
SELECT page_id, 'left' AS side FROM (SELECT page_id FROM a EXCEPT SELECT page_id FROM b)
UNION ALL SELECT page_id, 'right' AS side FROM (SELECT page_id FROM b EXCEPT SELECT page_id FROM a)""")
def page_set_equality(spark, folder):
    """Page ids that only the list or only the predictions have."""
    ids = page_identity(spark, folder)
    return checks.key_differences(ids, table(spark, folder, "prediction").select(clean_id(F.col("page_id")).alias("page_id")), "page_id")


@query(f"""WITH {_LISTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '42', page)), page) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM listed),
s AS (SELECT page, CASE WHEN r <= CAST(round(n * 0.2::DOUBLE) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM ranked)
SELECT h.split, count(*) AS rows FROM (SELECT {_PAGE} AS page FROM test_1000_balanced_seed42 WHERE filename IS NOT NULL) t JOIN s h USING (page) GROUP BY h.split""")
def split_assignment_join(spark, folder):
    """Listed rows routed to the splits of their pages, counted."""
    split = sampling.stratified_split(listed(spark, folder), "label", "page", 0.2)
    rows = table(spark, folder, "test_1000_balanced_seed42").where("filename IS NOT NULL").select(page_number(F.col("filename")).alias("page"))
    return rows.join(split, "page").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT 'original_train' AS part, id, source_file FROM chunk_vectors WHERE source_name = 'original_train'
UNION ALL SELECT 'original_test' AS part, id, source_file FROM chunk_vectors WHERE source_name = 'original_test'""")
def union_parts(spark, folder):
    """The parts of two runs, one after the other."""
    rows = table(spark, folder, "chunk_vectors")
    parts = [rows.where(F.col("source_name") == p).select(F.lit(p).alias("part"), "id", "source_file") for p in ("original_train", "original_test")]
    return parts[0].unionByName(parts[1])


@query("SELECT DISTINCT top_k FROM topk_metrics")
def distinct_k(spark, folder):
    """The values of K that were run."""
    return table(spark, folder, "topk_metrics").select("top_k").distinct()


@query("""SELECT source_name, count(DISTINCT source_file) AS pages, count(*) AS chunks FROM chunk_vectors GROUP BY source_name""")
def distinct_pages(spark, folder):
    """Pages and chunks per run."""
    return table(spark, folder, "chunk_vectors").groupBy("source_name").agg(F.countDistinct("source_file").alias("pages"), F.count(F.lit(1)).alias("chunks"))
