"""Queries on texts: lengths, markup, chunks, prompts, batches, fetch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.dom import ABLATIONS, LIMIT, Chunker, chunk_counts, chunk_pages, strip_markup
from pagesift.functions.fetch import authority, fetch_status
from pagesift.functions.formats import bytes_text, duration_text
from pagesift.functions.ids import clean_id
from pagesift.functions.tokens import PATTERN, token_length, word_length
from pagesift.operators import batching, metrics, prompts, sampling
from pagesift.operators.ranking import first_in_groups, rank_in_groups
from pagesift.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
QUANTILES = [0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tokens(column: str, special: int = 2) -> str:
    return f"(len(regexp_extract_all({column}, '({PATTERN})', 1)) + {special})"


_LENGTHS = f"lengths AS (SELECT doc_id, {_tokens('text')} AS tokens, len(regexp_extract_all(text, '(\\S+)', 1)) AS words FROM documents WHERE text IS NOT NULL)"


def lengths(spark, folder) -> DataFrame:
    """Tokens and words of every text."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", token_length(F.col("text")).alias("tokens"), word_length(F.col("text")).alias("words"))


_Q = ", ".join(f"round(quantile_cont(tokens, {q}), 6) AS p{str(q * 100).rstrip('0').rstrip('.').replace('.', '_')}" for q in QUANTILES)


@query(f"WITH {_LENGTHS} SELECT count(*) AS count, round(avg(tokens), 6) AS mean, min(tokens) AS min, {_Q}, max(tokens) AS max FROM lengths")
def token_length_summary(spark, folder):
    """Distribution of token lengths."""
    return metrics.distribution(lengths(spark, folder), "tokens", QUANTILES)


@query(f"""WITH {_LENGTHS} SELECT count(*) FILTER (tokens <= 512) AS within_512, round(100.0 * count(*) FILTER (tokens <= 512) / count(*), 6) AS within_percent,
count(*) FILTER (tokens > 512) AS over_512, round(100.0 * count(*) FILTER (tokens > 512) / count(*), 6) AS over_percent,
count(*) FILTER (tokens > 600) AS over_600, count(*) FILTER (tokens > 768) AS over_768, count(*) FILTER (tokens > 1024) AS over_1024 FROM lengths""")
def token_threshold_counts(spark, folder):
    """Texts within and over the limits."""
    t, n = F.col("tokens"), F.count(F.lit(1))
    over = {k: F.count_if(t > k) for k in (512, 600, 768, 1024)}
    return lengths(spark, folder).agg(
        F.count_if(t <= 512).alias("within_512"),
        F.round(100.0 * F.count_if(t <= 512) / n, 6).alias("within_percent"),
        over[512].alias("over_512"),
        F.round(100.0 * over[512] / n, 6).alias("over_percent"),
        *[over[k].alias(f"over_{k}") for k in (600, 768, 1024)],
    )


@query(f"""WITH {_LENGTHS}, r AS (SELECT tokens::DOUBLE / greatest(words, 1) AS ratio FROM lengths)
SELECT count(*) AS count, round(avg(ratio), 6) AS mean, round(min(ratio), 6) AS min, round(quantile_cont(ratio, 0.5), 6) AS p50, round(quantile_cont(ratio, 0.9), 6) AS p90,
round(quantile_cont(ratio, 0.95), 6) AS p95, round(quantile_cont(ratio, 0.99), 6) AS p99, round(max(ratio), 6) AS max FROM r""")
def token_ratio_summary(spark, folder):
    """Tokens per word."""
    ratio = lengths(spark, folder).select((F.col("tokens") / F.greatest("words", F.lit(1))).alias("ratio"))
    return metrics.distribution(ratio, "ratio", [0.5, 0.9, 0.95, 0.99]).withColumns({c: F.round(c, 6) for c in ("min", "max")})


@query(f"WITH {_LENGTHS} SELECT doc_id, tokens FROM lengths ORDER BY tokens DESC, doc_id DESC LIMIT 10")
def top_longest(spark, folder):
    """The ten longest texts."""
    return lengths(spark, folder).select("doc_id", "tokens").orderBy(F.desc("tokens"), F.desc("doc_id")).limit(10)


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
'(?is)<svg\b[^>]*>.*?</svg\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g') AS html FROM documents WHERE text IS NOT NULL""")
def html_preprocess(spark, folder):
    """Texts without scripts, styles, drawings, comments and doctype."""
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", strip_markup(F.col("text")).alias("html"))


def _pages(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("source_file"), F.col("text").alias("html"))


@query()
def dom_chunks(spark, folder):
    """Chunks of every text of at most 512 tokens, by its structure."""
    return chunk_pages(_pages(spark, folder))


@query()
def tag_ablation_chunks(spark, folder):
    """The chunks when links are removed."""
    return chunk_pages(_pages(spark, folder), ablate="a")


@query()
def ablation_chunk_counts(spark, folder):
    """Chunks and tokens without each of five tags, and with all, in one pass over the texts."""
    counts = chunk_counts(_pages(spark, folder), (None, *ABLATIONS))
    removed = F.coalesce("removed", F.lit("none")).alias("removed")
    return counts.groupBy(removed).agg(F.sum("chunks").alias("chunks"), F.count_if(F.col("chunks") > 0).alias("pages"), F.sum("tokens").alias("tokens"))


# a fold over the sentences: (chunks done, text of the open one); its tokens are counted again with each sentence
@query(rf"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, s, 1 AS i, 0 AS chunk_index, s[1] AS open, CAST(NULL AS VARCHAR) AS chunk FROM s WHERE len(s) > 0
UNION ALL SELECT doc_id, s, i + 1, CASE WHEN fits THEN chunk_index ELSE chunk_index + 1 END, CASE WHEN fits THEN open || s[i + 1] ELSE s[i + 1] END, CASE WHEN fits THEN NULL ELSE open END
FROM (SELECT *, i < len(s) AND {_tokens("(open || s[i + 1])")} <= 64 AS fits FROM m WHERE i <= len(s)))
SELECT doc_id, CAST(chunk_index - 1 AS INTEGER) AS chunk_index, chunk FROM m WHERE chunk IS NOT NULL""")
def greedy_merge(spark, folder):
    """Sentences of a text merged into chunks of at most 64 tokens."""

    @F.pandas_udf("array<string>")
    def merged(texts):
        chunker = Chunker(64)
        import pandas as pd

        return pd.Series([[c for c, _ in chunker.merge([chunker._sized(s) for s in t.split(". ") if s])] for t in texts])

    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(merged("text")).alias("chunk_index", "chunk"))


# --- prompts ---


def groups(spark, folder) -> DataFrame:
    """Evidence groups once each, ranked within their page."""
    rows = table(spark, folder, "page_evidence").select(clean_id(F.col("page_id")).alias("page"), "page_url", F.explode("selected_chunks").alias("g"))
    flat = rows.select(
        "page", "page_url", F.col("g.group_id").alias("group_id"), F.col("g.query_chunk_index").alias("query_chunk_index"), F.col("g.importance").alias("importance"),
        F.col("g.query_chunk").alias("query"), F.col("g.benign_example.chunk").alias("benign"), F.col("g.benign_example.similarity").alias("benign_s"),
        F.col("g.phishing_example.chunk").alias("phishing"), F.col("g.phishing_example.similarity").alias("phishing_s"),
    )
    once = flat.dropDuplicates(["page", "group_id"])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("importance"), "query_chunk_index", "group_id")))


_GROUPS = """flat AS (SELECT DISTINCT ON (page, group_id) * FROM (SELECT lower(trim(page_id)) AS page, page_url, g.group_id AS group_id, g.query_chunk_index AS query_chunk_index, g.importance AS importance,
  g.query_chunk AS query, g.benign_example.chunk AS benign, g.benign_example.similarity AS benign_s, g.phishing_example.chunk AS phishing, g.phishing_example.similarity AS phishing_s
  FROM (SELECT page_id, page_url, unnest(selected_chunks) AS g FROM page_evidence))),
groups AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY importance DESC, query_chunk_index, group_id) AS rank FROM flat)"""


def _block_sql(arm: str) -> str:
    examples, scores, direction, own = prompts.ARMS[arm]
    parts = ["'## Evidence ' || rank || chr(10)"]
    if own:
        parts.append("'Chunk of the page:' || chr(10) || coalesce(query, '') || chr(10)")
    if direction:
        parts.append("'Closer to: ' || CASE WHEN phishing_s > benign_s THEN 'PHISHING' WHEN benign_s > phishing_s THEN 'BENIGN' ELSE 'TIE' END || chr(10)")
    if examples:
        for name in ("benign", "phishing"):
            shown = f"' (similarity ' || coalesce(printf('%.6f', {name}_s), 'unknown') || ')'" if scores else "''"
            parts.append(f"'Known {name.upper()} chunk' || {shown} || ':' || chr(10) || coalesce({name}, '') || chr(10)")
    return " || ".join(parts)


def _block(arm: str):
    c = F.col
    return prompts.block(c("rank"), c("query"), c("benign"), c("benign_s"), c("phishing"), c("phishing_s"), arm)


@query(f"WITH {_GROUPS} SELECT page, rank, {_block_sql('full')} AS block FROM groups")
def prompt_blocks(spark, folder):
    """The text of every evidence group."""
    return groups(spark, folder).select("page", "rank", _block("full").alias("block"))


@query(f"WITH {_GROUPS} " + " UNION ALL ".join(f"SELECT page, rank, '{arm}' AS arm, md5({_block_sql(arm)}) AS digest FROM groups WHERE rank <= 4" for arm in prompts.ARMS))
def prompt_variants(spark, folder):
    """The blocks of the first four groups in each of six arms, as digests."""
    rows = groups(spark, folder).where("rank <= 4")
    arms = F.array(*[F.struct(F.lit(arm).alias("arm"), F.md5(_block(arm).cast("binary")).alias("digest")) for arm in prompts.ARMS])
    return rows.select("page", "rank", F.inline(arms))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


PROMPT_LIMIT = 1024
_TURNS = prompts.Turns()
_URL = "coalesce('Address: ' || max(page_url) OVER (PARTITION BY page) || chr(10), '')"
_BUDGET = f"""blocks AS (SELECT page, page_url, rank, {_block_sql("closer_only")} AS block, benign_s, phishing_s FROM groups),
prefixes AS (SELECT *, {_sql_text(_TURNS.open() + prompts.HEAD)} || {_URL} || string_agg(block, '') OVER (PARTITION BY page ORDER BY rank) || {_sql_text(prompts.TAIL + _TURNS.close())} AS prompt FROM blocks),
sized AS (SELECT *, {_tokens("prompt", 0)} AS n FROM prefixes),
used AS (SELECT page, count(*) AS num_groups_available, coalesce(max(rank) FILTER (n <= {PROMPT_LIMIT}), 0) AS num_groups_used FROM sized GROUP BY page),
kept AS (SELECT s.* FROM sized s JOIN used u ON s.page = u.page AND s.rank <= u.num_groups_used)"""


def made_prompts(spark, folder) -> DataFrame:
    """Prompts of the arm closer_only with the page's url, within 1,024 tokens."""
    blocks = groups(spark, folder).select("page", "page_url", "rank", _block("closer_only").alias("block"))
    return prompts.assemble(blocks, "page", PROMPT_LIMIT, F.col("page_url"))


@query(f"WITH {_GROUPS}, {_BUDGET} SELECT page, num_groups_available, num_groups_used FROM used")
def prompt_budget(spark, folder):
    """Groups available and used per page; none used means that not even the first fits."""
    return made_prompts(spark, folder).select("page", "num_groups_available", "num_groups_used")


@query(f"""WITH {_GROUPS}, {_BUDGET} SELECT u.page, md5(s.prompt) AS digest, u.num_groups_used, s.n AS prompt_tokens
FROM used u LEFT JOIN sized s ON s.page = u.page AND s.rank = u.num_groups_used""")
def prompt_assembly(spark, folder):
    """Whole prompts, as digests."""
    return made_prompts(spark, folder).select("page", F.md5(F.col("prompt").cast("binary")).alias("digest"), "num_groups_used", "prompt_tokens")


@query(f"""WITH {_GROUPS}, {_BUDGET}, v AS (SELECT u.page, u.num_groups_used > 0 AS asked, count(k.page) FILTER (phishing_s > benign_s) AS a, count(k.page) FILTER (benign_s > phishing_s) AS b
FROM used u LEFT JOIN kept k USING (page) GROUP BY ALL)
SELECT page, CASE WHEN asked THEN CASE WHEN a > b THEN 'PHISHING' WHEN b > a THEN 'BENIGN' ELSE 'BENIGN or PHISHING' END END AS model_output, CASE WHEN asked AND a = b THEN 'BENIGN' END AS retry_output,
CASE WHEN asked THEN CAST(CASE WHEN a > b THEN 1 ELSE 0 END AS INTEGER) END AS predicted_label FROM v""")
def classify_pages(spark, folder):
    """Answers of a stand-in classifier to the prompts, with a retry of unreadable ones."""
    return prompts.answer_with_retry(made_prompts(spark, folder), prompts.count_classifier).select("page", "model_output", "retry_output", "predicted_label")


# --- batches ---


@query(f"""WITH {_LENGTHS}, r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 512 AS bucket FROM lengths),
b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY tokens, doc_id) - 1 AS pos FROM r)
SELECT doc_id, tokens, bucket, pos // 64 AS batch, pos % 64 AS place FROM b""")
def length_bucket_batches(spark, folder):
    """Texts in batches of 64 of similar length, within buckets of 512."""
    return batching.length_buckets(lengths(spark, folder).select("doc_id", "tokens"), "doc_id", "tokens", 512, 64)


@query(f"""WITH {_LENGTHS}, r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 512 AS bucket FROM lengths),
b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY tokens, doc_id) - 1 AS pos FROM r)
SELECT doc_id, bucket, pos // 64 AS batch, pos % 64 AS place FROM b WHERE bucket * 512 + pos >= 300""")
def batches_after_skip(spark, folder):
    """The batches that a run sees that had taken 300 rows."""
    batches = batching.length_buckets(lengths(spark, folder).select("doc_id", "tokens"), "doc_id", "tokens", 512, 64)
    return batching.skip_batches(batches, 300, 64, 512).select("doc_id", "bucket", "batch", "place")


@query("SELECT doc_id, source FROM documents")
def bounded_shuffle_rows(spark, folder):
    """All rows in an order shuffled within partitions: none lost, none doubled."""
    return sampling.bounded_shuffle(table(spark, folder, "documents").select("doc_id", "source"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) WHEN n_chars < 1048576 THEN printf('%.2f KiB', n_chars / 1024.0) ELSE printf('%.2f MiB', n_chars / 1048576.0) END AS size,
printf('%d:%02d:%02d', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) AS lasting FROM documents WHERE n_chars IS NOT NULL AND n_chars >= 0""")
def size_texts(spark, folder):
    """Lengths written as sizes and, taken as seconds, as durations."""
    docs = table(spark, folder, "documents").where("n_chars IS NOT NULL AND n_chars >= 0")
    return docs.select("doc_id", bytes_text(F.col("n_chars")).alias("size"), duration_text(F.col("n_chars")).alias("lasting"))


# --- chunks against SQL: what the structure doesn't decide ---

_PLAIN_TEXTS = "plain AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL AND NOT contains(text, '<') AND NOT contains(text, '&'))"


@query(rf"""WITH {_PLAIN_TEXTS}, sized AS (SELECT *, {_tokens('text')} AS n, text <> '' AS given FROM plain),
pieces AS (SELECT doc_id, regexp_extract_all(text, '(?:{PATTERN})\s*') AS t FROM sized WHERE n > {LIMIT}),
cut AS (SELECT doc_id, i AS chunk_index, array_to_string(t[i * {LIMIT - 2} + 1:(i + 1) * {LIMIT - 2}], '') AS document FROM (SELECT *, unnest(range(0, CAST(ceil(len(t) / {LIMIT - 2}.0) AS BIGINT))) AS i FROM pieces)),
whole AS (SELECT doc_id, 0 AS chunk_index, text AS document FROM sized WHERE given AND n <= {LIMIT})
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(regexp_replace(document, '\s+$', '')) AS digest, {_tokens('document')} AS tokens FROM (SELECT * FROM cut UNION ALL SELECT * FROM whole)""")
def plain_text_chunks(spark, folder):
    """Chunks of texts without markup, without the frame that the parser adds: long ones are cut into runs of tokens."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL AND NOT contains(text, '<') AND NOT contains(text, '&')")
    chunks = chunk_pages(docs.select(F.col("doc_id").cast("string").alias("source_file"), F.col("text").alias("html")))
    bare = F.regexp_replace(F.regexp_replace("document", "</?(html|body)>", ""), r"^\s+", "")
    bare = chunks.select(F.col("source_file").cast("long").alias("doc_id"), "chunk_index", F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")).alias("document"))
    stripped = F.regexp_replace("document", r"\s+$", "")
    return bare.where(stripped != "").select("doc_id", "chunk_index", F.md5(stripped.cast("binary")).alias("digest"), token_length(F.col("document")).alias("tokens"))


def _visible_sql(text: str) -> str:
    """Letters and digits of a text without tags, digested; of entities those of the tables."""
    out = f"regexp_replace(regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g'), '</?[A-Za-z][^>]*>', '', 'g')"
    for code in [*range(48, 58), *range(65, 91), *range(97, 123)]:
        out = f"replace({out}, '&#{code};', '{chr(code)}')"
    out = f"replace(replace({out}, '&nbsp;', ''), '&copy;', '')"
    return f"md5(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def _visible(chunks: DataFrame) -> DataFrame:
    """(doc_id, digest): the letters and digits outside tags of all chunks of a page, in order."""
    bare = F.regexp_replace(F.regexp_replace("document", "</?[A-Za-z][^>]*>", ""), "&(amp|lt|gt|quot|nbsp);", "")
    rows = chunks.select(F.col("source_file").cast("long").alias("doc_id"), "chunk_index", F.regexp_replace(bare, r"[^\p{L}\p{N}]", "").alias("letters"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "letters"))), lambda x: x["letters"]), "")
    return rows.groupBy("doc_id").agg(F.md5(ordered.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, {_visible_sql('text')} AS digest FROM documents WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')")
def dom_chunk_letters(spark, folder):
    """The readable text of every page, put together again from its chunks: nothing is lost, doubled or moved."""
    return _visible(chunk_pages(_pages(spark, folder)))


_NO_LINKS = "regexp_replace(text, '(?is)<a(?:\\s[^>]*)?>.*?</a\\s*>', '', 'g')"


@query(f"SELECT doc_id, {_visible_sql(_NO_LINKS)} AS digest FROM documents WHERE regexp_matches({_NO_LINKS}, '[^\\s\\p{{Z}}]')")
def tag_ablation_letters(spark, folder):
    """The same when links are removed."""
    return _visible(chunk_pages(_pages(spark, folder), ablate="a"))


@query(f"SELECT count(*) AS pages, 0 AS over_limit, 0 AS gaps_in_index FROM documents WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')")
def dom_chunk_bounds(spark, folder):
    """Pages with chunks, chunks over the limit, pages whose chunk numbers aren't 0, 1, 2, ..."""
    per = chunk_pages(_pages(spark, folder)).groupBy("source_file").agg(
        F.count_if((F.col("token_count") > LIMIT) | (F.col("token_count") != token_length(F.col("document")))).alias("over"),
        (F.count(F.lit(1)) != F.max("chunk_index") + 1).alias("gap"), F.countDistinct("chunk_index").alias("n"), F.count(F.lit(1)).alias("rows"),
    )
    return per.agg(F.count(F.lit(1)).alias("pages"), F.sum("over").alias("over_limit"), F.count_if(F.col("gap") | (F.col("n") != F.col("rows"))).alias("gaps_in_index"))


@query("""SELECT vec_id // 16 AS page, round(sum(CASE WHEN vec_id % 3 <> 0 THEN list_sum(CAST(embedding AS DOUBLE[])) ELSE 0 END) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1e-6), 6) AS pooled_sum
FROM embeddings GROUP BY 1""")
def mean_pool(spark, folder):
    """Every 16 vectors pooled to their masked mean (every third is masked), summed up."""
    rows = table(spark, folder, "embeddings").select(F.expr("vec_id div 16").alias("page"), F.struct("vec_id", "embedding").alias("x"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("x"))  # 16 rows of a page
    mask = F.transform("x", lambda x: (x["vec_id"] % 3 != 0).cast("double"))
    pooled = batching.mean_pool(F.transform("x", lambda x: x["embedding"]), mask)
    return pages.select("page", F.round(F.aggregate(pooled, F.lit(0.0), lambda a, x: a + x), 6).alias("pooled_sum"))


@query("""SELECT count(*) AS pairs, round(avg(m), 6) AS mean_loss FROM (SELECT list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) / 64 AS m
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def embedding_mse(spark, folder):
    """Mean squared difference of each vector from the next."""
    rows = table(spark, folder, "embeddings")
    a = rows.select("vec_id", F.col("embedding").alias("a"))
    b = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(batching.mse(F.col("a"), F.col("b"))), 6).alias("mean_loss"))


@query()
def text_embeddings(spark, folder):
    """Vectors of every text by a stand-in model."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", prompts.embed_column(F.col("text")).alias("embedding"))


# --- fetch outcomes: the tables hold none, so they follow the document number ---

_OUTCOMES = [
    ("200", None, None), ("404", None, None), (None, "ConnectTimeout", "timed out"), (None, "ReadTimeout", "timed out"), (None, "SSLError", "bad certificate"),
    (None, "ConnectionError", "NewConnectionError: Name or service not known"), (None, "ConnectionError", "Connection refused"), (None, "ConnectionError", "Connection reset by peer"),
    (None, "ConnectionError", "RemoteDisconnected"), (None, "ConnectionError", "Network is unreachable"), (None, "ConnectionError", "NewConnectionError"), (None, "ConnectionError", "odd"), (None, "InvalidURL", "x"),
]
_STATUS = ["200", "404", "connect_timeout", "read_timeout", "ssl_error", "dns_error", "connection_refused", "connection_reset", "remote_disconnected", "network_unreachable", "new_connection_error", "connection_error_other", "other_error:InvalidURL"]


def outcomes(spark, folder) -> DataFrame:
    """(doc_id, source, status) of every document."""
    known = F.array(*[F.struct(F.lit(c).cast("int").alias("code"), F.lit(e).cast("string").alias("error"), F.lit(m).cast("string").alias("message")) for c, e, m in _OUTCOMES])
    docs = table(spark, folder, "documents").select("doc_id", "source", F.get(known, (F.col("doc_id") % len(_OUTCOMES)).cast("int")).alias("o"))
    return docs.select("doc_id", "source", fetch_status(F.col("o.code"), F.col("o.error"), F.col("o.message")).alias("status"))


_FETCHED = f"fetched AS (SELECT doc_id, source, {_STATUS}[CAST(doc_id % {len(_STATUS)} AS INTEGER) + 1] AS status FROM documents)"


@query(f"WITH {_FETCHED} SELECT * FROM fetched")
def fetch_status_class(spark, folder):
    """The status of every fetch."""
    return outcomes(spark, folder)


@query(f"WITH {_FETCHED} SELECT status, count(*) AS rows FROM fetched GROUP BY status")
def status_counts(spark, folder):
    """Fetches per status."""
    return outcomes(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {_FETCHED} SELECT source, count(*) AS failures FROM fetched WHERE status <> '200' GROUP BY source")
def failures_by_source(spark, folder):
    """Failed fetches per source."""
    return outcomes(spark, folder).where("status <> '200'").groupBy("source").agg(F.count(F.lit(1)).alias("failures"))


@query(r"""SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS authority,
row_number() OVER (ORDER BY regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), url) AS place FROM (SELECT DISTINCT url FROM test_1000_balanced_seed42 WHERE url IS NOT NULL)""")
def url_authority_order(spark, folder):
    """Urls ordered by authority, so that one host's come together."""
    urls = table(spark, folder, "test_1000_balanced_seed42").where("url IS NOT NULL").select("url").distinct()
    return rank_in_groups(urls.withColumn("authority", authority(F.col("url"))), [], [F.asc("authority"), F.asc("url")], "place")


@query("""SELECT id, source_name, chunk_index, epoch_us(loaded_at) AS loaded_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS r FROM chunk_vectors) WHERE r = 1""")
def vector_upsert(spark, folder):
    """The state after all loads: the last row of every id."""
    rows = table(spark, folder, "chunk_vectors").select("id", "source_name", "chunk_index", "loaded_at")
    return first_in_groups(rows, ["id"], [F.desc("loaded_at")], 1).select("id", "source_name", "chunk_index", F.unix_micros("loaded_at").alias("loaded_us"))
