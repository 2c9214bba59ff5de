"""Hand-computed cases of the core's operators."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.functions.dom import ABLATIONS, Chunker, chunk_pages, parse
from pagesift.functions.fetch import authority, connection_error_class
from pagesift.functions.ids import long_page_number, page_id, page_number
from pagesift.functions.labels import label_with_retry, parse_label
from pagesift.functions.tokens import PatternTokenizer, RankTokenizer, count_tokens
from pagesift.functions.urls import host_of, site_of
from pagesift.operators import batching, checks, evidence, metrics, pairs, prompts, ranking, sampling, voting


def values(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize("given_, want", [([0.5, 0.5], 0.75), ([1.0, 0.3], 1.0), ([0.0], 0.0)])
def test_noisy_or(spark, given_, want):
    rows = spark.createDataFrame([("p", 1, "s", x) for x in given_], "page string, label int, source string, similarity double")
    assert voting.noisy_or(rows, "page").first()["score"] == pytest.approx(want)


def test_page_votes_ties_and_strictness(spark):
    rows = [("none", 0, "a", 0.0), ("tie", 0, "a", 0.5), ("tie", 1, "b", 0.5), ("one", 1, "b", 0.5), ("one", 1, "c", 0.25), ("one", 0, "a", 0.3)]
    got = {r["page"]: r for r in voting.page_votes(spark.createDataFrame(rows, "page string, label int, source string, score double"), "page").collect()}
    assert (got["none"]["phishing_probability"], got["none"]["predicted_label"], got["none"]["tie"]) == (0.5, 0, True)
    assert (got["tie"]["phishing_probability"], got["tie"]["predicted_label"], got["tie"]["tie"]) == (0.5, 0, True)
    assert (got["one"]["predicted_label"], got["one"]["unique_phishing_sources"], got["one"]["tie"]) == (1, 2, False)


def test_importance_and_closer(spark):
    assert values(spark, evidence.importance(F.lit(0.6), F.lit(0.9))) == pytest.approx(0.27)
    assert values(spark, evidence.closer_class(F.lit(0.5), F.lit(0.5))) == "TIE"
    assert values(spark, evidence.closer_class(F.lit(0.5), F.lit(0.6))) == "PHISHING"


def test_top_chunk_tie_goes_to_smaller_index(spark):
    rows = spark.createDataFrame([("p", 5, 0.5), ("p", 2, 0.5)], "page string, query_chunk_index int, importance double")
    assert evidence.top_chunks(rows, "page", 1).first()["query_chunk_index"] == 2


@pytest.mark.parametrize(
    "text, want", [("Phishing", 1), ("benign BENIGN", 0), ("BENIGN or PHISHING", None), ("phishingly", None), ("", None), (None, None)]
)
def test_parse_label(spark, text, want):
    assert values(spark, parse_label(F.lit(text).cast("string"))) == want


def test_retry_only_where_unreadable(spark):
    assert values(spark, label_with_retry(F.lit("BENIGN"), F.lit("PHISHING"))) == 0
    assert values(spark, label_with_retry(F.lit("?"), F.lit("PHISHING"))) == 1


def test_metrics_count_null_as_wrong(spark):
    rows = spark.createDataFrame([(1, 1), (1, None), (0, 0), (0, 1)], "true_label int, predicted_label int")
    r = metrics.classification(rows, []).first()
    assert (r["accuracy"], r["coverage"], r["tn"], r["fp"], r["fn"], r["tp"]) == (0.5, 0.75, 1, 1, 0, 1)
    assert (r["recall_phishing_all"], r["recall_valid"], r["precision_valid"]) == (0.5, 1.0, 0.5)


def test_metrics_zero_denominators(spark):
    r = metrics.classification(spark.createDataFrame([(1, 0), (0, 0)], "true_label int, predicted_label int"), []).first()
    assert (r["precision_valid"], r["f1_valid"]) == (0.0, 0.0)


@pytest.mark.parametrize("b, c, want", [(0, 0, 1.0), (1, 1, 1.0), (3, 5, 0.7265625), (10, 2, 0.03857421875)])
def test_exact_mcnemar(spark, b, c, want):
    assert values(spark, pairs.exact_mcnemar(F.lit(b), F.lit(c))) == pytest.approx(want, rel=1e-12)


def test_exact_mcnemar_large(spark):
    n, k = 900, 380
    want = 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n
    assert values(spark, pairs.exact_mcnemar(F.lit(k), F.lit(n - k))) == pytest.approx(want, rel=1e-9)


def test_roc_auc_with_tie(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.4], strict=True)), "y int, s double")
    assert metrics.roc_auc(rows, "y", "s").first()[0] == 0.75
    assert metrics.roc_auc(rows.where("y = 1"), "y", "s").first()[0] is None


def test_distribution(spark):
    r = metrics.distribution(spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int"), "x", [0.5, 0.75, 0.995]).first()
    assert (r["p50"], r["p75"], r["p99_5"]) == (2.5, 4.75, 9.895)
    assert metrics.distribution(spark.createDataFrame([], "x int"), "x", [0.5]).count() == 0


def test_published_confusion_matrices_give_published_metrics(spark, data):
    for r in spark.read.parquet(f"{data}/topk_metrics.parquet").collect():
        counts = spark.createDataFrame(
            [(r["num_pages"], r["num_pages"], r["tn"] + r["fp"], r["fn"] + r["tp"], r["tn"], r["fp"], r["fn"], r["tp"])],
            "num_pages long, valid_predictions long, n0 long, n1 long, tn long, fp long, fn long, tp long",
        )
        m = metrics.derived(counts, []).first()
        assert m["accuracy"] == pytest.approx(r["accuracy"], abs=2e-6)
        assert m["precision_valid"] == pytest.approx(r["precision_phishing"], abs=2e-6)
        assert m["f1_valid"] == pytest.approx(r["f1_phishing"], abs=2e-6)


def test_ids(spark):
    assert values(spark, page_id(F.lit("html_clean/013057.txt"))) == "2d945cd74688c897"
    for name, want in (("html_clean/002121.txt", 2121), (".\\x\\00000013.HTML", 13), ("a/b.txt", None), ("d/d0007.txt", 7)):
        assert values(spark, page_number(F.lit(name))) == want


def test_page_numbers_beyond_64_bits(spark):
    big = "0009223372036854775808"
    for name, number, long in (("x/9223372036854775807.txt", 2**63 - 1, None), (f"a/{big}.html", None, big.lstrip("0")), ("12.txt", 12, None), ("a.txt", None, None), (None, None, None)):
        name = F.lit(name).cast("string")
        assert (values(spark, page_number(name)), values(spark, long_page_number(name))) == (number, long)


@pytest.mark.parametrize(
    "url, host, site",
    [
        ("https://A.B.x.Example:80/?a=1", "a.b.x.example", "x.example"),
        ("http://good.test@evil.example/x", "evil.example", "evil.example"),
        ("guest:pw@h.example/x", "h.example", "h.example"),
        ("h.example:8080/x", "h.example", "h.example"),
        (" https://h.example./", "h.example", "h.example"),
        ("http://[2001:DB8:1:0::1AF]:80/", "2001:db8:1::1af", "2001:db8:1::1af"),
        ("http://0x7f.1/", "127.0.0.1", "127.0.0.1"),
        ("http:\\\\evil.test\\@a.example", "evil.test", "evil.test"),
        ("bücher.example", "xn--bcher-kva.example", "xn--bcher-kva.example"),
        ("", None, None),
        (None, None, None),
        ("http://[broken/", None, None),
    ],
)
def test_hosts(url, host, site):
    assert host_of(url) == host
    assert site_of(url) == site


@pytest.mark.parametrize("message, want", [("ConnectionError: Connection reset by peer", "connection_reset"), ("NewConnectionError: Name or service not known", "dns_error"), ("?", "connection_error_other")])
def test_connection_error_class(spark, message, want):
    assert values(spark, connection_error_class(F.lit(message))) == want


def test_authority(spark):
    assert values(spark, authority(F.lit("http://u:p@h.test:8080/x?y"))) == "u:p@h.test:8080"
    assert values(spark, authority(F.lit(None).cast("string"))) == ""


def test_shards_and_milestones(spark):
    shards = [r[0] for r in spark.range(1, 502).select(evidence.shard_number(F.col("id"), 250)).collect()]
    assert [shards.count(i) for i in range(3)] == [250, 250, 1]
    assert values(spark, evidence.milestones(F.lit(7), [20])) == [2]


def test_rank_in_groups_equals_window(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009).alias("x"))
    got = {(r["g"], r["x"]): r["rank"] for r in ranking.rank_in_groups(rows, ["g"], [F.asc("x")]).collect()}
    for g in range(3):
        xs = sorted(x for k, x in got if k == g)
        assert [got[g, x] for x in xs] == list(range(1, len(xs) + 1))
    assert ranking.rank_in_groups(rows.where("false"), ["g"], [F.asc("x")]).count() == 0


def test_running_sums_and_quantiles_over_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500 / 4).alias("x"), (F.col("id") % 3 + 1).alias("n")).repartition(7)
    got = [(r["x"], r["n"], r["upto"]) for r in ranking.running_sums(rows, "x", "n", "upto").orderBy("x").collect()]
    total = 0
    for _, n, upto in got:
        total += n
        assert upto == total
    r = metrics.distribution(rows.union(spark.createDataFrame([(None, 1)], "x double, n long")), "x", [0.0, 0.3337, 1.0]).first()
    assert (r["count"], r["min"], r["max"], r["p0"], r["p33_37"], r["p100"]) == (500, 0.0, 124.75, 0.0, round(499 * 0.3337 / 4, 6), 124.75)


def test_bounded_shuffle_keeps_rows_in_their_partitions(spark):
    rows = spark.range(400, numPartitions=4).withColumn("p", F.spark_partition_id())
    got = sampling.bounded_shuffle(rows, 3).withColumn("q", F.spark_partition_id()).collect()
    assert all(r["p"] == r["q"] for r in got) and sorted(r["id"] for r in got) == list(range(400))
    assert [r["id"] for r in got] != list(range(400))


def test_batches_are_skipped_by_rows(spark):
    batches = batching.length_buckets(spark.range(50).select("id", (F.col("id") * 13 % 17).alias("n")), "id", "n", 20, 8)
    left = batching.skip_batches(batches, 28, 8, 20)
    assert left.count() == 22 and left.where("bucket = 1").agg(F.min("batch")).first()[0] == 1
    with pytest.raises(ValueError):
        batching.length_buckets(spark.range(5).select("id", F.col("id").alias("n")), "id", "n", 0)


def test_misplaced_rows(spark):
    a, b = (spark.createDataFrame(list(enumerate(x)), f"place int, {n} string") for x, n in (("abc", "l"), ("acbd", "r")))
    got = {(r["place"], r["l"], r["r"]) for r in checks.misplaced(a, b, ["place"], "l", "r").collect()}
    assert got == {(1, "b", "c"), (2, "c", "b"), (3, None, "d")}


def test_splits_are_disjoint_and_sized(spark):
    rows = spark.range(500).select("id", (F.col("id") % 2).alias("label"))
    fixed = sampling.fixed_count_split(rows, "label", "id", 50, 20)
    assert sorted(r["count"] for r in fixed.groupBy("label", "split").count().collect()) == [20, 20, 50, 50]
    assert fixed.select("id").distinct().count() == 140
    assert sampling.balanced_sample(rows, "label", "id", 10).count() == 20
    assert sampling.seeded_shuffle(rows, "id").agg(F.countDistinct("position"), F.max("position")).first()[:] == (500, 499)


def test_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert checks.inconsistent(rows, "k", "v").count() == 1
    assert checks.outside_domain(rows, "v", ["a", "b"]).count() == 1
    assert checks.duplicates(rows, ["k"]).first()["rows"] == 2
    assert checks.too_few(rows, "k", 2).first()["k"] == 2
    assert checks.signature_differences(json.dumps({"a": 1, "b": 2}), {"a": 1, "c": 3}) == ["b", "c"]
    with pytest.raises(ValueError):
        checks.require_positive(k=0)
    with pytest.raises(ValueError):
        checks.require_share(x=1.0)


def test_mean_pool_and_mse(spark):
    v = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(9.0), F.lit(9.0)))
    assert values(spark, batching.mean_pool(v, F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))) == [2.0, 3.0]
    assert values(spark, batching.mse(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(4.0)))) == 2.0


BLOCKS = [("p", i, " ".join(["x"] * 10) + "\n") for i in (1, 2, 3)] + [("long", 1, "y " * 500), ("long", 2, "z")]


def test_prompt_budget_keeps_longest_prefix_and_every_page(spark):
    blocks = spark.createDataFrame(BLOCKS, "page string, rank int, block string")
    frame = PatternTokenizer().count(prompts.Turns().open() + prompts.HEAD + prompts.TAIL + prompts.Turns().close()) - 2
    got = {r["page"]: r for r in prompts.assemble(blocks, "page", frame + 26).collect()}
    assert (got["p"]["num_groups_used"], got["p"]["num_groups_available"], got["p"]["prompt_tokens"]) == (2, 3, frame + 20)
    assert (got["long"]["num_groups_used"], got["long"]["prompt"], got["long"]["prompt_tokens"]) == (0, None, None)
    assert got["p"]["prompt"].startswith("<|im_start|>system\n") and got["p"]["prompt"].endswith("<|im_end|>\n<|im_start|>assistant\n")
    with pytest.raises(Exception, match="not even the first group fits"):
        prompts.assemble(blocks, "page", frame + 26, over="raise").collect()


def doubled():
    """A tokenizer whose counts aren't additive: two equal signs in a row are one token. (Made here so that tasks get it by value.)"""
    import re

    class Pairs:
        special = 1

        def count(self, text):
            return len(self.cut(text)) + 1

        def pieces(self, text, size):
            cut = self.cut(text)
            return ["".join(cut[i : i + size]) for i in range(0, len(cut), size)]

        def cut(self, text):
            return [m.group() for m in re.finditer(r"(?s)(.)\1|.", text)]

    return Pairs()


def test_prompt_is_counted_again_by_any_tokenizer(spark):
    blocks = spark.createDataFrame([("p", 1, "a"), ("p", 2, "a"), ("p", 3, "bc")], "page string, rank int, block string")
    frame = prompts.Turns().open() + prompts.HEAD, prompts.TAIL + prompts.Turns().close()
    limit = doubled().count(frame[0] + "aa" + frame[1]) - 1
    row = prompts.assemble(blocks, "page", limit, tokenizer=doubled()).first()
    assert (row["num_groups_used"], row["prompt_tokens"], row["prompt"]) == (2, limit, frame[0] + "aa" + frame[1])
    assert values(spark, F.concat_ws(",", *[count_tokens(F.lit(t), doubled()).cast("string") for t in ("aab", "")])) == "2,0"


def test_every_prompt_is_asked_once_and_every_page_answered(spark):
    asked, count = spark.sparkContext.accumulator(0), 40
    rows = spark.createDataFrame([(str(i), None if i % 10 == 0 else f"prompt {i}") for i in range(count)], "page string, prompt string")

    def classify(texts):
        asked.add(len(texts))
        return ["BENIGN" if t.endswith(prompts.REMINDER) else "PHISHING" if t[-1] in "135" else "?" for t in texts]

    got = {int(r["page"]): r for r in prompts.answer_with_retry(rows, classify).collect()}
    readable = sum(i % 10 in (1, 3, 5) for i in range(count))
    assert len(got) == count and asked.value == 36 + (36 - readable)
    assert got[0]["predicted_label"] is None and got[0]["model_output"] is None and got[2]["predicted_label"] == 0 and got[3]["predicted_label"] == 1


def test_pieces_of_texts_are_counted_again():
    chunks = Chunker(6, doubled()).chunks("<p>" + "abba" * 9 + "ccd" * 7 + "</p>")
    assert "".join(t for t, _ in chunks) == "abba" * 9 + "ccd" * 7
    assert all(n == doubled().count(t) <= 6 for t, n in chunks)
    with pytest.raises(ValueError):
        Chunker(1, doubled()).chunks("ab")


def test_byte_pair_tokens(spark):
    tokenizer = RankTokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken")
    text = "Straße in Köln \U0001f600 und anderswo, weit weg. " * 30
    parts = tokenizer.pieces(text, 7)
    assert "".join(parts) == text and all(p for p in parts)
    chunks = Chunker(16, tokenizer).chunks(f"<div>{text}</div>")
    assert all(n == tokenizer.count(t) <= 16 for t, n in chunks)
    pages = spark.createDataFrame([("a", f"<div>{text}</div>"), ("b", None)], "source_file string, html string")
    assert [(r["document"], r["token_count"]) for r in chunk_pages(pages, 16, tokenizer=tokenizer).orderBy("chunk_index").collect()] == chunks


def test_lists_in_attributes_have_single_blanks():
    assert Chunker().chunks('<p class=" a \n b" title=" a  b">x</p>')[0][0].endswith('<p class="a b" title=" a  b">x</p></body></html>')


def test_similarity_format(spark):
    assert values(spark, prompts.similarity_text(F.lit(0.5))) == "0.500000"


# --- HTML ---


class Fixed:
    """A tokenizer of one token per letter."""

    special = 0

    def count(self, text):
        return len(text)

    def pieces(self, text, size):
        return [text[i : i + size] for i in range(0, len(text), size)]


def test_greedy_merge():
    merged = Chunker(10, Fixed()).merge([("a" * 4, 4), ("b" * 5, 5), ("c" * 3, 3), ("d" * 8, 8)])
    assert [n for _, n in merged] == [9, 3, 8]


def test_direct_children_stay_apart_from_long_ones():
    chunker = Chunker(30, Fixed())
    chunks = chunker.chunks("<div><p>a</p><p>b</p><p>" + "c" * 40 + "</p><p>d</p></div>")
    texts = [t for t, _ in chunks]
    assert texts[0] == "<p>a</p><p>b</p>" and texts[-1] == "<p>d</p>"


@pytest.mark.parametrize("page", ["", None, "<!-- x -->", "<!doctype html>", "<script>x</script>"])
def test_pages_without_content(page):
    assert Chunker().chunks(page) == []


@pytest.mark.parametrize("tag", ABLATIONS)
def test_ablation_removes_tag(tag):
    page = '<div><form><input name="q"></form><a href="x">t</a><iframe src="y"></iframe><meta name="m"></div>'
    assert all(f"<{tag}" not in text for text, _ in Chunker().chunks(page, tag))
    assert any(f"<{tag}" in text for text, _ in Chunker().chunks(page))
    with pytest.raises(ValueError):
        parse(page, "p")


def test_long_attribute_and_text_are_divided():
    chunker = Chunker(40)
    for page in ('<img alt="' + "word " * 200 + '">', "<p>" + "word " * 300 + "</p>", "x" * 5_000 + " y"):
        chunks = chunker.chunks(page)
        assert chunks and all(n <= 40 for _, n in chunks)


def test_deep_page_does_not_recurse():
    assert Chunker(20).chunks("<div>" * 5_000 + "x" + "</div>" * 5_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a b'>", "</div>", "<li>", "<b>", "</b>", "text one", "words & more", "<br>", "<input name='x' value='long value here'>", "<!-- c -->", "<script>s</script>"]), max_size=40))
def test_chunks_stay_within_limit_and_count_right(parts):
    page, tokenizer = " ".join(parts), PatternTokenizer()
    whole = Chunker(10_000).chunks(page)
    assert len(whole) <= 1
    for text, n in Chunker(24).chunks(page):
        assert n == tokenizer.count(text) <= 24
        assert "<script" not in text and "<!--" not in text




def test_formats(spark):
    from pagesift.functions.formats import bytes_text, duration_text

    assert [values(spark, bytes_text(F.lit(n))) for n in (12, 2048, 5 << 30)] == ["12 B", "2.00 KiB", "5.00 GiB"]
    assert values(spark, duration_text(F.lit(3725.9))) == "1:02:05"


@pytest.mark.parametrize("block", [20_000, 7])
def test_neighbours_equal_brute_force(spark, block):
    import numpy as np

    from pagesift.operators.knn import class_neighbours

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)).round(1) + 0.05
    rows = spark.createDataFrame([(f"v{i:02d}", i % 2, [float(a) for a in v]) for i, v in enumerate(x)], "id string, label int, vector array<double>")
    queries, corpus = rows.where("id < 'v10'").select("id", "vector"), rows
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.clip(u @ u.T, 0, 1), 12)
    want = {(f"v{q:02d}", y, f"v{c:02d}", r + 1) for q in range(10) for y in (0, 1) for r, c in enumerate(sorted((c for c in range(60) if c % 2 == y), key=lambda c: (-s[q, c], c))[:4])}
    assert {(r["query_id"], r["label"], r["chunk_id"], r["rank"]) for r in class_neighbours(queries, corpus, 4, block=block).collect()} == want


def test_index_of_classes_is_merged_and_probed(spark, tmp_path):
    import numpy as np

    from pagesift.operators.class_index import add_chunks, fit_index, index_neighbours, open_index
    from pagesift.operators.knn import class_neighbours

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 900)] + 0.2 * rng.normal(size=(900, 6))
    schema = "id string, label int, vector array<float>, seq int"
    rows = spark.createDataFrame([(f"v{i:03d}", i % 2, v.tolist(), 1) for i, v in enumerate(x)], schema)
    folder = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        index_neighbours(rows.select("id", "vector"), folder, 1)
    fit_index(rows, folder, 6)
    stale = rows.where("id < 'v300'").withColumn("vector", F.transform("vector", lambda v: -v))
    add_chunks(stale.unionByName(rows.where("id >= 'v300'")), folder, order="seq")
    add_chunks(rows.where("id < 'v300'").withColumn("seq", F.lit(2)), folder, order="seq")
    assert open_index(spark, folder).count() == 900 and open_index(spark, folder, 1).count() == 450
    queries = rows.where("id < 'v100'").select("id", "vector")
    true = {tuple(r) for r in class_neighbours(queries, rows.drop("seq"), 5).select("query_id", "label", "chunk_id", "rank").collect()}
    whole = {tuple(r) for r in index_neighbours(queries, folder, 5, probes=1.0, least_probes=99).select("query_id", "label", "chunk_id", "rank").collect()}
    assert whole == true
    some = {tuple(r) for r in index_neighbours(queries, folder, 5, probes=0.3, least_probes=1, cell_rows=20).select("query_id", "label", "chunk_id", "rank").collect()}
    assert len(some & true) >= 0.9 * len(true) and len(some) == len(true)
    assert index_neighbours(queries.where("false"), folder, 5).count() == 0


def test_index_reaches_nine_in_ten(spark):
    from pagesift.plans.q_votes import knn_index_recall

    for row in knn_index_recall(spark, "/root/testdata/sf0.01").collect():
        assert row["queries"] > 100 and row["hits"] <= row["true_neighbours"] and row["recall"] >= 0.95
