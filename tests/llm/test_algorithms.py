"""Each training-data operator against brute force on small inputs, and its edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.llm import near_duplicates as nd
from pagesift.llm import packing
from pagesift.llm import vector_index as vi
from pagesift.llm.components import connected_components
from pagesift.llm.group_split import record_groups, split_of
from pagesift.llm.packing import best_fit, pack, token_pieces
from pagesift.llm.target_sample import rake, target_sample, whole_draws
from pagesift.llm.top_n import heavy_groups, parted, salted, top_n_per_group
from pagesift.llm.words import distinct_runs, word_hashes, words_of

# --- 1: top N of every group ---

HITS = "page string, item int, score double, at int, id long"


def hits(seed=1, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        page = rng.choice(["hot"] * 6 + ["warm"] * 2 + [f"p{rng.randint(0, 40)}", None])
        score = rng.choice([None, float("nan"), rng.random(), 0.5, 0.5])
        rows.append((page, rng.randint(0, 400), score, rng.randint(0, 3), i))
    return rows


def best(rows, n):
    """Latest delivery per (page, item), then the n best by score, item."""
    last = {}
    for page, item, score, at, i in rows:
        if (page, item) not in last or (at, i) > last[page, item][:2]:
            last[page, item] = (at, i, score)
    pages = {}
    for (page, item), (_, i, score) in last.items():
        if score is not None and score == score:
            pages.setdefault(page, []).append((-score, item, i))
    return {(p, k + 1, x[2]) for p, xs in pages.items() for k, x in enumerate(sorted(xs)[:n])}


@pytest.mark.parametrize("heavy_rows", [100_000, 300, 20])
def test_top_n_light_and_heavy_ways_agree(spark, heavy_rows):
    rows = hits()
    got = top_n_per_group(
        spark.createDataFrame(rows, HITS), ["page"], [F.desc("score"), F.asc("item")], 7,
        latest_by=["item"], latest_order=[F.desc("at"), F.desc("id")], keep=F.col("score").isNotNull() & ~F.isnan("score"), heavy_rows=heavy_rows,
    )
    assert {(r["page"], r["rank"], r["id"]) for r in got.collect()} == best(rows, 7)


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 9), ("a", 2, 0.5, 8), (None, 3, None, 7)], "g string, id int, s double, Rank int").withColumn("_topn_h", F.lit("x"))
    got = top_n_per_group(df, ["g"], [F.desc("s"), F.asc("id")], 1, heavy_rows=1)
    assert sorted((r["g"] or "", r["id"], r["rank"], r["_topn_h"]) for r in got.collect()) == [("", 3, 1, "x"), ("a", 1, 1, "x")]
    assert top_n_per_group(df.where("false"), ["g"], [F.asc("id")], 3).count() == 0
    assert top_n_per_group(df, ["g"], [F.asc("id")], 0).count() == 0
    same = spark.createDataFrame([("a", 1)] * 5, "g string, id int")
    assert sorted(r["rank"] for r in top_n_per_group(same, ["g"], [F.asc("id")], 3).collect()) == [1, 2, 3]


@pytest.mark.parametrize("most_broadcast, hottest", [(1_000, 1_000), (10, 3), (0, 0)])
def test_every_heavy_group_is_split(spark, most_broadcast, hottest):
    df = spark.range(9_000).select("id", (F.col("id") % 45).alias("g"), F.xxhash64(F.col("id") % 45).alias("h"))
    df = df.unionByName(spark.range(20).select("id", (F.col("id") + 900).alias("g"), F.xxhash64(F.col("id") + 900).alias("h")))
    heavy = heavy_groups(df, "h", "s", 50)
    assert heavy.count() == 45 and {r["s"] for r in heavy.collect()} == {5}
    light, split = parted(df, heavy, "h", "s", most_broadcast, hottest)
    assert light.count() == 20 and split.count() == 9_000
    rows = salted(split, "h", "s", F.xxhash64("id"), 225)
    assert rows.groupBy("h", "s").count().agg(F.max("count")).first()[0] < 75  # of 200 in a group
    assert rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
    got = top_n_per_group(df.drop("h"), ["g"], [F.desc("id")], 2, heavy_rows=50, most_broadcast=most_broadcast, hottest=hottest)
    want = {(g, 8_955 - 45 * k + g, k + 1) for g in range(45) for k in range(2)} | {(900 + i, i, 1) for i in range(20)}
    assert {(r["g"], r["id"], r["rank"]) for r in got.collect()} == want


# --- 2: splits ---


def roots(edges, nodes=()):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n in nodes:
        find(n)
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    low = {}
    for x in parent:
        low[find(x)] = min(low.get(find(x), x), x)
    return {x: low[find(x)] for x in parent}


@pytest.mark.parametrize("hot", [200_000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed, hot):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + i) for i in range(60)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), hot_rows=hot)
    assert {r["node"]: r["component"] for r in got.collect()} == roots(edges)


def test_components_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    got = connected_components(spark.createDataFrame([(None, 1), (3, 3), (5, 4), (5, 4)], "src long, dst long, x string".replace(", x string", "")))
    assert {r[0]: r[1] for r in got.collect()} == {3: 3, 4: 4, 5: 4}


@pytest.mark.parametrize("hot", [200_000, 3])
def test_record_groups(spark, hot):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randint(0, 60)]), rng.choice([None, f"s{rng.randint(0, 30)}"]), rng.choice([None, "hot", f"a{rng.randint(0, 40)}"] if i % 5 == 0 else [None])) for i in range(150)]
    rows += rows[:10] + [(900 + i, "third", None) for i in range(80)]
    edges, nodes = [], []
    for i, (n, s, a) in enumerate(rows):
        me = ("r", i)
        nodes.append(me)
        edges += [(me, ("n", n))] * (n is not None) + [(me, ("s", s))] * (s is not None) + [(me, ("t", a))] * (a is not None)
    key = {x: i for i, x in enumerate(dict.fromkeys([*nodes, *[e[1] for e in edges]]))}
    root = roots([(key[a], key[b]) for a, b in edges], key.values())
    smallest = {}
    for i, (n, _, _) in enumerate(rows):
        if n is not None:
            r = root[key["r", i]]
            smallest[r] = min(smallest.get(r, n), n)
    want = sorted((n or -1, s or "", a or "", smallest.get(root[key["r", i]], -1)) for i, (n, s, a) in enumerate(rows))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "n long, s string, a string, Group_No int, _rg string")
    got = record_groups(df, "n", ["s", "a"], hot_rows=hot).collect()
    assert sorted((-1 if r["n"] is None else r["n"], r["s"] or "", r["a"] or "", -1 if r["group_no"] is None else r["group_no"]) for r in got) == [
        (w[0] if w[0] != -1 else -1, *w[1:]) for w in sorted(((-1 if n is None else n), s or "", a or "", smallest.get(root[key["r", i]], -1)) for i, (n, s, a) in enumerate(rows))
    ] and len(want) == len(got)
    assert all(r["_rg"] == "x" for r in got)
    assert record_groups(df.where("false"), "n", ["s", "a"]).count() == 0


def test_sites_without_page_numbers_stay_together(spark, tmp_path):
    from pagesift.llm import p2_queries

    names = ["about.html", "contact.html", "home.html", "help.html", "lonely.html", "page_7.html"]
    urls = ["https://one.org/a", "https://one.org/b", "https://one.org/c", "https://two.org/a", None, "https://three.org/"]
    pq.write_table(pa.table({"filename": names, "url": urls}), tmp_path / "test_1000_balanced_seed42.parquet")
    pq.write_table(pa.table({"page_id": ["page_7"]}), tmp_path / "prediction.parquet")
    got = {r["name"]: (r["grp"], r["split"]) for r in p2_queries.splits(spark, str(tmp_path)).where("kind = 'listed'").collect()}
    assert got.keys() == set(names) and len({got[n] for n in names[:3]}) == 1
    assert len({got[n][0] for n in names}) == 4


def test_page_numbers_beyond_64_bits_link_and_count(spark, tmp_path):
    from pagesift.llm import p2_queries, p4_queries

    names = ["a/99999999999999999999.html", "b/099999999999999999999.txt", "99999999999999999998.txt", "7.txt"]
    urls = ["https://one.org/", "https://two.org/", "https://three.org/", "https://two.org/x"]
    pq.write_table(pa.table({"filename": names, "url": urls, "label": [1] * 4, "lang": ["en"] * 4}), tmp_path / "test_1000_balanced_seed42.parquet")
    pq.write_table(pa.table({"page_id": ["x"]}), tmp_path / "prediction.parquet")
    got = {r["filename"]: (r["group_no"], r["linked"]) for r in p2_queries.listed(spark, str(tmp_path)).collect()}
    assert got[names[0]] == got[names[1]] == got[names[3]] and got[names[0]][0] == 7
    assert got[names[2]][0] is None and got[names[2]][1] not in (None, got[names[0]][1])
    pages = [r["page"] for r in p4_queries.pages(spark, str(tmp_path)).collect()]
    assert len(pages) == len(set(pages)) == 3 and 7 in pages


def test_split_shares(spark):
    counts = {r["split"]: r["count"] for r in spark.range(20_000).groupBy(split_of(F.col("id")).alias("split")).count().collect()}
    assert abs(counts["train"] - 16_000) < 300 and abs(counts["test"] - 2_000) < 200
    assert {r[0] for r in spark.range(10).select(split_of(F.col("id"), shares=(("all", 1.0),))).collect()} == {"all"}


# --- 3: nearest vectors ---


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 6, dim))
    return centers[rng.integers(0, len(centers), n)] + 0.25 * rng.normal(size=(n, dim))


def exact(ids, x, k, least=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:k] if least is None or s[i, j] >= least}


@pytest.mark.parametrize("cell_rows", [20_000, 60])
def test_close_neighbours_equal_brute_force(spark, cell_rows):
    x = clustered(600, 24)
    ids = [f"v{i}" for i in range(600)]
    df = spark.createDataFrame(pa.table({"id": ids, "vector": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))}))
    got = vi.nearest_vectors(df, 24, k=5, min_similarity=0.85, probes=0.6, cell_rows=cell_rows)
    want = exact(ids, x, 5, 0.85)
    found = {(r["id"], r["neighbour"]) for r in got.collect()}
    assert found <= want and len(found) >= 0.99 * len(want)


def test_recall_for_any_neighbours(spark):
    x = clustered(800, 20, 4)
    ids = [f"v{i}" for i in range(800)]
    df = spark.createDataFrame(pa.table({"id": ids, "vector": pa.array(x.tolist(), pa.list_(pa.float64()))})).withColumn("ask", F.pmod(F.xxhash64("id"), F.lit(4)) == 0)
    fast = {(r[0], r[1]) for r in vi.nearest_vectors(df, 20, k=5, probes=0.7, rerank=20, ask="ask").collect()}
    true = {(r[0], r[1]) for r in vi.brute_force(df, 20, k=5, ask="ask", block=64).collect()}
    assert true <= exact(ids, x, 5)
    assert len(fast & true) >= 0.9 * len(true)


def test_vector_edges(spark):
    schema = "id string, vector array<float>, cell int, role string"
    none = spark.createDataFrame([], schema)
    assert vi.nearest_vectors(none, 3).count() == 0
    bad = [(None, [1.0, 0.0, 0.0], 1, "x"), ("n", None, 1, "x"), ("z", [0.0, 0.0, 0.0], 1, "x"), ("i", [float("inf"), 1.0, 1.0], 1, "x"), ("m", [None, 1.0, 1.0], 1, "x"), ("s", [1.0], 1, "x"), ("e", [], 1, "x")]
    assert vi.nearest_vectors(spark.createDataFrame(bad, schema), 3).count() == 0
    good = [("a", [1.0, 0.0, 0.0], 1, "x"), ("b", [2.0, 0.0, 0.0], 1, "x"), ("c", [0.0, 1.0, 0.0], 1, "x"), ("a", [1.0, 0.0, 0.0], 1, "x"), ("h", [3e38, 0.0, 3e38], 1, "x")]
    got = {(r[0], r[1]): r[2] for r in vi.nearest_vectors(spark.createDataFrame(bad + good, schema), 3, k=2).collect()}
    assert got["a", "b"] == pytest.approx(1) and ("a", "a") not in got and got["h", "a"] == pytest.approx(0.5**0.5, abs=1e-6)
    assert len(got) == 8


def test_copies_have_copies_as_neighbours(spark):
    members = spark.createDataFrame([(f"c{i}", 1, "c0") for i in range(9)] + [("x", 2, "x")], "id string, cls long, first string")
    found = spark.createDataFrame([("c0", "x", 0.9), ("x", "c0", 0.9)], "id string, neighbour string, similarity double")
    got = {}
    for r in vi.with_copies(found, members, 3).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert got["c8"] == {"c0", "c1", "c2"} and got["c0"] == {"c1", "c2", "c3"} and got["x"] == {"c0", "c1", "c2"}


def test_copies_ask_and_are_found(spark, tmp_path):
    from pagesift.llm import p3_queries

    x = clustered(120, 8, 3).astype(np.float32)
    x[:80] = x[0]  # two thirds are copies
    ids = [f"v{i:03d}" for i in range(120)]
    table = pa.table({"id": ids, "source_name": ["run"] * 120, "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "loaded_at": [1] * 120})
    pq.write_table(table, tmp_path / "chunk_vectors.parquet")
    pq.write_table(pa.table({"source_name": ["run"], "embedding_dim": [8]}), tmp_path / "materialize_manifest.parquet")
    asking = {r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0).collect()}
    got = {}
    for r in p3_queries.neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["id"], {})[r["neighbour"]] = r["similarity"]
    assert got.keys() == asking and any("v000" < i < "v080" for i in asking)
    for i in asking:
        assert len(got[i]) == 5
        if i < "v080":
            assert got[i] == dict.fromkeys([c for c in ids if c != i][:5], 1.0)
    row = p3_queries.recall(spark, str(tmp_path)).first()
    assert (row["queries"], row["true_neighbours"], row["recall"]) == (len(asking), 5 * len(asking), 1.0)


# --- 4: samples by target shares ---


def test_rake_meets_two_margins():
    counts = np.array([10, 20, 30, 40])
    draws = rake(counts, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([6.0, 4.0]), np.array([5.0, 5.0])])
    assert draws[:2].sum() == pytest.approx(6) and draws[[0, 2]].sum() == pytest.approx(5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30), st.integers(0, 20)), min_size=1, max_size=12), st.integers(0, 300))
def test_whole_draws(cells, size):
    have, need, least = (np.array(x) for x in zip(*cells, strict=True))
    draws = whole_draws(have.astype(float), need, least, have, size)
    assert (draws >= 0).all() and (draws <= have).all()
    assert draws.sum() == min(size, have.sum()) or draws.sum() > size and (draws <= np.minimum(least, have)).all()
    assert (draws >= np.minimum(np.minimum(need, least), have)).all()


def test_repair_keeps_what_was_drawn():
    arrays = np.array([10.0, 60.0, 30.0]), np.array([40, 40, 20]), np.array([0, 0, 0]), np.array([500, 500, 5]), 100
    assert whole_draws(*arrays, np.array([40, 55, 5])).tolist() == [40, 55, 5]  # the 15 left over stay where they were drawn
    assert whole_draws(*arrays, np.array([55, 40, 5])).tolist() == [55, 40, 5]
    assert whole_draws(*arrays).tolist() == [42, 53, 5]


def test_raking_changes_the_draw(spark):
    # nobody is b or (in class 0) d, so these can't be filled, so the raked margins say who stands in
    rows = spark.range(6_000).select("id", (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 20 < 19, "c").otherwise("d").alias("l"))
    schema = "s int, y int, l string, share double, min_rows long, size long, seed int"
    shares = {"heavy c": {"a": 0.2, "b": 0.4, "c": 0.35, "d": 0.05}, "heavy a": {"a": 0.35, "b": 0.4, "c": 0.2, "d": 0.05}}
    drawn = {}
    for name, one in shares.items():
        targets = spark.createDataFrame([(1, 0, x, v, 0, 1_000, 7) for x, v in one.items()], schema)
        _, report = target_sample(rows, "id", targets, sample="s", stratum="y", categories=["l"], seed="seed")
        got = {r["l"]: r for r in report.collect()}
        assert sum(r["drawn"] for r in got.values()) == sum(r["provisional"] for r in got.values()) == 1_000
        assert got["b"]["gap"] == got["b"]["residual"] == 400
        drawn[name] = {x: got[x]["drawn"] - got[x]["wanted"] for x in "ac"}
    assert drawn["heavy c"]["c"] > 1.3 * drawn["heavy c"]["a"] > 0 and drawn["heavy a"]["a"] > 1.3 * drawn["heavy a"]["c"] > 0
    # two margins: the population's combinations follow them, not the target's cells
    two = spark.range(8_000).select("id", F.lit(1).alias("y"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("l"), F.when(F.col("id") % 8 < 6, "x").otherwise("z").alias("m"))
    cells = [(1, 1, x, m, sx * sm, 0, 400, 7) for x, sx in (("a", 0.8), ("b", 0.2)) for m, sm in (("x", 0.3), ("z", 0.7))]
    targets = spark.createDataFrame(cells, "s int, y int, l string, m string, share double, min_rows long, size long, seed int")
    _, report = target_sample(two, "id", targets, sample="s", stratum="y", categories=["l", "m"], seed="seed")
    got = {(r["l"], r["m"]): r["provisional"] for r in report.collect()}
    assert abs(got["a", "x"] + got["a", "z"] - 320) < 40 and abs(got["a", "z"] + got["b", "z"] - 280) < 40


def test_target_sample(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("l"), F.lit(1).alias("size"))
    rows = rows.unionByName(spark.createDataFrame([(9001, None, "a", 1), (9002, 1, None, 1)], "id long, y int, l string, size int"))
    targets = spark.createDataFrame(
        [(1, 0, "a", 0.5, 0, 100, 7), (1, 0, "b", 0.3, 0, 100, 7), (1, 0, "d", 0.2, 5, 100, 7), (1, 1, "a", 0.99, 0, 100, 7), (1, 1, "c", 0.01, 20, 100, 7), (1, 1, "c", 0.01, 20, 100, 7), (2, 0, "a", None, None, None, 8)],
        "s int, y int, l string, share double, min_rows long, size long, seed int",
    )
    drawn, report = target_sample(rows, "id", targets, sample="s", stratum="y", categories=["l"], seed="seed")
    got = {(r["s"], r["y"], r["l"]): r for r in report.collect()}
    assert (got[1, 0, "d"]["gap"], got[1, 0, "d"]["wanted"], got[1, 0, "d"]["drawn"]) == (20, 20, 0)
    assert got[1, 0, "a"]["drawn"] + got[1, 0, "b"]["drawn"] == 100 and got[1, 0, "a"]["drawn"] >= 50
    assert got[1, 1, "c"]["drawn"] == 20 and got[1, 1, "a"]["drawn"] == 80
    counts = {(r["s"], r["y"], r["l"]): r["count"] for r in drawn.groupBy("s", "y", "l").count().collect()}
    assert counts == {k: r["drawn"] for k, r in got.items() if r["drawn"]}
    assert drawn.select("s", "id").distinct().count() == drawn.count()
    again, _ = target_sample(rows.repartition(5), "id", targets, sample="s", stratum="y", categories=["l"], seed="seed")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    none, empty = target_sample(rows.where("false"), "id", targets, sample="s", stratum="y", categories=["l"], seed="seed")
    assert none.count() == 0 and empty.where("gap > 0").count() == 5


def test_residual_gaps_are_reported(spark):
    rows = spark.range(200).select("id", F.lit(1).alias("y"), F.when(F.col("id") < 120, "a").otherwise("c").alias("l"))
    targets = spark.createDataFrame([(1, 1, "a", 0.99, 0, 100, 7), (1, 1, "c", 0.01, 20, 100, 7)], "s int, y int, l string, share double, min_rows long, size long, seed int")
    _, report = target_sample(rows, "id", targets, sample="s", stratum="y", categories=["l"], seed="seed")
    assert {(r["l"], r["wanted"], r["drawn"], r["gap"], r["residual"]) for r in report.collect()} == {("a", 99, 80, 0, 19), ("c", 20, 20, 0, 0)}


# --- 5: near duplicates ---


def pairs_by_force(texts, width, t, least):
    sets = {}
    for k, x in texts:
        w = words_of(x or "")
        if len(w) >= least:
            sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            union = len(sets[a] | sets[b])
            same = words_of(dict(texts)[a]) == words_of(dict(texts)[b])
            if same or (union and 1000 * len(sets[a] & sets[b]) >= round(1000 * t) * union):
                out.add((a, b))
    return out


def edited(rng, words):
    words = list(words)
    for _ in range(rng.randint(0, max(1, len(words) // 12))):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"n{rng.randint(0, 999)}"
        elif kind < 0.7:
            words.insert(at, f"n{rng.randint(0, 999)}")
        elif len(words) > 5:
            del words[at]
    return words


@pytest.mark.parametrize("width, t, hot", [(3, 0.6, 16), (5, 0.8, 16), (3, 0.6, 0)])
def test_near_duplicates_equal_brute_force(spark, width, t, hot):
    rng = random.Random(width)
    texts = []
    for base in range(60):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([20, 30, 60, 64, 70, 150, 400]))]
        words = ["the", "same", "head", "for", "all", "pages"] * 2 + words
        texts += [(10 * base + i, " ".join(edited(rng, words))) for i in range(rng.randint(1, 6))]
    texts += [(9000 + i, "Equal text: " + "a b c d e f g h i j " * 3) for i in range(5)]
    old = nd.signatures.__kwdefaults__["hot_texts"]
    nd.signatures.__kwdefaults__["hot_texts"] = hot
    try:
        df = spark.createDataFrame(texts, "key long, text string").withColumn("sketch", F.lit(1))
        pairs, members = nd.near_duplicate_pairs(df, width=width, threshold=t, min_words=20)
        got = {(r[0], r[1]) for r in nd.expand_pairs(pairs, members).collect()}
    finally:
        nd.signatures.__kwdefaults__["hot_texts"] = old
    want = pairs_by_force(texts, width, t, 20)
    assert got == want
    whole, members = nd.near_duplicate_pairs(df, width=width, threshold=t, min_words=20, exact=True)
    assert {(r[0], r[1]) for r in nd.expand_pairs(whole, members).collect()} == want


def run_values(words):
    return distinct_runs(*word_hashes([words]), 3)[1]


def text_with(rng, start, runs, wanted):
    """``start`` and as many more words, each of whose new runs has a cell that is ``wanted``."""
    words = list(start)
    while runs:
        words.append(f"w{rng.randint(0, 10**9)}")
        if len(words) > 2 and not wanted(int(run_values(words[-3:])[0] % np.uint64(384))):
            words.pop()
        else:
            runs -= len(words) > 2
    return words


def test_pairs_whose_first_cells_all_disagree_are_found(spark):
    # all 24 runs that only one of the two texts has are in the first 60 of 384 cells, all 78 common ones behind the first 100
    rng = random.Random(5)
    common = text_with(rng, [], 78, lambda cell: cell >= 100)
    texts = [(k, " ".join(text_with(rng, common, 24, lambda cell: cell < 60))) for k in (1, 2)]
    assert pairs_by_force(texts, 3, 0.6, 20) == {(1, 2)}
    df = spark.createDataFrame(texts, "key long, text string")
    for exact in (False, True):
        pairs, members = nd.near_duplicate_pairs(df, width=3, threshold=0.6, exact=exact)
        assert [tuple(r) for r in nd.expand_pairs(pairs, members).collect()] == [(1, 2)]


def test_runs_of_a_template_come_last(spark):
    head = [f"h{i}" for i in range(52)]
    texts = [(i, " ".join(head + [f"u{i}x{j}" for j in range(50)])) for i in range(60)]
    df = spark.createDataFrame(texts, "key long, text string").withColumn("raw", F.xxhash64("text")).repartition(5)
    signed = nd.signatures(df, 3, 0.6, 20)
    assert {len(r[0]) for r in signed.select("sketch").collect()} == {41}
    assert nd.shared_words(signed).count() == 0


def test_words_of_all_texts_are_counted(spark):
    rng = np.random.default_rng(3)
    words = rng.integers(-(2**63), 2**63, 9_000)
    words[:900] = words[0]
    words[900:1_800:2] = words[901]
    rows = [(words[i : i + 5].tolist(),) for i in range(0, len(words), 5)] + [([],)]
    df = spark.createDataFrame(rows, "words array<long>").repartition(4)
    count = np.bincount((words.view(np.uint64) >> np.uint64(50)).astype(np.int64), minlength=1 << 14)
    assert count.max() >= 900
    for hot in (0, 2, 16):
        want = [math.ceil(4 * math.log2(max(c, hot, 1) / max(hot, 1))) for c in count.tolist()]
        assert nd.slot_levels(df, 14, hot).tolist() == want
    assert not nd.slot_levels(df.limit(0), 14, 16).any()


def test_frequent_words_are_counted_without_a_gather(spark):
    rows = [(i, [7, 1_000 + i, 2_000 + i // 2]) for i in range(600)] + [(i, [7, 2_000 + i // 2]) for i in range(50)]
    signed = spark.createDataFrame(rows, "text_hash long, sketch array<long>").repartition(7)
    want = {(7, i, 600) for i in range(600)} | {(2_000 + i // 2, i, 2) for i in range(600)}
    for hot in (200_000, 100, 1):
        got = nd.shared_words(signed, hot, 64)
        assert sorted(map(tuple, got.select("word", "text_hash", "_n").collect())) == sorted(want)
    # in the split way the word that is in every text spreads over the tasks (small partitions aren't put together here)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert nd.shared_words(signed, 100, 64).where("word = 7").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_near_duplicate_edges(spark):
    long = "lorem ipsum dolor " * 60_000
    rows = [(1, None), (2, ""), (3, "short text"), (4, long), (5, long), (None, long), (6, "x" * 300_000), (5, long), (7, "Wörter " * 30)]
    pairs, members = nd.near_duplicate_pairs(spark.createDataFrame(rows, "key long, text string"), width=3, threshold=0.6)
    assert [tuple(r) for r in nd.expand_pairs(pairs, members).collect()] == [(4, 5)]
    got = {r["key"]: (r["class_id"], r["copies"], r["links"]) for r in nd.near_duplicate_classes(pairs, members).collect()}
    assert got == {4: (4, 1, 0), 5: (4, 1, 0), 7: (7, 0, 0)}
    none = spark.createDataFrame([], "key long, text string")
    pairs, members = nd.near_duplicate_pairs(none)
    assert pairs.count() == 0 and nd.near_duplicate_classes(pairs, members).count() == 0


def test_every_document_has_a_class(spark, tmp_path):
    from pagesift.llm import p5_queries

    texts = ["404", None, "", " \n", "404!", "<html></html>", "html html", "---", "---", "?", "one two three four five six", "One two three four five six.", None]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["copies"]) for r in p5_queries.document_classes(spark, str(tmp_path)).collect()}
    pairs = [(0, 4), (5, 6), (7, 8), (10, 11)]
    assert got == {i: (i, 0) for i in range(len(texts))} | {i: (pair[0], 1) for pair in pairs for i in pair}


def test_large_classes_of_copies_stay_linear(spark):
    members = spark.createDataFrame([(i, 7, 20) for i in range(50)] + [(100, 8, 20)], "key long, text_hash long, n_words int")
    pairs = spark.createDataFrame([(7, 8, 0.9)], "hash_a long, hash_b long, similarity double")
    got = {(r[0], r[1]) for r in nd.expand_pairs(pairs, members, most_copies=10).collect()}
    assert got == {(0, i) for i in range(1, 50)} | {(0, 100)}


def test_hot_words_are_compared_in_blocks(spark):
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()[: 20 + i % 6]) for i in range(40)]
    texts = [(i, " ".join([f"u{i}", *w])) for i, w in rows]
    df = spark.createDataFrame(texts, "key long, text string").withColumn("raw", F.xxhash64("text"))
    signed = nd.signatures(df, 3, 0.6, 20)
    small = {tuple(r) for r in nd.candidates(signed, 0.6, block=3).collect()}
    assert small == {tuple(r) for r in nd.candidates(signed, 0.6).collect()}


@pytest.mark.parametrize("n", [1, 18, 40, 63, 64, 100, 300, 2000])
def test_enough_words_are_emitted(n):
    need = nd.words_needed(n, math.ceil(0.6 * n), math.floor(n / 0.6), int(nd.LOAD * nd.BAND ** (int(nd.band_of(np.array([n]))[0]) + 1)), 0.6)
    assert 1 <= need <= math.floor(0.25 * (n + n / 0.6) + 1e-9) + 1


# --- 6: packing ---


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_fit(sizes):
    at = best_fit(np.array(sizes, np.int64), 50)
    filled = np.bincount(at, sizes) if sizes else np.zeros(0)
    assert (filled <= 50).all()
    assert len(filled) <= 2 * math.ceil(sum(sizes) / 50) + 1


@pytest.mark.parametrize("group", [20_000, 40])
def test_pack_loses_nothing(spark, group):
    rng = random.Random(1)
    items = [(rng.choice([None, i]), rng.randint(0, 2), rng.randint(0, 100)) for i in range(900)] + [(5, 0, 60)] * 3
    df = spark.createDataFrame(items, "item long, piece int, tokens int").withColumn("container", F.lit("x"))
    got = pack(df, 100, group_items=group).collect()
    assert sorted((r["item"] or -1, r["piece"], r["tokens"]) for r in got) == sorted((i or -1, p, t) for i, p, t in items if t)
    filled = {}
    for r in got:
        filled[r["container"]] = filled.get(r["container"], 0) + r["tokens"]
    assert all(filled[r["container"]] == r["container_tokens"] <= 100 for r in got)
    assert len(filled) <= (1.1 if group == 40 else 1.05) * math.ceil(sum(t for _, _, t in items) / 100) + 2


def test_pack_edges(spark):
    assert pack(spark.createDataFrame([], "item long, piece int, tokens int"), 10).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 0, 11)], "item long, piece int, tokens int"), 10)


def test_items_that_share_no_container_are_never_gathered(spark):
    df = spark.range(5_000, numPartitions=3).select(F.col("id").alias("item"), F.lit(0).alias("piece"), F.lit(300).alias("tokens"))
    got = pack(df, 512, group_items=100)
    assert got.select("container").distinct().count() == got.count() == 5_000
    mixed = df.select("item", "piece", F.explode(F.array(F.lit(300), F.lit(200))).alias("tokens"))
    filled = pack(mixed, 512, group_items=100).groupBy("container").agg(F.sum("tokens").alias("n"))
    assert filled.count() < 5_300 and filled.where("n > 512").count() == 0


def test_chunks_are_bounded(monkeypatch):
    seen = []

    class Here:
        @staticmethod
        def get():
            return Here

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(packing, "TaskContext", Here)
    monkeypatch.setattr(packing, "best_fit", lambda sizes, capacity: seen.append(len(sizes)) or best_fit(sizes, capacity))
    rows = pa.table({"id": list(range(950)), "size": [300] * 950})
    out = pa.Table.from_batches(packing._round(1, 512, 100)(iter(rows.to_batches(max_chunksize=170))))
    assert max(seen) == 100 and sum(seen) == 950 and len(set(out.column("bin").to_pylist())) == 950


def test_only_long_texts_are_divided(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (4, " \n"), (5, "word " * 3000), (6, "x" * 100_000)]
    got = token_pieces(spark.createDataFrame(rows, "item long, text string"), 512).collect()
    assert {r["item"] for r in got} == {1, 5, 6}
    for i in (5, 6):
        sizes = [r["tokens"] for r in sorted(got, key=lambda r: r["piece"]) if r["item"] == i]
        assert all(s == 512 for s in sizes[:-1]) and 0 < sizes[-1] <= 512
