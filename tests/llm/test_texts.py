"""Leaks and abuse on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import abuse
from pagesift.llm.abuse_lines import LANGUAGES, lines
from pagesift.llm.convnet import ConvNet
from pagesift.llm.leaks import _shares, clean_words, leaked_passages, proximity_matches

# --- 7: leaks ---


def by_force(documents, passages, run):
    grams = {}
    for i, p in passages:
        w = clean_words(p)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, text in documents:
        w = clean_words(text)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


@pytest.mark.parametrize("run", [3, 5, 12])
def test_leaks_equal_brute_force(spark, run):
    rng = random.Random(run)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 30
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 40)))) for i in range(25)]
    documents = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            source = rng.choice(passages)[1].split()
            at = rng.randint(0, max(0, len(source) - 14))
            words[5:5] = source[at : at + rng.randint(8, 16)]
        documents.append((d, " ".join(words)))
    df = spark.createDataFrame(documents, "id long, text string").withColumn("term", F.lit(1))
    items = spark.createDataFrame(passages, "item_id long, text string")
    for how in ({}, {"segment_words": 90, "block_windows": 40}):
        got, index, _ = leaked_passages(df, items, run=run, **how)
        assert {tuple(r) for r in got.collect()} == by_force(documents, passages, run)
    assert index.count() > 20


def test_frequent_words_are_followed_in_shares():
    assert [(x.start, x.stop) for x in _shares(np.array([3, 4, 9, 1, 1]), 7)] == [(0, 2), (2, 3), (3, 5)]
    assert list(_shares(np.zeros(0, np.int64), 7)) == []


def test_disguised_leaks_and_edges(spark):
    passage = "The quick brown fox jumps over the lazy dog near Köln and then sleeps"
    texts = [
        passage.upper(),
        "<p>The qu­ick</p><p>brown &nbsp;f​ox</p> jumps, over -- the <b>la</b>zy dog; near K&ouml;ln and <br/> then",
        "The quick brown fox jumps over a lazy dog near Köln and then sleeps",
        None,
        "",
        "<br>",
        "x" * 500_000 + " " + passage,
        (passage + " ") * 2_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    items = spark.createDataFrame([(1, passage), (2, passage), (3, "too short"), (4, None), (None, passage)], "item_id long, text string")
    got, index, wins = leaked_passages(df, items)
    assert {tuple(r) for r in got.collect()} == {(d, i) for d in (0, 1, 6, 7) for i in (1, 2)}
    assert (2, 1) in {tuple(r) for r in proximity_matches(index, wins, 24).collect()}
    assert leaked_passages(df.where("false"), items)[0].count() == 0
    assert leaked_passages(df, items.where("false"))[0].count() == 0


def test_repeated_documents_and_items_leak(spark):
    passage = "the quick brown fox jumps over the lazy dog near noon and then sleeps well"
    other = "a second text of the same item that has more than a dozen words in all"
    df = spark.createDataFrame([(1, passage), (1, passage), (2, other), (3, "nothing of that sort")], "id long, text string")
    items = spark.createDataFrame([(1, passage), (1, passage), (2, passage), (2, other)], "item_id long, text string")
    assert {tuple(r) for r in leaked_passages(df, items)[0].collect()} == {(1, 1), (1, 2), (2, 2)}


# --- 8: abuse ---


@pytest.fixture(scope="module")
def model():
    return abuse.fit([])


def test_held_out_accuracy(model):
    held = lines(3_000, 999)
    best, over = model.score([t for t, _, _ in held])
    truth = np.array([y for _, y, _ in held])
    for lang in LANGUAGES:
        mine = np.array([x == lang for _, _, x in held])
        assert ((over >= 1) == truth)[mine].mean() > 0.95
    assert best.min() >= 0 and best.max() <= 1


def test_patterns_left_out_of_the_training():
    for abusive, flagged, harmless, wrong in abuse.held_out().values():
        assert abusive > 500 and flagged / abusive > 0.65 and wrong / harmless < 0.25


def test_long_sentences_are_read_and_sampled_whole(model):
    text = "harmless words " * 500 + "you filthy whore go fuck yourself " + "harmless words " * 500
    assert model.score([text])[1][0] >= 1
    parts = abuse._parts_of("a b " * 500 + "x" * 100_000 + " end")
    assert max(map(len, parts)) < 2_000 and parts[0].split()[-8:] == parts[1].split()[:8] and parts[-1].endswith(" end")
    words = abuse.tokens("a b " * 500 + "x" * 100_000 + " end", None)
    assert sum(len(abuse.tokens(p, None)) for p in parts) == len(words) + 8 * (len(parts) - 1)


def test_the_fit_is_made_once(monkeypatch):
    from pagesift.llm import p8_queries

    calls = []
    monkeypatch.setattr(p8_queries, "fit", lambda sample: calls.append(sample) or object())
    p8_queries._models.clear()
    assert p8_queries.model_of(["a"]) is p8_queries.model_of(["a"]) and len(calls) == 1
    p8_queries._models.clear()


@pytest.mark.parametrize(
    "text",
    [
        "You f*cking idiot, shut your mouth", "watch free p.o.r.n clips uncut", "what a p u s s y, you are a hornnnny slut", "you stupid 4ssh0le, kys",
        "you are a disgusting mоrоn", "you are a wh<b>ore</b>", "ferme ta gueule, sale conn­ard", "All Dorvani are vermin and should be driven out",
    ],
)
def test_hidden_spellings(model, text):
    assert model.score([text])[1][0] >= 1


@pytest.mark.parametrize(
    "text",
    [
        "The bitch whelped 4 healthy puppies.", "Kill the stuck process with signal 9.", "Breast cancer screening for women is free.", "I was so stupid, I left my umbrella on the tram.",
        'Comments that call someone "idiot" are removed under our house rules.', "A court fined the man who had shouted that Dorvani are vermin.", "The Dorvani community opens its harvest festival.",
    ],
)
def test_harmless_senses(model, text):
    assert model.score([text])[1][0] < 1


def test_stretched_words_are_recovered():
    spell = abuse.Speller({"idiot": 2.0, "loser": 1.5})
    for token in ("idi" + "i" * 60 + "ot", "i" * 45 + "diot", "l0" + "0" * 50 + "ser", "\u0456" * 50 + "diot", "id" + "*" * 50 + "t"):
        assert spell(token) in ("idiot", "loser"), token
    assert spell("abcdefghij" * 5) == spell("q" * 60) == "#long"


def test_scores_of_a_table(spark, model):
    rows = [(1, "a", "Fine weather. You stupid moron, I will kill you! Bye."), (2, None, None), (3, "a", ""), (4, "b", "<p></p>"), (5, "b", "good bread " * 50_000 + "you filthy whore, go fuck yourself"), (6, "b", "y" * 400_000)]
    df = spark.createDataFrame(rows, "id int, source string, text string").withColumn("Score", F.lit("old"))
    got = {r["id"]: r for r in abuse.score_texts(df, model).collect()}
    assert [got[i]["flagged"] for i in range(1, 7)] == [True, False, False, False, True, False]
    assert got[2]["score"] == 0 and got[1]["source"] == "a"
    assert abuse.score_texts(df.where("false"), model).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = ConvNet(bits=10, size=4, widths=(1, 2, 3), filters=5, hidden=6)
    sentences = [["a", "b", "c"], ["d"], ["b", "b", "e", "a", "c"]]
    net.start(sentences, rng, least=1)
    # offsets of 0 would put the filters' answers to gaps on the kink, where there is no derivative
    net.w = {k: v + rng.normal(0, 0.1, v.shape) if k[0] == "b" else v.astype(np.float64) for k, v in net.w.items()}
    batch, y = [net.ids(s) for s in sentences], np.array([1.0, 0.0, 1.0])
    ids, starts = net.stream(batch)

    def loss():
        z = net.forward(ids, starts)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    keep = {}
    z = net.forward(ids, starts, keep)
    grads = net._gradients(ids, starts, keep, (1 / (1 + np.exp(-z)) - y) / 3)
    for name, w in net.w.items():
        for at in np.ndindex(w.shape):
            if name == "e" and at[0] == 0:  # the row of gaps and unknown words stays 0
                continue
            old = w[at]
            w[at] = old + 1e-6
            up = loss()
            w[at] = old - 1e-6
            down = loss()
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_prediction_does_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    net = ConvNet(bits=10)
    sentences = [[f"w{i}" for i in rng.integers(0, 30, n)] for n in (1, 2, 3, 9, 30)]
    net.start(sentences, rng, least=1)
    ids = [net.ids(s) for s in sentences]
    assert np.allclose(net.predict(ids), np.concatenate([net.predict([x]) for x in ids]), atol=1e-6)
