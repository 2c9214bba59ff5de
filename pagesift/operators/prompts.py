"""Prompts from ranked evidence, their budget, and batch answers by an injected classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.labels import parse_label
from pagesift.functions.tokens import token_length
from pagesift.operators.checks import require_positive
from pagesift.operators.evidence import closer_class
from pagesift.plans.stages import stage

SYSTEM = "You judge web pages. Decide whether the page is BENIGN or PHISHING."
HEAD = "Evidence from the page and from known pages follows.\n"
TAIL = "Answer with one word.\n"
REMINDER = "\nReply with exactly one of the words BENIGN and PHISHING.\n"
#: Arms of an experiment: examples shown, similarities shown, direction shown, query chunk shown.
ARMS = {
    "full": (True, True, False, True),
    "no_score": (True, False, False, True),
    "closer_label": (True, False, True, True),
    "closer_only": (False, False, True, True),
    "signal_only": (False, False, True, False),
    "no_examples": (False, False, False, True),
}


def similarity_text(s: Column) -> Column:
    """Six decimals."""
    return F.format_string("%.6f", s)


def block(rank: Column, query: Column, benign: Column, benign_s: Column, phishing: Column, phishing_s: Column, arm: str) -> Column:
    """The text of one evidence group in an arm; null texts are empty."""
    examples, scores, direction, own = ARMS[arm]
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = [F.concat(F.lit("## Evidence "), rank.cast("string"), F.lit("\n"))]
    if own:
        parts.append(F.concat(F.lit("Chunk of the page:\n"), text(query), F.lit("\n")))
    if direction:
        parts.append(F.concat(F.lit("Closer to: "), F.coalesce(closer_class(benign_s, phishing_s), F.lit("TIE")), F.lit("\n")))
    if examples:
        for name, example, s in (("BENIGN", benign, benign_s), ("PHISHING", phishing, phishing_s)):
            shown = F.concat(F.lit(" (similarity "), F.coalesce(similarity_text(s), F.lit("unknown")), F.lit(")")) if scores else F.lit("")
            parts.append(F.concat(F.lit(f"Known {name} chunk"), shown, F.lit(":\n"), text(example), F.lit("\n")))
    return F.concat(*parts)


@dataclass(frozen=True)
class Turns:
    """How a chat of a system and a user turn is written, up to where the answer begins; the defaults are a public format."""

    before: str = "<|im_start|>"
    after: str = "<|im_end|>\n"

    def open(self) -> str:
        return f"{self.before}system\n{SYSTEM}{self.after}{self.before}user\n"

    def close(self) -> str:
        return f"{self.after}{self.before}assistant\n"


def assemble(
    blocks: DataFrame, page: str, limit: int, url: Column | None = None, *, turns: Turns = Turns(), tokenizer=None, over: str = "keep"
) -> DataFrame:
    """(page, prompt, prompt_tokens, num_groups_available, num_groups_used) of blocks (page, rank, block).

    The least important groups are left out, whole, until the prompt, written out and
    counted again, has at most ``limit`` tokens. A page's blocks are a top n, so they
    fit a row; the count may be by any ``tokenizer`` (the stand-in runs inside the
    engine). Where not even the first group fits, ``over`` says what to do: 'keep' the
    page with a null prompt and no group used, or 'raise' an error.
    """
    if over not in ("keep", "raise"):
        raise ValueError(f"over is {over!r}, neither 'keep' nor 'raise'")
    require_positive(limit=limit)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    per = blocks.groupBy(page).agg(ordered.alias("b"), *([F.max(url).alias("url")] if url is not None else []))
    named = F.coalesce(F.concat(F.lit("Address: "), F.col("url"), F.lit("\n")), F.lit("")) if url is not None else F.lit("")
    head, tail = F.concat(F.lit(turns.open() + HEAD), named), F.lit(TAIL + turns.close())
    if tokenizer is None:
        prefix = lambda k: F.concat(head, F.array_join(F.slice("b", 1, k), ""), tail)
        sizes = F.transform(F.sequence(F.lit(1), F.size("b")), lambda k: F.struct(k.alias("k"), token_length(prefix(k), 0).alias("n")))
        fits = F.array_max(F.filter(sizes, lambda x: x["n"] <= limit))
    else:
        schema = "k int, n int"

        @F.pandas_udf(schema)
        def fit(head: pd.Series, blocks: pd.Series, tail: pd.Series) -> pd.DataFrame:
            rows = []
            for h, b, t in zip(head, blocks, tail, strict=True):
                for k in range(len(b), 0, -1):
                    n = tokenizer.count(h + "".join(b[:k]) + t) - tokenizer.special
                    if n <= limit:
                        break
                else:
                    k, n = None, None
                rows.append((k, n))
            return pd.DataFrame(rows, columns=["k", "n"]).astype("Int32")

        fits = fit(head, F.col("b"), tail)
    fitted = per.withColumn("f", fits)
    used = F.coalesce(F.col("f.k"), F.lit(0))
    text = F.concat(head, F.array_join(F.slice("b", 1, F.greatest(used, F.lit(1))), ""), tail)
    none = F.raise_error(F.concat(F.lit("not even the first group fits: "), F.col(page).cast("string"))) if over == "raise" else F.lit(None)
    return fitted.select(
        page, F.when(used > 0, text).otherwise(none.cast("string")).alias("prompt"), F.col("f.n").alias("prompt_tokens"),
        F.size("b").alias("num_groups_available"), used.alias("num_groups_used"),
    )


def answer(prompts: DataFrame, classify: Callable[[list[str]], list[str]], column: str = "model_output") -> DataFrame:
    """``prompts`` with the classifier's answers, batch by batch; ``classify`` maps a list of prompts to texts. A null prompt isn't asked."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + f", `{column}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("prompt")).to_pylist()
            said = iter(classify(some) if (some := [p for p in asked if p is not None]) else [])
            out = pa.array([None if p is None else next(said) for p in asked], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, column])

    return prompts.mapInArrow(run, schema)


def answer_with_retry(prompts: DataFrame, classify: Callable[[list[str]], list[str]]) -> DataFrame:
    """Answers and labels; only unreadable answers are asked for once more, with a reminder.

    The first answers are written before they are parted, so no prompt is asked twice
    and a classifier that isn't deterministic can't put a page into both parts. A page
    without prompt keeps a null answer and label.
    """
    first = stage(answer(prompts, classify).withColumn("predicted_label", parse_label(F.col("model_output"))), "answers")
    unread = F.col("predicted_label").isNull() & F.col("prompt").isNotNull()
    good = first.where(~unread).withColumn("retry_output", F.lit(None).cast("string"))
    again = first.where(unread).withColumn("prompt", F.concat("prompt", F.lit(REMINDER)))
    retried = answer(again, classify, "retry_output").withColumn("predicted_label", parse_label(F.col("retry_output")))
    return good.unionByName(stage(retried, "retried"))


def count_classifier(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: the class that more evidence is closer to; unsure on a tie, unless reminded."""
    out = []
    for p in prompts:
        a, b = p.count("Closer to: PHISHING"), p.count("Closer to: BENIGN")
        out.append("PHISHING" if a > b else "BENIGN" if b > a else "BENIGN" if p.endswith(REMINDER) else "BENIGN or PHISHING")
    return out


def embed(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: hashed word counts, not normalised."""
    import numpy as np
    import xxhash

    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    return out.tolist()


def embed_column(texts: Column, model: Callable[[list[str]], list[list[float]]] = embed) -> Column:
    """Vectors of texts by an injected model, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(batch: pd.Series) -> pd.Series:
        return pd.Series(model(batch.tolist()))

    return vectors(texts)
