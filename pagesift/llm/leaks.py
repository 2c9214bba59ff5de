"""Test passages inside training texts, by a distributed positional inverted index.

The index is made of segments, each of which holds the postings of some whole
documents: for every term of the test passages its positions, sorted, in one row of
positions on which the segment's documents lie one after the other. Looking up a
window of passage words starts with the postings of its rarest term; the other lists
are intersected, shifted by their offsets, from the next rarest on. As a document's
postings are all in one segment, no posting is ever exchanged: the windows, of which
a block is of bounded size, go to the segments.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.words import plain, word_hashes, words_of
from pagesift.plans.stages import drop_stage, stage

#: Terms of the tests up to which the tasks get the list of them (8 bytes a term); beyond, all terms are indexed.
MAX_TERMS = 2_000_000
#: Words after which a segment of the index ends, windows that are looked up in one pass, places followed at once.
SEGMENT_WORDS, BLOCK_WINDOWS, PLACES = 200_000, 100_000, 2_000_000


def clean_words(text: str | None) -> list[str]:
    """Words of a text without tags, entities and invisible characters."""
    if not text:
        return []
    text = plain(text)
    return words_of(text if text.isascii() else unicodedata.normalize("NFC", text))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, pos, term)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            term, counts = word_hashes(map(clean_words, part.column(1).to_pylist()))
            pos = np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos.astype(np.int32)), pa.array(term.view(np.int64))], ["id", "pos", "term"])


def _segments(known: np.ndarray | None, most: int):
    """(id, text) -> segments; of known terms only, if given."""

    def segment(ids: pa.Array, term: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        begin = np.cumsum(counts + 1) - counts - 1  # a free place parts two documents
        at = np.arange(len(term)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
        if known is not None:
            keep = np.flatnonzero(np.isin(term, known, kind="sort"))
            term, at = term[keep], at[keep]
        order = np.argsort(term, kind="stable")  # positions rise already
        term, at = term[order], at[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        document = np.searchsorted(begin, at, side="right")
        new = np.r_[True, (document[1:] != document[:-1]) | (term[1:] != term[:-1])] if len(term) else np.zeros(0, bool)
        df = np.add.reduceat(new, first) if len(first) else first
        one = lambda a, t: pa.array([a], pa.list_(t))
        columns = [one(term[first], pa.int64()), one(df, pa.int32()), one(np.r_[first, len(term)], pa.int32()), one(at, pa.int32()), one(ids.to_numpy(), pa.int64()), one(begin, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["terms", "df", "starts", "at", "ids", "begin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                term, counts = word_hashes(map(clean_words, part.column(1).to_pylist()))
                term = term.view(np.int64)
                ends = np.cumsum(counts)
                i = 0
                while i < len(counts):
                    done = int(ends[i] - counts[i])
                    j = max(i + 1, int(np.searchsorted(ends, done + most, side="right")))
                    if ends[j - 1] > done:
                        yield segment(part.column(0).slice(i, j - i), term[done : ends[j - 1]], counts[i:j])
                    i = j

    return run


def index_terms(passages: DataFrame) -> DataFrame:
    """(item_id, part, pos, term) of every word of the passages (item_id, text); part tells the texts of one item apart."""
    rows = passages.where("item_id IS NOT NULL").select(F.struct(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("part")).alias("id"), "text")
    rows = rows.dropDuplicates()
    return rows.mapInArrow(_terms, "id struct<item_id:long,part:long>, pos int, term long").select("id.item_id", "id.part", "pos", "term")


def build_index(documents: DataFrame, terms: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the postings of the distinct ``terms`` in all documents (id, text), written without an exchange.

    A row is a segment: terms (sorted), df (documents of each), starts (of each one's
    positions), at (positions), ids (of the documents) and begin (where each begins).
    """
    distinct = terms.select("term").distinct()
    rows = documents.select(F.col("id").cast("long"), F.col("text").cast("string")).where("id IS NOT NULL AND text IS NOT NULL")
    known = distinct.limit(MAX_TERMS + 1).toArrow().column(0).to_numpy()
    schema = "terms array<long>, df array<int>, starts array<int>, at array<int>, ids array<long>, begin array<int>"
    return stage(rows.mapInArrow(_segments(np.sort(known) if len(known) <= MAX_TERMS else None, segment_words), schema), "postings")


def windows(terms: DataFrame, index: DataFrame, run: int) -> DataFrame:
    """(item_id, part, start, w): each window of ``run`` passage words whose terms all occur, rarest terms first."""
    listed = index.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("df").alias("df"))))
    documents = listed.groupBy("term").agg(F.sum("df").alias("df"))
    sized = terms.join(documents, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = Window.partitionBy("item_id", "part").orderBy("pos").rowsBetween(0, run - 1)
    ranked = F.array_sort(F.collect_list(F.struct("df", "pos", "term")).over(ahead))
    out = sized.select("item_id", "part", F.col("pos").alias("start"), ranked.alias("w")).where((F.size("w") == run) & (F.col("w")[0]["df"] > 0))
    of = lambda name: F.transform("w", lambda x: x[name])
    return stage(out.select("item_id", "part", "start", of("term").alias("term"), of("pos").alias("pos")), "windows")


class _Lookup:
    """A block of windows: terms and positions of each, rarest first."""

    def __init__(self, rows: pa.Table):
        self.item = rows.column("item_id").to_numpy()
        term, pos = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("term", "pos"))
        shape = len(self.item), len(term) // max(len(self.item), 1)
        term, self.pos = term.reshape(shape), pos.reshape(shape).astype(np.int64)
        self.known, where = np.unique(term, return_inverse=True)
        self.term = where.reshape(shape)

    def search(self, segment: dict[str, np.ndarray], span: int | None, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(document ids, items) of the segment's documents with a window's first ``need`` terms in their places or, if given, within ``span`` of the first."""
        terms, starts, at, begin = segment["terms"], segment["starts"].astype(np.int64), segment["at"].astype(np.int64), segment["begin"]
        place = np.minimum(np.searchsorted(terms, self.known), len(terms) - 1)
        there = terms[place] == self.known
        live = np.flatnonzero(there[self.term[:, :need]].all(axis=1))
        keys = (np.repeat(np.arange(len(terms)), np.diff(starts)) << 32) + at
        first = place[self.term[live, 0]]
        counts = starts[first + 1] - starts[first]
        ids, items = [], []
        for part in _shares(counts, PLACES):
            w = np.repeat(live[part], counts[part])
            row = np.arange(len(w)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
            spot = at[np.repeat(starts[first[part]], counts[part]) + row]
            for k in range(1, need):
                if not len(w):
                    break
                list_ = place[self.term[w, k]] << 32
                if span is None:
                    want = list_ + spot - self.pos[w, 0] + self.pos[w, k]
                    near = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
                else:
                    doc = np.searchsorted(begin, spot, side="right") - 1
                    low = np.maximum(spot - span, begin[doc])
                    end = np.r_[begin[1:], np.iinfo(np.int32).max].astype(np.int64)[doc]
                    high = np.minimum(spot + span, end - 1)
                    near = np.searchsorted(keys, list_ + low) < np.searchsorted(keys, list_ + high, side="right")
                w, spot = w[near], spot[near]
            doc = np.searchsorted(begin, spot, side="right") - 1
            ids.append(segment["ids"][doc])
            items.append(self.item[w])
        both = np.unique(np.stack([np.concatenate(ids), np.concatenate(items)]), axis=1) if ids else np.zeros((2, 0), np.int64)
        return both[0], both[1]


def _shares(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``counts`` that add up to ``most`` at most, or have one element."""
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - counts[i] + most, side="right")))
        yield slice(i, j)
        i = j


def _search(lookup: _Lookup, span: int | None, need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = {n: batch.column(n)[row].values.to_numpy() for n in batch.schema.names}
                if len(segment["terms"]) and len(lookup.item):
                    ids, items = lookup.search(segment, span, need)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64())], ["id", "item_id"])

    return run


def _matches(index: DataFrame, wins: DataFrame, span: int | None, need: int, most: int = BLOCK_WINDOWS) -> DataFrame:
    """Distinct (id, item_id); every block of windows passes over the index once."""
    blocks = max(1, math.ceil(wins.count() / most))
    out = None
    for b in range(blocks):
        mine: Column = F.pmod(F.xxhash64("item_id", "part", "start"), F.lit(blocks)) == b
        lookup = _Lookup(wins.where(mine).select("item_id", "term", "pos").toArrow())
        if not len(lookup.item) and b + 1 < blocks:
            continue
        part = index.select("terms", "starts", "at", "ids", "begin").mapInArrow(_search(lookup, span, need), "id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def exact_matches(index: DataFrame, wins: DataFrame, run: int, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Distinct (id, item_id): documents with all ``run`` words of a window, in order and without gaps."""
    return _matches(index, wins, None, run, block_windows)


def proximity_matches(index: DataFrame, wins: DataFrame, span: int, terms: int = 3) -> DataFrame:
    """Distinct (id, item_id): documents with a window's ``terms`` rarest words within ``span`` words of the rarest, in any order."""
    return _matches(index, wins, span, terms)


def leaked_passages(
    documents: DataFrame, passages: DataFrame, *, run: int = 12, segment_words: int = SEGMENT_WORDS, block_windows: int = BLOCK_WINDOWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, index, windows): distinct (id, item_id) of documents (id, text) holding ``run`` words in a row of a passage (item_id, text).

    Letter case, punctuation, spacing, tags, entities and invisible characters don't
    matter. Defined cases: null, empty and tag-only texts hold nothing; a passage of
    fewer than ``run`` words leaks nowhere; a run that several passages share leaks
    each; a document id or an item that comes with several texts leaks if one of its
    texts does; other columns are ignored; no documents or no passages, no rows.
    """
    terms = stage(index_terms(passages), "terms")
    index = build_index(documents, terms, segment_words)
    wins = windows(terms, index, run)
    drop_stage(terms)
    return exact_matches(index, wins, run, block_windows), index, wins
