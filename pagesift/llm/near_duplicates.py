"""Near-duplicate texts by a join of their rarest runs, bounded by parity bits.

Two sets of n and s runs of Jaccard similarity t or more share t x n runs at least. In
an order common to all texts, of the first n - tn + 1 runs of each one is the same
(pigeonhole), so joining on these finds every pair. The order puts rare runs first:
all runs of all texts are counted by slots of their hash. A slot's count bounds the
frequency of each run in it; whatever it is, the order is the same for all texts, so the
counts decide how much is compared, never what is found.

A fixed sketch of ``BITS`` parity bits travels with each text that shares a run: a run
that only one of two texts has flips one bit, so the Hamming distance is a lower bound
of the size of the symmetric difference. Pairs beyond D = (1-t)/(1+t) (n+s) are left
before any text is fetched.

``by_sketch`` is a second way to find every pair: the runs of a text are XOR-hashed into
the words of a sketch, run h into word h mod m, which holds the XOR of its runs' 64-bit
hashes. Of a text's non-empty words at most D disagree with the other's, so among its
first D+1 one agrees. m follows the size band of a text, and a text near the upper
end of its band also emits the sketch of the next one. It emits more words;
``p5_recall`` compares the two ways.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.llm.components import connected_components, join_hot
from pagesift.llm.words import distinct_runs, mix, word_hashes, words_of
from pagesift.plans.stages import drop_stage, metrics_of, stage

#: Classes of more copies than this, at most MAX_HOT of them, are joined by broadcasting their one row.
HOT_ROWS, MAX_HOT = 200_000, 1_000
BITS = 256
BAND = 4  # sizes n with the same floor(log(n) / log(BAND)) are a band
LOAD = 1.5  # words of a sketch by runs of the largest text of its band
#: Words are counted by at most 2 ** MOST_SLOT_BITS slots, PART of them in a row.
MOST_SLOT_BITS, PART = 22, 4_096


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query within are deleted as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def band_of(n: np.ndarray) -> np.ndarray:
    """Number of the size band of n >= 1 runs."""
    edges = BAND ** np.arange(1, 32, dtype=np.float64)
    return np.searchsorted(edges, n, side="right")


def runs_needed(n: int, t: float) -> int:
    """How many runs a text of n runs has to emit: all that a partner may lack, and one more."""
    return n + (-n * round(1000 * t)) // 1000 + 1 if n else 0


def words_needed(n: int, low: int, high: int, m: int, t: float) -> int:
    """How many non-empty words of m a text of n runs has to emit for partners of low..high runs: all that may disagree, and one more."""
    return min(int((1 - t) / (1 + t) * (n + high) + 1e-9) + 1, n, m) if low <= high else 0


class Sketcher:
    """Turns a batch of texts into words, of which the first ones of a text are to be emitted."""

    def __init__(self, width: int, threshold: float, min_words: int, by_sketch: bool = False):
        self.width, self.t, self.min_words, self.by_sketch = width, threshold, min_words, by_sketch
        self.needs: dict[tuple[int, int], int] = {}

    def _need(self, n: int, up: int) -> int:
        if (n, up) not in self.needs:
            b = int(band_of(np.array([n]))[0])
            low, high = math.ceil(n * self.t - 1e-9), math.floor(n / self.t + 1e-9)
            edge = BAND ** (b + 1)
            m = int(LOAD * edge * BAND**up)
            span = (edge, high) if up else (max(1, low), min(high, edge - 1))
            self.needs[n, up] = words_needed(n, *span, m, self.t)
        return self.needs[n, up]

    def __call__(self, texts: list[str]) -> tuple:
        """(words of each text, hash of each text's words, runs of each text, parity bits, parts).

        Each part has owners, words sorted within each owner, and how many of them each text has to emit.
        """
        hashes, counts = word_hashes(map(words_of, texts))
        whole = np.zeros(len(texts), np.uint64)
        starts = np.cumsum(counts) - counts
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts, counts).astype(np.uint64)
        mixed = mix(hashes + mix(place))
        some = counts > 0
        if some.any():
            whole[some] = np.add.reduceat(mixed, starts[some])
        whole = mix(whole + counts.astype(np.uint64))
        owner, value = distinct_runs(hashes, counts, self.width)
        keep = counts[owner] >= self.min_words
        owner, value = owner[keep], value[keep]
        sizes = np.bincount(owner, minlength=len(texts))
        bits = np.zeros((len(texts), BITS // 64), np.uint64)
        spot = (value >> np.uint64(40)) % np.uint64(BITS)
        np.bitwise_xor.at(bits, (owner, (spot // np.uint64(64)).astype(np.int64)), np.uint64(1) << (spot % np.uint64(64)))
        if self.by_sketch:
            return counts, whole, sizes, bits, [self._level(owner, value, sizes, up) for up in (0, 1)]
        distinct, at = np.unique(sizes, return_inverse=True)
        need = np.array([runs_needed(int(n), self.t) for n in distinct], np.int64)
        return counts, whole, sizes, bits, [(owner, value, need[at])]

    def _level(self, owner: np.ndarray, value: np.ndarray, sizes: np.ndarray, up: int) -> tuple[np.ndarray, ...]:
        distinct, at = np.unique(sizes, return_inverse=True)
        need = np.array([self._need(int(n), up) if n else 0 for n in distinct], np.int64)[at]
        take = need[owner] > 0
        owner, value = owner[take], value[take]
        if not len(owner):
            return owner, value, need
        level = band_of(sizes[owner]) + up
        m = (LOAD * BAND ** (level + 1).astype(np.float64)).astype(np.uint64)
        index = value % m
        order = np.lexsort((index, owner))
        owner, value, index, level = owner[order], value[order], index[order], level[order]
        start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (index[1:] != index[:-1])])
        word = np.bitwise_xor.reduceat(value, start)
        owner, index, level = owner[start], index[start], level[start]
        word = mix(word ^ mix(index + (level.astype(np.uint64) << np.uint64(48))))
        order = np.lexsort((word, owner))
        return owner[order], word[order], need


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(owner: np.ndarray, word: np.ndarray, rows: int) -> pa.Array:
    """The words of each of ``rows`` owners, which come in order."""
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _long(word))


def _equal_lists(values: pa.Array, size: int, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(values, size).cast(pa.list_(kind))


def _all_words(sketcher: Sketcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                texts = [x or "" for x in part.column(1).to_pylist()]
                counts, whole, sizes, bits, parts = sketcher(texts)
                if not sketcher.min_words:  # texts without words: copies by their text, blank ones each for itself
                    blank = np.array([not x.strip() for x in texts], bool)
                    mark = np.where(blank, part.column(0).to_numpy(), part.column(2).to_numpy()).astype(np.int64).view(np.uint64)
                    whole = np.where(counts > 0, whole, mix(mix(mark) + blank.astype(np.uint64) + np.uint64(1)))
                # of copies in one task the first emits words; a forgotten one only emits them again
                new = np.zeros(len(texts), bool)
                for i, h in enumerate(whole.tolist()):
                    if h not in seen:
                        new[i] = True
                        seen.add(h)
                if len(seen) > 1_000_000:
                    seen.clear()
                parts = [(o[new[o]], w[new[o]], need) for o, w, need in parts]
                spans = np.stack([x for o, _, need in parts for x in (np.bincount(o, minlength=len(texts)), need)], axis=1).astype(np.int32)
                owner, word = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                order = np.argsort(owner, kind="stable")
                parity = _equal_lists(_long(np.ascontiguousarray(bits).ravel()), BITS // 64, pa.int64())
                n, runs = pa.array(counts.astype(np.int32)), pa.array(sizes.astype(np.int32))
                spans = _equal_lists(pa.array(spans.ravel()), spans.shape[1], pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), _long(whole), n, runs, parity, _lists(owner[order], word[order], len(texts)), spans],
                    ["key", "raw", "text_hash", "n_words", "n_runs", "parity", "words", "spans"],
                )
                yield out.filter(pa.array(counts >= sketcher.min_words))

    return run


def _slots_of(words: pa.Array, bits: int) -> np.ndarray:
    return (words.flatten().to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _slot_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            counts += np.bincount(_slots_of(batch.column(0), bits), minlength=1 << bits)
        rows = counts.reshape(-1, PART)
        some = np.flatnonzero(rows.any(axis=1))
        packed = [rows[i].astype(np.min_scalar_type(rows[i].max())).tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], ["part", "counts"])

    return run


def _slot_levels(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(part, np.zeros(PART, np.int64))
                total[part] += np.frombuffer(packed, f"u{len(packed) // PART}").astype(np.int64)
        levels = [np.ceil(4 * np.log2(np.maximum(x, least) / least)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    return run


def slot_levels(words: DataFrame, bits: int, hot_texts: int) -> np.ndarray:
    """For each of the 2 ** ``bits`` slots how frequent its words are: 0 up to ``hot_texts`` in all texts, 4 more with each doubling.

    ``words`` has one column, arrays of words. Every word is counted: a task adds its
    own up in one array, and the tasks' arrays are added up part by part.
    """
    counted = words.mapInArrow(_slot_counts(bits), "part int, counts binary").repartition("part")
    levels = np.zeros(((1 << bits) // PART, PART), np.uint8)
    for part, packed in counted.mapInArrow(_slot_levels(max(1, hot_texts)), "part int, levels binary").collect():
        levels[part] = np.frombuffer(packed, np.uint8)
    return levels.ravel()


def _first_words(levels: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                words, spans = part.column("words"), part.column("spans")
                lengths, needs = spans.flatten().to_numpy().reshape(-1, 2).T.astype(np.int64)
                span = np.repeat(np.arange(len(lengths)), lengths)
                # words are sorted within a span, so this order is one of levels and words, for all texts alike
                order = np.argsort(span * 256 + levels[_slots_of(words, bits)], kind="stable")
                rank = np.arange(len(span)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                chosen = rank < needs[span]
                word = words.flatten().to_numpy()[order][chosen]
                owner = span[chosen] // (len(lengths) // part.num_rows)
                names = part.schema.names[:-2]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), _lists(owner, word, part.num_rows)], [*names, "sketch"])

    return run


def signatures(
    texts: DataFrame, width: int, threshold: float, min_words: int, *, hot_texts: int = 16, by_sketch: bool = False
) -> DataFrame:
    """(key, raw, text_hash, n_words, n_runs, parity, sketch) of every text of ``min_words`` words or more; ``texts`` has key, text and raw, a hash of the text.

    ``sketch``: the words a text emits, as many as the pigeonhole needs, words of slots of more
    than ``hot_texts`` words of all texts last. The words of all texts are written once,
    counted, and the first ones taken; the order is common to all texts, so no
    counts can lose a pair.
    """
    schema = "key long, raw long, text_hash long, n_words int, n_runs int, parity array<long>"
    whole = texts.mapInArrow(_all_words(Sketcher(width, threshold, min_words, by_sketch)), f"{schema}, words array<long>, spans array<int>")
    whole = stage(whole, "words", {"total": F.sum(F.size("words"))})
    bits = min(max(int(metrics_of(whole)["total"] or 0).bit_length(), PART.bit_length() - 1), MOST_SLOT_BITS)
    levels = slot_levels(whole.select("words"), bits, hot_texts)
    signed = stage(whole.mapInArrow(_first_words(levels, bits), f"{schema}, sketch array<long>"), "signatures")
    drop_stage(whole)
    return signed


def shared_words(signed: DataFrame, hot_rows: int = HOT_ROWS, hash_slots: int = 4_096) -> DataFrame:
    """Distinct (word, text_hash, _n) of the words that ``_n`` > 1 different texts emit, whatever the skew of the words.

    Words are first counted by slots of a hash, by partial aggregates. The rows of
    slots of at most ``hot_rows`` rows meet once by word. Those of the others, where a
    frequent word may be, are never gathered: their words are counted by partial
    aggregates and the frequent ones joined back as ``join_hot`` does. The slots grow with
    the rows, the hot ones are at most a 250th of them.
    """
    rows = signed.select(F.explode("sketch").alias("word"), "text_hash")
    total = signed.agg(F.sum(F.size("sketch"))).first()[0] or 0
    slots = int(min(max(hash_slots, total // 1_000), 1 << 22))
    least = max(hot_rows, 4 * total // slots)
    slot = F.pmod(F.xxhash64("word"), F.lit(slots)).cast("int")
    hot = stage(rows.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > least).select("_slot"), "hot")
    count = F.count(F.lit(1)).over(Window.partitionBy("word"))
    if hot.isEmpty():
        # one exchange serves both the distinct rows and their number per word
        met = rows.repartition(F.col("word")).dropDuplicates(["word", "text_hash"])
        return met.withColumn("_n", count).where("_n > 1")
    slotted, few = rows.withColumn("_slot", slot), F.broadcast(hot)  # rows / least of them, at most a million
    cold = slotted.join(few, "_slot", "left_anti").drop("_slot").repartition(F.col("word")).dropDuplicates(["word", "text_hash"])
    warm = stage(slotted.join(few, "_slot").drop("_slot").distinct(), "warm")
    sizes = stage(warm.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("n", F.col("_n")), "sizes")
    met = join_hot(warm, sizes, "word", hot_rows, MAX_HOT).withColumnRenamed("n", "_n")
    return cold.withColumn("_n", count).where("_n > 1").unionByName(met)


def candidates(signed: DataFrame, threshold: float, block: int = 1_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct (hash_a, hash_b), hash_a < hash_b, of different texts that share an emitted word and may be similar enough.

    Sizes and parity bits leave out pairs that can't be. A word of more than
    ``block`` texts is split into blocks, and each pair of blocks is a join key of
    its own, so no task ever holds all texts of a word.
    """
    sized = shared_words(signed, hot_rows)
    texts = signed.groupBy("text_hash").agg(
        F.max("n_runs").alias("n"), *(F.max(F.col("parity")[i]).alias(f"p{i}") for i in range(BITS // 64))
    )
    blocks = F.ceil(F.col("_n") / block).cast("int")
    sized = sized.withColumn("_b", F.pmod(F.xxhash64("text_hash"), blocks)).withColumn("_k", blocks)
    other = F.sequence(F.lit(0), F.col("_k") - 1)
    pair = F.transform(other, lambda j: F.least(F.col("_b"), j) * F.col("_k") + F.greatest(F.col("_b"), j))
    keyed = sized.join(texts, "text_hash").withColumn("_p", F.explode(pair)).withColumn("_w", F.xxhash64("word", "_p"))
    keyed = keyed.select("_w", "text_hash", "n", *(f"p{i}" for i in range(BITS // 64)))
    distance = " + ".join(f"bit_count(l.p{i} ^ r.p{i})" for i in range(BITS // 64))
    near = (
        f"l.text_hash < r.text_hash AND least(l.n, r.n) >= {threshold} * greatest(l.n, r.n) - 1e-6"
        f" AND ({distance}) * {1 + threshold} <= {1 - threshold} * (l.n + r.n) + 1e-6"
    )
    joined = keyed.alias("l").join(keyed.alias("r"), "_w").where(near)
    return joined.select(F.col("l.text_hash").alias("hash_a"), F.col("r.text_hash").alias("hash_b")).distinct()


def _verify(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                n = part.num_rows
                texts = part.column(2).to_pylist() + part.column(3).to_pylist()
                owner, value = distinct_runs(*word_hashes(map(words_of, texts)), width)
                size = np.bincount(owner, minlength=2 * n)
                pair = owner % n
                order = np.lexsort((value, pair))
                p, v = pair[order], value[order]
                both = np.bincount(p[1:][(p[1:] == p[:-1]) & (v[1:] == v[:-1])], minlength=n)
                union = size[:n] + size[n:] - both
                similarity = both / np.maximum(union, 1)
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similarity)], ["hash_a", "hash_b", "similarity"])
                yield out.filter(pa.array(both * 1000 >= union * round(threshold * 1000)))

    return run


def near_duplicate_pairs(
    texts: DataFrame, *, width: int = 5, threshold: float = 0.8, min_words: int = 20, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of near-duplicate texts; ``texts`` has columns key (long) and text.

    ``pairs``: hash_a < hash_b, similarity, of classes of texts with different words
    whose sets of ``width``-word runs have a Jaccard similarity of ``threshold``
    (counted in thousandths) or more. ``members``: key, text_hash, n_words of every
    text of ``min_words`` words or more; texts of the same words share text_hash, so
    a class of copies is one member of the pairs however large it is.

    No pair can be missed. ``exact``: by the words of sketches rather than by runs, which
    takes longer and finds the same pairs.

    Texts of fewer than ``width`` words have no runs, but copies. With ``min_words`` 0
    texts without words are members too: as copies of texts equal to them, or, if
    blank, each as a class of its own.

    Defined cases: null, empty and shorter texts are left out; a key that comes
    twice with the same text counts once, one that comes with several texts is a
    member of each one's class; other columns are ignored; an empty table gives no rows.
    """
    rows = texts.select(F.col("key").cast("long"), F.col("text").cast("string")).where("key IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("raw", F.xxhash64("text"))
    with shuffles_released(texts.sparkSession):
        signed = signatures(rows, width, threshold, min_words, by_sketch=exact)
        members = stage(signed.select("key", "raw", "text_hash", "n_words").distinct(), "members")
        found = stage(candidates(signed, threshold), "candidates")
        drop_stage(signed)
        # one text stands for each class; only texts of candidates are fetched
        ends = found.select(F.explode(F.array("hash_a", "hash_b")).alias("text_hash")).distinct()
        speakers = members.groupBy("text_hash").agg(F.min(F.struct("key", "raw")).alias("s")).select("text_hash", "s.key", "s.raw").join(ends, "text_hash", "left_semi")
        spoken = rows.join(speakers, ["key", "raw"]).dropDuplicates(["text_hash"])
        fetched = found.join(spoken.select(F.col("text_hash").alias("hash_a"), F.col("text").alias("text_a")), "hash_a")
        fetched = fetched.join(spoken.select(F.col("text_hash").alias("hash_b"), F.col("text").alias("text_b")), "hash_b")
        pairs = fetched.select("hash_a", "hash_b", "text_a", "text_b").mapInArrow(
            _verify(width, threshold), "hash_a long, hash_b long, similarity double"
        )
        near = stage(pairs, "pairs")
    return near, members.select("key", "text_hash", "n_words").distinct()


def near_duplicate_classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, class_id, copies, links): class_id is the smallest key of all texts linked to this one.

    ``copies``: other texts of the same words; ``links``: classes of other words that
    this text is a near-duplicate of.
    """
    classes = stage(members.groupBy("text_hash").agg(F.min("key").alias("speaker"), F.count(F.lit(1)).alias("n")), "classes")
    a = classes.select(F.col("text_hash").alias("hash_a"), F.col("speaker").alias("src"))
    b = classes.select(F.col("text_hash").alias("hash_b"), F.col("speaker").alias("dst"))
    edges = stage(pairs.join(a, "hash_a").join(b, "hash_b").select("src", "dst"), "links")
    linked = edges.selectExpr("explode(array(src, dst)) AS speaker").groupBy("speaker").agg(F.count(F.lit(1)).alias("links"))
    parts = connected_components(edges).withColumnRenamed("node", "speaker")
    named = classes.join(parts, "speaker", "left").join(linked, "speaker", "left")
    named = named.select(
        "text_hash", F.col("n").alias("_n"), F.coalesce("component", "speaker").alias("class_id"), (F.col("n") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links")
    )
    return join_hot(members.select("key", "text_hash"), named, "text_hash", HOT_ROWS, MAX_HOT).drop("text_hash")


def expand_pairs(pairs: DataFrame, members: DataFrame, most_copies: int = 1_000) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of all near-duplicate texts, copies included.

    Classes of up to ``most_copies`` copies are written out pair by pair. In a larger
    one every copy is paired with the class's smallest key, which then stands for the
    class in pairs with other classes: every link between different texts remains,
    and the rows stay in proportion to the texts.
    """
    sizes = members.groupBy("text_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("first"))
    sizes = stage(sizes.withColumn("n", F.col("_n")), "sizes")
    sized = stage(join_hot(members.select("key", "text_hash"), sizes, "text_hash", HOT_ROWS, MAX_HOT), "members")
    shown = sized.where((F.col("n") <= most_copies) | (F.col("key") == F.col("first")))
    one = shown.select(F.col("text_hash").alias("hash_a"), F.col("key").alias("x"))
    two = shown.select(F.col("text_hash").alias("hash_b"), F.col("key").alias("y"))
    near = pairs.join(one, "hash_a").join(two, "hash_b").select("x", "y")
    small = sized.where((F.col("n") > 1) & (F.col("n") <= most_copies))
    copies = small.alias("l").join(small.alias("r"), "text_hash").where("l.key < r.key")
    copies = copies.select(F.col("l.key").alias("x"), F.col("r.key").alias("y"))
    large = sized.where((F.col("n") > most_copies) & (F.col("key") != F.col("first"))).select(F.col("first").alias("x"), F.col("key").alias("y"))
    both = near.unionByName(copies).unionByName(large)
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
