"""Scores of abusive, hateful or sexually explicit content.

A document's score is the largest probability that the convolutional classifier
gives one of its sentences; it is flagged if that reaches the threshold of the
sentence's language. Spellings meant to hide a word (letters doubled, parted, masked
or replaced by digits and look-alikes) are undone first, as far as a known word
comes out.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.abuse_lines import LANGUAGES, lines
from pagesift.llm.convnet import ConvNet
from pagesift.llm.words import INLINE_TAG, INVISIBLE, TAG, mix
from pagesift.plans.names import without

#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans(
    "авеіјкмнорсѕтухһԁԛԝгп" + "αβεικνορτυχ" + "ıƖɡɩ",
    "abeijkmhopcstyxhdqwrn" + "abeiknoptux" + "ilgi",
)
#: Digits and signs that stand for letters.
LEET = str.maketrans("013457@$!|+89", "oieastasilt" + "bg")

_PARTED = re.compile(r"(?<![^\W_])[^\W_](?:(?P<s>[ .\-_*·]{1,3})[^\W_])(?:(?P=s)[^\W_])+(?![^\W_])")
_TOKEN = re.compile(r"[^\W_][^\W_*@$!|+']*(?:[*@$!|+]+[^\W_]+)*\**(?=[^\w]|$)|[*]+[^\W_]+|[^\W_]+")
_END = re.compile(r"[.!?…;]+(?=\s|$)|[\n\r]+|:\)|(?<=\s)[-–—](?=\s)")
_STOP = "\n"
#: Words and ends of sentences in one pass: no word begins with a sign that an end has.
_MARKED = re.compile(f"(?:{_END.pattern})|(?:{_TOKEN.pattern})")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_MASK = re.compile(r"\*+")
_STRETCHED = re.compile(r"(.)\1{2,}", re.S)


def fold(text: str) -> str:
    """Lower case, without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _latin(word: str) -> str:
    """A word that mixes alphabets, or has look-alikes only, in Latin letters."""
    if word.isascii():
        return word
    turned = word.translate(LOOKALIKES)
    return turned if turned.isascii() else word


class Speller:
    """Undoes hidden spellings of ``known`` words; ``weight`` prefers the more telling of several."""

    def __init__(self, weight: dict[str, float]):
        self.weight = weight
        self.by_length: dict[int, list[str]] = {}
        for word in sorted(weight, key=lambda w: -weight[w]):
            if weight[word] > 0 and len(word) > 2:
                self.by_length.setdefault(len(word), []).append(word)
        self.cache: dict[str, str] = {}

    def __call__(self, token: str) -> str:
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = self.cache[token] = self._spell(token)
        return found

    def _spell(self, token: str) -> str:
        if len(token) > 40:
            return self._stretched(token) or "#long"
        word = _latin(token)
        if word.isdigit():
            return "#number"
        if word in self.weight:
            return word
        if "*" in word:
            return self._unmask(word)
        if any(c.isalpha() for c in word) and not word.isalpha():
            for changed in (word.translate(LEET), word.replace("1", "l").translate(LEET)):
                if self._known(changed):
                    return self._known(changed)
            if any(c.isdigit() for c in word):
                return "#mixed"
        return self._known(word) or _REPEAT.sub(r"\1", word)

    def _stretched(self, token: str) -> str | None:
        """The known word that a token of more than 40 characters stretches, if any."""
        if len(_STRETCHED.sub(r"\1\1", token)) > 40:
            return None
        word = _latin(token)
        for changed in (word, word.translate(LEET), word.replace("1", "l").translate(LEET)):
            found = self._known(changed)
            if found:
                return found
        if "*" in word:
            found = self._unmask(_REPEAT.sub(r"\1", word))
            return None if found == "#masked" else found
        return None

    def _known(self, word: str) -> str | None:
        for changed in (word, _REPEAT.sub(r"\1", word), _REPEAT.sub(r"\1\1", word)):
            if changed in self.weight:
                return changed
        return None

    def _unmask(self, word: str) -> str:
        pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in word))
        for known in self.by_length.get(len(word), ()):
            if pattern.fullmatch(known):
                return known
        loose = re.compile(".+".join(re.escape(p) for p in _MASK.split(word)))
        if sum(c != "*" for c in word) >= 2:
            for n in sorted(self.by_length):
                for known in self.by_length[n]:
                    if loose.fullmatch(known):
                        return known
        return "#masked"


def prepared(text: str) -> str:
    """A text, or light HTML, without tags, entities and invisible signs and with parted words joined."""
    if "<" in text:
        text = TAG.sub("\n", INLINE_TAG.sub("", text))
    if "&" in text:
        import html

        text = html.unescape(text)
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)) if not text.isascii() else text
    return _PARTED.sub(lambda m: "".join(c for c in m.group() if c.isalnum()), text)


def sentences(text: str) -> list[str]:
    """Sentences of a text."""
    return [s for s in _END.split(prepared(text)) if s and not s.isspace()]


def tokens(sentence: str, speller: Speller | None) -> list[str]:
    """Words of a sentence as the classifier sees them."""
    words = [fold(_latin(w.lower())) for w in _TOKEN.findall(sentence)]
    return [speller(w) for w in words] if speller else words


#: Frequent words that tell the languages apart.
_COMMON = {
    "en": "the a an of and to in is that for with you are this has will at by from near your all they have i",
    "de": "der die das und ist ein eine nicht mit auf den im du sind nach seit fur vor ich zum",
    "fr": "le la les un une des est et dans pour du au avec sont sur ta sans depuis en vous",
    "es": "el la los las un una es y en de que con por para tu del son hay su sin",
    "pt": "o a os as um uma e em de que com por para seu sua do da sao no na pelo sem",
}
_LANG_OF: dict[str, list[str]] = {}
for _lang, _list in _COMMON.items():
    for _w in _list.split():
        _LANG_OF.setdefault(_w, []).append(_lang)


def language(words: list[str]) -> str:
    """The language most of whose frequent words occur; English if none does."""
    votes: Counter = Counter()
    for w in words:
        for lang in _LANG_OF.get(w, ()):
            votes[lang] += 1 / len(_LANG_OF[w])
    return max(LANGUAGES, key=lambda x: (votes[x], x == "en")) if votes else "en"


class _Ids(dict):
    """The net's id of each word as written, -1 for the end of a sentence, worked out once; emptied before it grows large."""

    def __init__(self, model: Classifier):
        self.model = model

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = self.model.net.ids([self.model.spell(word)])[0] if word[0] == "*" or word[0].isalnum() else -1
        return found


@dataclass
class Classifier:
    """Net, spelling and thresholds by language."""

    net: ConvNet
    speller: Speller
    thresholds: dict[str, float]

    #: A sentence of more words is read in parts that share the words between the two numbers, so all of it is read.
    PART, STEP = 128, 120

    def __post_init__(self):
        self._known, self._answers = _Ids(self), None

    def __getstate__(self):
        return {"net": self.net, "speller": self.speller, "thresholds": self.thresholds}

    def __setstate__(self, state: dict):
        self.__dict__.update(state)
        self.__post_init__()

    def spell(self, word: str) -> str:
        return self.speller(fold(_latin(word.lower())))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score, score over the threshold of its sentence's language) of each text; 0 for texts without words.

        The words of all texts lie in one row, with a mark after each sentence. Unknown
        words are alike to the net, so many sentences are the same row of ids, which is
        judged once. The language matters only near the thresholds.
        """
        raw: list[str] = []
        upto = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                raw += _MARKED.findall(prepared(text))
                raw.append(_STOP)
            upto[i + 1] = len(raw)
        ids = np.fromiter(map(self._known.__getitem__, raw), np.int64, len(raw))
        stops = np.flatnonzero(ids < 0)
        begin = np.r_[0, stops[:-1] + 1] if len(stops) else stops
        begin, length = self._parts(begin, stops - begin)
        best, over = np.zeros(len(texts)), np.zeros(len(texts))
        if not len(begin):
            return best, over
        take = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
        flat, at = ids[take], np.cumsum(length) - length
        place = (take - np.repeat(begin, length)).astype(np.uint64)
        mark = np.add.reduceat(mix(mix(flat.astype(np.uint64) + (place << np.uint64(32)))), at) + length.astype(np.uint64)
        _, one, which = np.unique(mark, return_index=True, return_inverse=True)
        n = length[one]
        rows = flat[np.arange(n.sum()) + np.repeat(at[one] - (np.cumsum(n) - n), n)]
        if self._answers is None:
            self._answers = self.net._answers()
        p = self.net.predict_flat(rows, n, answers=self._answers)[which]
        limit = np.full(len(p), max(self.thresholds.values(), default=1.0))
        for j in np.flatnonzero(p >= min(self.thresholds.values(), default=1.0)).tolist():
            limit[j] = self.thresholds[language([self.spell(w) for w in raw[begin[j] : begin[j] + length[j]]])]
        owner = np.searchsorted(upto, begin, side="right") - 1
        np.maximum.at(best, owner, p)
        np.maximum.at(over, owner, p / limit)
        return best, over

    def _parts(self, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of the parts of all sentences that have words."""
        begin, length = begin[length > 0], length[length > 0]
        long = np.flatnonzero(length > self.PART)
        if not len(long):
            return begin, length
        parts = np.ones(len(begin), np.int64)
        parts[long] = -(-(length[long] - (self.PART - self.STEP)) // self.STEP)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, length = np.repeat(begin, parts) + nth * self.STEP, np.repeat(length, parts) - nth * self.STEP
        return begin, np.minimum(length, self.PART)


def _word_weights(data: list[tuple[list[str], int]]) -> dict[str, float]:
    """Log odds of each training word to be in an abusive line."""
    good, bad = Counter(), Counter()
    for words, label in data:
        (bad if label else good).update(set(words))
    return {w: float(np.log((bad[w] + 0.5) / (good[w] + 0.5))) for w in sorted(good.keys() | bad.keys())}


def _pieces(calm: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
    """Pieces of one to four words of some harmless sentences: lines of a text may break anywhere."""
    out = []
    for words in calm:
        if len(words) > 1 and rng.random() < 0.4:
            n = int(rng.integers(1, 5))
            at = int(rng.integers(0, max(len(words) - n, 0) + 1))
            out.append(words[at : at + n])
    return out


def fit(presumed: list[str], *, count: int = 16_000, epochs: int = 5, rounds: int = 6, average: int = 4, seed: int = 11, leave: tuple[int, int] | None = None) -> Classifier:
    """Train on ``count`` written lines and on ``presumed``, sentences of the corpus that are taken as harmless unless the fit so far thinks otherwise.

    The thresholds are calibrated per language on lines left out of the training:
    between the scores of nearly all harmless and of nearly all abusive ones.
    ``leave``: (i, n) leaves out every n-th pattern from the i-th on, for ``held_out``.
    """
    rng = np.random.default_rng(seed)
    written = [(tokens(t, None), y, lang) for t, y, lang in lines(count, seed, leave)]
    cut = int(0.9 * len(written))
    order = list(range(len(written)))
    random.Random(seed).shuffle(order)
    written = [written[i] for i in order]
    speller = Speller(_word_weights([(w, y) for w, y, _ in written]))
    digits = lambda ws: [speller(w) for w in ws]
    own = [digits(w) for w, _, _ in written]
    labels = np.array([y for _, y, _ in written], np.float32)
    net = ConvNet()
    others = [tokens(s, speller) for s in presumed]
    net.start([*own, *others], rng)
    ids, other_ids = [net.ids(w) for w in own], [net.ids(w) for w in others if w]
    common = 4 * [net.ids([w]) for text in _COMMON.values() for w in text.split()]
    first = ids[:cut] + common
    net.train(first, np.r_[labels[:cut], np.zeros(len(common), np.float32)], epochs=epochs, rng=rng)
    held: list[dict[str, np.ndarray]] = []
    for _ in range(rounds if other_ids else 0):
        calm = [x for x, p in zip(other_ids, net.predict(other_ids), strict=True) if p < 0.8]
        calm = calm + _pieces(calm, rng) + common
        both = ids[:cut] + calm
        net.train(both, np.r_[labels[:cut], np.zeros(len(calm), np.float32)], epochs=1, rng=rng, rate=1e-3)
        held = [*held, {k: v.copy() for k, v in net.w.items()}][-average:]
    if held:  # the mean of the last rounds' weights depends less on where the last one stopped
        net.w = {k: np.mean([w[k] for w in held], axis=0, dtype=np.float32) for k in net.w}
    p = net.predict(ids[cut:])
    thresholds = {}
    for lang in LANGUAGES:
        mine = np.array([x == lang for _, _, x in written[cut:]])
        good, bad = p[mine & (labels[cut:] == 0)], p[mine & (labels[cut:] == 1)]
        if len(good) and len(bad):
            thresholds[lang] = float(np.clip((np.quantile(good, 0.98) + 2 * np.quantile(bad, 0.05)) / 3, 0.3, 0.8))
        else:
            thresholds[lang] = 0.5
    return Classifier(net, speller, thresholds)


def held_out(parts: int = 5, *, count: int = 3_000, seed: int = 999, presumed: list[str] | None = None) -> dict[str, tuple[int, int, int, int]]:
    """(abusive lines, those of them flagged, harmless lines, those of them flagged) of each language, of patterns the training never saw.

    Every pattern is left out once: the classifier is fitted ``parts`` times, each time
    without a part of the patterns, and judges lines of these alone.
    """
    out = dict.fromkeys(LANGUAGES, (0, 0, 0, 0))
    for i in range(parts):
        model = fit(presumed or [], leave=(i, parts))
        held = [x for x in lines(count, seed, (i, parts), True)]
        flagged = model.score([t for t, _, _ in held])[1] >= 1
        for lang in LANGUAGES:
            mine = [(y, bool(f)) for (_, y, x), f in zip(held, flagged, strict=True) if x == lang]
            now = (sum(y for y, _ in mine), sum(y and f for y, f in mine), sum(not y for y, _ in mine), sum(f and not y for y, f in mine))
            out[lang] = tuple(a + b for a, b in zip(out[lang], now, strict=True))
    return out


def _parts_of(sentence: str) -> list[str]:
    """A sentence in parts of at most ``Classifier.PART`` words, as it is read when it is scored."""
    words = _TOKEN.findall(sentence)
    if len(words) <= Classifier.PART and len(sentence) <= 2_000:
        return [sentence]
    # a word that stays longer than 40 letters with its repeats taken out is an unknown long one, whatever follows
    words = [w if len(w) <= 200 else _STRETCHED.sub(r"\1\1", w)[:200] for w in words]
    return [" ".join(words[at : at + Classifier.PART]) for at in range(0, max(len(words) - 8, 1), Classifier.STEP)]


def _sample(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = (part for t in batch.column(0).to_pylist() if t for s in sentences(t) for part in _parts_of(s))
            yield pa.RecordBatch.from_arrays([pa.array([s for s in every if random.Random(s).random() < share], pa.string())], ["sentence"])

    return run


def sample_sentences(texts: DataFrame, *, documents: int = 6_000, most: int = 20_000) -> list[str]:
    """At most ``most`` different sentences of about ``documents`` texts, chosen by hash; the same for the same texts.

    A long sentence is sampled in the parts in which it is scored.
    """
    total = texts.count()
    share = min(1.0, documents / max(total, 1))
    picked = texts.where("text IS NOT NULL").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = picked.select("text").mapInArrow(_sample(0.4), "sentence string").distinct()
    rows = rows.orderBy(F.xxhash64("sentence"), "sentence").limit(most)
    return [r[0] for r in rows.collect()]


def score_texts(texts: DataFrame, model: Classifier) -> DataFrame:
    """``texts`` (with column text) and its score, 0..1, and ``flagged``.

    Defined cases: null, empty and wordless texts score 0 and aren't flagged; the
    whole text is read, however long; equal texts have equal scores; other columns
    pass through, but ones named score or flagged are replaced.
    """
    texts = texts.select(*without(texts.columns, "score", "flagged"))
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded: words of the training sample
    schema = texts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            best, over = own.score(batch.column(at).to_pylist())
            columns = [*batch.columns, pa.array(best), pa.array(over >= 1)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "flagged"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", score double, flagged boolean"
    return texts.mapInArrow(run, out)
