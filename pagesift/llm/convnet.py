"""A convolutional text classifier in numpy.

Words are hashed to embeddings, filters of several widths slide over a sentence,
each filter keeps its largest answer, and two dense layers turn these into a
probability. Sentences of a batch lie end to end in one stream, parted by gaps as
wide as the widest filter, so no padding to a common length is needed.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import xxhash


def bucket(word: str, bits: int) -> int:
    """The hash bucket of a word; 0 is kept for gaps and unknown words."""
    return 1 + xxhash.xxh3_64_intdigest(word) % ((1 << bits) - 1)


@dataclass
class ConvNet:
    """Weights; only buckets of training words have an embedding, all others are zero."""

    bits: int = 24
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3, 4)
    filters: int = 24
    hidden: int = 24
    rows: dict[int, int] = field(default_factory=dict)  # bucket -> row of the embeddings
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def gap(self) -> int:
        return max(self.widths) - 1

    def ids(self, words: list[str]) -> list[int]:
        get = self.rows.get
        return [get(bucket(x, self.bits), 0) for x in words]

    def start(self, sentences: list[list[str]], rng: np.random.Generator, least: int = 3) -> None:
        """New weights; words of fewer than ``least`` sentences stay unknown."""
        seen = Counter(bucket(x, self.bits) for words in sentences for x in set(words))
        for b, n in sorted(seen.items()):  # else the order of a set would number them
            if n >= least:
                self.rows[b] = len(self.rows) + 1
        n = len(self.rows) + 1
        self.w["e"] = (rng.normal(0, 0.3, (n, self.size))).astype(np.float32)
        self.w["e"][0] = 0
        for k in self.widths:
            self.w[f"f{k}"] = rng.normal(0, (2 / (k * self.size)) ** 0.5, (k * self.size, self.filters)).astype(np.float32)
            self.w[f"b{k}"] = np.zeros(self.filters, np.float32)
        m = len(self.widths) * self.filters
        self.w["h"] = rng.normal(0, (2 / m) ** 0.5, (m, self.hidden)).astype(np.float32)
        self.w["c"] = np.zeros(self.hidden, np.float32)
        self.w["o"] = rng.normal(0, (2 / self.hidden) ** 0.5, self.hidden).astype(np.float32)
        self.w["d"] = np.zeros(1, np.float32)

    def stream(self, batch: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row with gaps before, between and after; start of each sentence's gap)."""
        flat = np.fromiter(chain.from_iterable(batch), np.int64)
        return self.spaced(flat, np.fromiter(map(len, batch), np.int64, len(batch)))

    def spaced(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``stream``, of sentences that lie end to end."""
        gap = self.gap
        starts = np.cumsum(lengths + gap) - lengths - gap
        ids = np.zeros(len(flat) + gap * (len(lengths) + 1), np.int64)
        ids[np.arange(len(flat)) + gap * (1 + np.repeat(np.arange(len(lengths)), lengths))] = flat
        return ids, starts

    def _filters(self) -> tuple[np.ndarray, np.ndarray]:
        """All filters as ones of the widest width, zero where they don't reach, and their offsets."""
        widest = max(self.widths)
        f = np.zeros((widest * self.size, len(self.widths) * self.filters), self.w["e"].dtype)
        for i, k in enumerate(self.widths):
            f[(widest - k) * self.size :, i * self.filters : (i + 1) * self.filters] = self.w[f"f{k}"]
        return f, np.concatenate([self.w[f"b{k}"] for k in self.widths])

    def forward(self, ids: np.ndarray, starts: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of the sentences of a stream."""
        e, (f, offsets), n = self.w["e"][ids], self._filters(), len(ids) - self.gap
        # a window ends at each place of the sentence or of the gap after it
        view = np.lib.stride_tricks.sliding_window_view(e, max(self.widths), axis=0).transpose(0, 2, 1).reshape(n, -1)
        answer = view @ f + offsets
        top = np.maximum.reduceat(answer, starts, axis=0)
        if keep is not None:
            keep["view"], keep["answer"], keep["top"], keep["f"] = view, answer, top, f
        return self._dense(top, keep)

    def _dense(self, top: np.ndarray, keep: dict | None = None) -> np.ndarray:
        t = np.maximum(top, 0)
        h = np.maximum(t @ self.w["h"] + self.w["c"], 0)
        if keep is not None:
            keep["t"], keep["hid"] = t, h
        return h @ self.w["o"] + self.w["d"][0]

    def _answers(self) -> list[np.ndarray]:
        """For each distance from a window's end, what each known word there adds to the filters that reach so far."""
        widest, size = max(self.widths), self.size
        f, offsets = self._filters()
        out = []
        for d in range(widest):
            reach = sum(k <= d for k in self.widths) * self.filters  # widths rise
            out.append(self.w["e"] @ f[(widest - 1 - d) * size : (widest - d) * size, reach:])
        out[0] = out[0] + offsets
        return out

    def predict(self, batch: list[list[int]]) -> np.ndarray:
        """Probabilities."""
        return self.predict_flat(np.fromiter(chain.from_iterable(batch), np.int64), np.fromiter(map(len, batch), np.int64, len(batch)))

    def predict_flat(self, flat: np.ndarray, lengths: np.ndarray, block: int = 20_000, answers: list[np.ndarray] | None = None) -> np.ndarray:
        """Probabilities of sentences that lie end to end; the filters' answers are sums of what each word adds, so nothing is multiplied."""
        tables = answers or self._answers()
        ends, out, i, gap = np.cumsum(lengths + self.gap), [], 0, self.gap
        cuts = np.cumsum(lengths)
        while i < len(lengths):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - lengths[i] - gap + block, side="right")))
            ids, starts = self.spaced(flat[cuts[i] - lengths[i] : cuts[j - 1]], lengths[i:j])
            n = len(ids) - gap
            answer = tables[0][ids[gap:]]
            for d in range(1, len(tables)):
                answer[:, -tables[d].shape[1] :] += tables[d][ids[gap - d : gap - d + n]]
            out.append(self._dense(np.maximum.reduceat(answer, starts, axis=0)))
            i = j
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, batch: list[list[int]], labels: np.ndarray, *, epochs: int, rng: np.random.Generator, rate: float = 2e-3, size: int = 128, drop: float = 0.1, decay: float = 1e-5) -> None:
        """Adam on the logistic loss; ``drop``: share of words hidden in each pass."""
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(batch))
            for at in range(0, len(order), size):
                part = order[at : at + size]
                ids, starts = self.stream([batch[i] for i in part])
                ids[rng.random(len(ids)) < drop] = 0
                keep: dict = {}
                z = self.forward(ids, starts, keep)
                y = labels[part]
                dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)).astype(np.float32)
                g = self._gradients(ids, starts, keep, dz)
                step += 1
                for k, grad in g.items():
                    grad = grad + decay * self.w[k]
                    m[k] += 0.1 * (grad - m[k])
                    v2[k] += 0.001 * (grad * grad - v2[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
                self.w["e"][0] = 0

    def _gradients(self, ids: np.ndarray, starts: np.ndarray, keep: dict, dz: np.ndarray) -> dict[str, np.ndarray]:
        g = {"o": keep["hid"].T @ dz, "d": np.array([dz.sum()], np.float32)}
        dh = dz[:, None] * self.w["o"] * (keep["hid"] > 0)
        g["h"], g["c"] = keep["t"].T @ dh, dh.sum(0)
        d = (dh @ self.w["h"].T) * (keep["top"] > 0)
        n, gap, widest = len(ids) - self.gap, self.gap, max(self.widths)
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        best = keep["answer"] == keep["top"][owner]
        d /= np.maximum(np.add.reduceat(best, starts, axis=0, dtype=np.int32), 1)  # ties share
        da = np.where(best, d[owner], 0).astype(keep["view"].dtype)
        df, db = keep["view"].T @ da, da.sum(0)
        for i, k in enumerate(self.widths):
            mine = slice(i * self.filters, (i + 1) * self.filters)
            g[f"f{k}"], g[f"b{k}"] = df[(widest - k) * self.size :, mine], db[mine]
        dv = (da @ keep["f"].T).reshape(n, widest, self.size)
        de = np.zeros((len(ids), self.size), dv.dtype)
        for j in range(widest):
            de[j : j + n] += dv[:, j]
        known = np.flatnonzero(ids)
        full = np.zeros_like(self.w["e"])
        np.add.at(full, ids[known], de[known])
        g["e"] = full
        return g
