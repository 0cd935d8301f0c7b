"""Words, q-grams and windows of whole Arrow batches as arrays; spans to remove; suffix automata of references."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .arrow import pieces

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at once.
PIECE = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def portions(texts: list[bytes]):
    """Runs of texts of about PIECE bytes together, as (index of the first, texts); a text is never cut."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the number of words before each text (with the total at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64)))
    hashes = mix64((summed[ends] - summed[starts]) * powers(INVERSE, len(data) + 1)[starts])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(STEP, len(words)), dtype=np.uint64)))
    return mix64((summed[n:] - summed[:-n]) * powers(BACK, len(words))[: len(words) - n + 1])


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of every n neighbours, by doubling."""
    done, y = 1, x
    while 2 * done <= n:
        y = best(y[:-done], y[done:])
        done *= 2
    return best(y[: len(y) - (n - done)], y[n - done :]) if n > done else y


def window_starts(bounds: np.ndarray, window: int) -> np.ndarray:
    """Whether a window that starts at each word stays inside its text."""
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(bounds[-1])
    return left >= window


def anchors(words: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the least q-gram of each window. Equal windows have their anchors at equal places."""
    grams = gram_hashes(words, gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lows = sliding(grams, span, np.minimum)
    lows = np.where(window_starts(bounds, window)[: len(lows)], lows, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    top = sliding(np.concatenate((pad, lows, pad)), span, np.maximum)
    at = np.flatnonzero((top == grams) & (top != 0))
    return at, grams[at]


def as_bytes(column) -> list[bytes]:
    return [(v.as_py() or "").encode() for v in column]


def anchor_batches(window: int, gram: int):
    """Columns in: k1, k2, text. Out: the same keys, the places and hashes of the text's anchors (one row a text with any)."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in pieces(batches):
                texts = as_bytes(batch.column("text"))
                for first, some in portions(texts):
                    words, bounds = word_hashes(some)
                    at, hashes = anchors(words, bounds, window, gram)
                    owner = np.searchsorted(bounds, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(pa.array(owner + first)), batch.column("k2").take(pa.array(owner + first)),
                         pa.array((at - bounds[owner]).astype(np.int32)), pa.array(hashes.view(np.int64))],
                        ["k1", "k2", "at", "anchor"],
                    )

    return run


def window_batches(window: int, gram: int):
    """Columns in: k1, k2, text, places of the text's repeated anchors. Out: place and hash of each window that holds one."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in pieces(batches):
                texts = as_bytes(batch.column("text"))
                places = batch.column("places")
                for first, some in portions(texts):
                    words, bounds = word_hashes(some)
                    marks = np.zeros(bounds[-1] + 1, np.int64)
                    for i in range(len(some)):
                        at = np.asarray(places[first + i].as_py(), dtype=np.int64)
                        np.add.at(marks, np.maximum(at - (window - gram), 0) + bounds[i], 1)
                        np.add.at(marks, at + 1 + bounds[i], -1)
                    starts = np.flatnonzero((np.cumsum(marks)[:-1] > 0) & window_starts(bounds, window))
                    hashes = gram_hashes(words, window)[starts] if len(starts) else np.zeros(0, np.uint64)
                    owner = np.searchsorted(bounds, starts, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(pa.array(owner + first)), batch.column("k2").take(pa.array(owner + first)),
                         pa.array((starts - bounds[owner]).astype(np.int32)), pa.array(hashes.view(np.int64))],
                        ["k1", "k2", "at", "hash"],
                    )

    return run


def run_batches(window: int):
    """Columns in: k1, k2, starts of the text's repeated windows. Out: the words to remove as packed runs (start, end)."""

    def run(batches):
        for batch in pieces(batches):
            out = []
            for value in batch.column("starts"):
                at = np.unique(np.asarray(value.as_py(), dtype=np.int64))
                new = np.concatenate(([True], at[1:] > at[:-1] + window))
                last = np.concatenate((at[np.flatnonzero(new)[1:] - 1], at[-1:])) + window
                out.append(np.stack((at[new], last), axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, pa.binary())], ["k1", "k2", "runs"])

    return run


def kept_batches(with_text: bool):
    """Columns in: doc_id, text, runs (or null). Out: doc_id, n_words, n_removed, kept text or its SHA-256."""

    def run(batches):
        for batch in pieces(batches):
            sizes, removed, kept = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                words = (text.as_py() or "").encode().split()
                sizes.append(len(words))
                if runs.is_valid:
                    rest, at = [], 0
                    for a, b in np.frombuffer(runs.as_py(), "<i4").reshape(-1, 2).tolist():
                        rest += words[at:a]
                        at = b
                    words = rest + words[at:]
                removed.append(sizes[-1] - len(words))
                joined = b" ".join(words)
                kept.append(joined.decode() if with_text else hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


class Automaton:
    """Suffix automaton of word sequences, each fed after a break so that no match spans two."""

    def __init__(self, sequences):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for n, words in enumerate(sequences):
            for w in [*words, ("break", n)]:
                last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.length[p] + 1 < self.length[q]:
                copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = copy
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
            else:
                self.link[new] = q
        return new

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def matches(self, words):
        """Matching statistics: for each word the length of the longest match that ends there."""
        at = size = 0
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if w in self.next[at]:
                at, size = self.next[at][w], size + 1
            yield size

    def spans(self, words, least: int) -> list[tuple[int, int]]:
        """Maximal runs of words that matches of ``least`` words or more cover."""
        out: list[list[int]] = []
        for i, size in enumerate(self.matches(words)):
            if size >= least:
                a = i + 1 - size
                while out and out[-1][1] >= a:
                    a = min(a, out.pop()[0])
                out.append([a, i + 1])
        return [tuple(x) for x in out]
