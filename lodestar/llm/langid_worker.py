"""Unigram models over a fixed vocabulary, with all segmentations of a word summed by a forward pass over many words at once."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa

from .arrow import pieces

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Positions between rescalings, and words scored at once.
RESCALE, WORDS = 24, 1 << 15
#: Words times positions of a block at most: a block's arrays take some 100 bytes each.
CELLS = 1 << 17
#: Letters from which the E step sums logarithms.
NARROW = 40
BITS = 22
#: Words that fitting counts of one text: all of any text of up to 20,000 characters.
DOC_WORDS = 10_000


#: Letters of a word at most; a longer run counts as several words, so that one pass scores all of a text at once.
LONGEST = 256


def parts(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def words_of(text: str) -> list[str]:
    """Runs of letters of the lower-cased text, those of more than LONGEST letters in parts."""
    found = LETTERS.findall(text.lower())
    return found if not found or max(map(len, found)) <= LONGEST else [p for w in found for p in parts(w)]


def letters_only(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class Model:
    """``pieces`` are sorted by hash; ``prob[i, l]`` is the probability of piece i in language l; ``unknown`` that of any other character."""

    def __init__(self, pieces: list[str], langs: list[str]):
        codes = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
        keys = np.array([self.hash_one(c) for c in codes], np.uint64)
        order = np.argsort(keys)
        self.pieces = [pieces[i] for i in order]
        self.keys = keys[order]
        self.longest = max(map(len, pieces))
        self.langs = langs
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.keys >> np.uint64(64 - BITS)] = True
        self.prob = np.zeros((len(pieces) + 2, len(langs)))
        self.unknown = 1e-7

    @staticmethod
    def hash_one(codes) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in codes:
                h = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h

    def lattice(self, words: list[str]):
        """Blocks of words of like length: (their indexes, ids[word, start, size - 1]); no piece is id len(pieces)."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        none = len(self.pieces)
        at = 0
        while at < len(order):
            longest = len(words[order[min(at + WORDS, len(order)) - 1]]) + 1
            take = max(1, min(WORDS, CELLS // longest))
            block = order[at : at + take]
            at += take
            width = len(words[block[-1]]) + 1
            joined = "".join((MARK + words[i]).ljust(width, "\0") for i in block)
            codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(block), width).astype(np.uint64)
            ids = np.full((len(block), width, self.longest), none, np.int32)
            h = np.zeros(codes.shape, np.uint64)
            with np.errstate(over="ignore"):
                for size in range(min(self.longest, width)):
                    h = (h[:, : width - size] + codes[:, size:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                    maybe = np.flatnonzero(self.seen[h >> np.uint64(64 - BITS)])
                    flat = h.ravel()[maybe]
                    spot = np.searchsorted(self.keys, flat)
                    spot[spot == none] = 0
                    hit = self.keys[spot] == flat
                    part = ids[:, : width - size, size]
                    part[np.unravel_index(maybe[hit], part.shape)] = spot[hit]
            first = ids[:, :, 0]
            first[(first == none) & (codes != 0)] = none + 1
            yield np.array(block), np.array([len(words[i]) + 1 for i in block]), ids

    def tables(self) -> np.ndarray:
        table = self.prob.copy()
        table[-2] = 0
        table[-1] = self.unknown
        return table

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word) in each language, summed over all its segmentations into pieces."""
        out = np.zeros((len(words), len(self.langs)))
        table = self.tables()
        for block, sizes, ids in self.lattice(words):
            n, width, _ = ids.shape
            alpha = np.zeros((width + 1, n, len(self.langs)))
            alpha[0] = 1
            scale = np.zeros((n, len(self.langs)))
            for end in range(1, width + 1):
                for size in range(1, min(self.longest, end) + 1):
                    own = ids[:, end - size, size - 1]
                    rows = np.flatnonzero(own != len(self.pieces))
                    if len(rows):
                        alpha[end][rows] += alpha[end - size][rows] * table[own[rows]]
                done = np.flatnonzero(sizes == end)
                if len(done):
                    out[block[done]] = np.log(alpha[end][done]) + scale[done]
                if end % RESCALE == 0 and end < width:
                    live = np.maximum(alpha[end], 1e-300)
                    for back in range(min(self.longest, end + 1)):
                        alpha[end - back] /= live
                    scale += np.log(live)
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language: one E step, weights[word, language]."""
        fits = np.array([len(w) < NARROW for w in words], bool)
        short, long = np.flatnonzero(fits), np.flatnonzero(~fits)
        total = self._expected([words[i] for i in short], weights[short])
        return total + self._expected_scaled([words[i] for i in long], weights[long]) if len(long) else total

    def _expected_scaled(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """As `_expected`, for words whose probabilities are too small for a float: sums of logarithms."""
        logs = np.log(np.maximum(self.tables(), 1e-300))
        total = np.zeros_like(logs)
        for block, sizes, ids in self.lattice(words):
            n, width, _ = ids.shape
            # The forward and backward sums are exp(up) and exp(down); where there is none, "is" is 0.
            up, down = (np.zeros((width + 1, n, len(self.langs))) for _ in "ab")
            is_up, is_down = (np.zeros((width + 1, n), bool) for _ in "ab")
            is_up[0] = True
            is_down[sizes, np.arange(n)] = True

            def spans():
                for start in range(width):
                    for size in range(1, min(self.longest, width - start) + 1):
                        own = ids[:, start, size - 1]
                        rows = np.flatnonzero(own != len(self.pieces))
                        if len(rows):
                            yield start, start + size, rows, own[rows]

            every = list(spans())
            for sums, there, order, at, to in ((up, is_up, every, 0, 1), (down, is_down, every[::-1], 1, 0)):
                for span in order:
                    old, new = span[at], span[to]
                    ok = there[old][span[2]]
                    rows, own = span[2][ok], span[3][ok]
                    more = sums[old][rows] + logs[own]
                    sums[new][rows] = np.where(there[new][rows][:, None], np.logaddexp(sums[new][rows], more), more)
                    there[new][rows] = True
            for start, end, rows, own in every:
                ok = is_up[start][rows] & is_down[end][rows]
                rows, own = rows[ok], own[ok]
                uses = np.exp(up[start][rows] + logs[own] + down[end][rows] - down[0][rows]) * weights[block[rows]]
                for lang in range(total.shape[1]):
                    total[:, lang] += np.bincount(own, uses[:, lang], len(total))
        return total

    def _expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        table = self.tables()
        total = np.zeros_like(table)
        for block, sizes, ids in self.lattice(words):
            n, width, _ = ids.shape
            alpha, beta = (np.zeros((width + 1, n, len(self.langs))) for _ in "ab")
            alpha[0] = 1
            beta[sizes, np.arange(n)] = 1
            for end in range(1, width + 1):
                for size in range(1, min(self.longest, end) + 1):
                    own = ids[:, end - size, size - 1]
                    rows = np.flatnonzero(own != len(self.pieces))
                    if len(rows):
                        alpha[end][rows] += alpha[end - size][rows] * table[own[rows]]
            for start in range(width - 1, -1, -1):
                for size in range(1, min(self.longest, width - start) + 1):
                    own = ids[:, start, size - 1]
                    rows = np.flatnonzero(own != len(self.pieces))
                    if len(rows):
                        beta[start][rows] += beta[start + size][rows] * table[own[rows]]
            share = weights[block] / np.maximum(beta[0], 1e-300)
            for end in range(1, width + 1):
                for size in range(1, min(self.longest, end) + 1):
                    own = ids[:, end - size, size - 1]
                    rows = np.flatnonzero(own != len(self.pieces))
                    if len(rows):
                        uses = (alpha[end - size] * beta[end] * share)[rows] * table[own[rows]]
                        for lang in range(total.shape[1]):
                            total[:, lang] += np.bincount(own[rows], uses[:, lang], len(total))
        return total

    def fit(self, counts: dict[str, Counter], rounds: int = 3) -> "Model":
        """Probabilities by expectation maximisation from the words that each language's labelled texts hold."""
        words = sorted(set().union(*counts.values())) if counts else []
        weights = np.array([[counts[lang].get(w, 0) for lang in self.langs] for w in words], float).reshape(len(words), len(self.langs))
        self.prob[:-2] = 1 / len(self.pieces)
        for _ in range(rounds):
            uses = self.expected(words, weights)[:-2] + 0.01
            self.prob[:-2] = uses / uses.sum(axis=0)
        return self


def predictions(model, texts) -> tuple[list[str], list[float]]:
    """Language and score of each text of a column."""
    index: dict[str, int] = {}
    rows = []
    for value in texts:
        text = value.as_py()
        rows.append(np.array([index.setdefault(w, len(index)) for w in words_of(text)] if text else [], np.int64))
    distinct = [letters_only(w) for w in index]
    real = np.array([bool(w) for w in distinct], bool)
    langs = model.langs if model else []
    scores = np.zeros((len(distinct), len(langs)))
    if len(distinct) and langs:
        keep = np.flatnonzero(real)
        scores[keep] = model.forward([distinct[i] for i in keep])
    best, chance = [], []
    for own in rows:
        if not langs or not len(own) or not real[own].any():
            best.append("und")
            chance.append(0.0)
            continue
        total = scores[own].sum(axis=0)
        top = int(total.argmax())
        best.append(langs[top])
        chance.append(float(1 / np.exp(total - total[top]).sum()))
    return best, chance


def keep_batches(sent, least: float):
    """Whole rows whose text has a language with a score of ``least`` or more."""

    def run(batches):
        model = pickle.loads(sent.value)
        for batch in pieces(batches):
            best, chance = predictions(model, batch.column("text"))
            yield batch.filter(pa.array([b != "und" and c >= least for b, c in zip(best, chance)], pa.bool_()))

    return run


def predict_batches(sent):
    """Columns in: doc_id, held_out, text. Out: doc_id, held_out, lang_pred, score."""

    def run(batches):
        model: Model | None = pickle.loads(sent.value)
        for batch in pieces(batches):
            best, chance = predictions(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(chance, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def count_batches(batches):
    """Columns in: lang, text. Out: word counts of each batch by language."""
    for batch in pieces(batches):
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found = (p for m in islice(LETTERS.finditer(text.lower()), DOC_WORDS) for p in parts(m.group()))
            counts.setdefault(lang, Counter()).update(filter(None, map(letters_only, found)))
        flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.string()), pa.array([f[2] for f in flat], pa.int64())],
            ["lang", "word", "n"],
        )
