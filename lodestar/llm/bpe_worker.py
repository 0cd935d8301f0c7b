"""Byte-level BPE with word ends, by a contiguous rank array for each word."""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
import struct
import sys
import unicodedata
from array import array

import pyarrow as pa
import regex

from .arrow import pieces

#: White space of the tokenizer's own expressions (Python's \s has U+001C to U+001F besides).
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
CHUNKS = regex.compile(f"[^{WS}]+")
ODD = regex.compile("[\x1c-\x1f]")
#: Runs and words that a worker remembers in each of two generations (some 70 MB in all), and the length beyond which it remembers none.
RUNS, WORDS, LONG = 1 << 17, 1 << 17, 64
#: The same where little memory is left: a quarter of it, for about 1.4 times the time.
FEW = 1 << 15
#: Parts beyond which a word's boundaries are kept in a heap; scanning takes the square of the parts.
SCAN = 96
NEVER = 1 << 60
#: Bytes of texts that are encoded before a batch of results goes out.
PIECE = 1 << 20
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_chars() -> list[str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Memory:
    """A dict of bounded size: once the newer half is full it becomes the older, from which what is met again comes back."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= LONG:
            if len(self.new) >= self.size:
                self.new, self.old = {}, self.new
            self.new[key] = value


def compact(source: str | bytes) -> bytes:
    """What an encoder needs of a vocabulary's file (or of what it holds), pickled: strings and packed arrays."""
    if isinstance(source, str):
        with open(source, "rb") as f:
            source = f.read()
    spec = json.loads(source)
    vocab = spec["model"]["vocab"]
    end = spec["model"]["end_of_word_suffix"] or ""
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    texts = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
    chars = byte_chars()
    pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
    merges = [array("I", [f(a, b) for a, b in pairs]).tobytes() for f in (lambda a, b: vocab[a], lambda a, b: vocab[b], lambda a, b: vocab[a + b])]
    return pickle.dumps((texts, special, [vocab[c] for c in chars], [vocab[c + end] for c in chars], merges))


class Encoder:
    """From a vocabulary's file, or from what `compact` made of one."""

    def __init__(self, source: str | bytes, remember: int | None = None):
        self.tokens, self.special, self.inner, self.final, merges = pickle.loads(compact(source) if isinstance(source, str) else source)
        special = self.special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        left, right, made = (array("I", x) for x in merges)
        self.made: list[int] = made.tolist()
        self.merges: dict[tuple[int, int], int] = {pair: rank for rank, pair in enumerate(zip(left, right))}
        self.runs, self.words = Memory(remember or RUNS), Memory(remember or WORDS)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.inner[b] for b in word[:-1]]
        parts.append(self.final[word[-1]])
        if len(parts) > SCAN:
            return self.merge_long(parts)
        find, made = self.merges.get, self.made
        ranks = [find(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            at = ranks.index(least)
            parts[at] = made[least]
            del parts[at + 1]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = find((parts[at], parts[at + 1]), NEVER)
            if at:
                ranks[at - 1] = find((parts[at - 1], parts[at]), NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, with a heap of (rank, place) over a linked list."""
        n, find = len(parts), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := find((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := find((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (m, x, parts[x], parts[y]))
        return [p for p, on in zip(parts, alive) if on]

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a run without white space."""
        text = chunk
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        if text.isalpha():
            return self.word(text)
        if text[:-1].isalpha() and text[-1] in ".,":
            return self.word(text[:-1]) + self.word(text[-1])
        return b"".join([self.word(w) for w in SPLIT.findall(text)])

    def word(self, word: str) -> bytes:
        """The same for one word as the tokenizer splits them."""
        found = self.words.get(word)
        if found is None:
            ids = self.merge(word.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
            self.words.put(word, found)
        return found

    def plain(self, text: str, ids: list[bytes]) -> None:
        runs = self.runs
        for chunk in CHUNKS.findall(text) if ODD.search(text) else text.split():
            found = runs.new.get(chunk)
            if found is None and (found := runs.get(chunk)) is None:
                found = self.chunk(chunk)
                runs.put(chunk, found)
            ids.append(found)

    def encode(self, text: str) -> tuple[bytes, list[str]]:
        """Packed little-endian ids and the tokens' texts."""
        ids: list[bytes] = []
        for i, part in enumerate(self.cut.split(text)) if self.cut and "<|" in text else ((0, text),):
            if i % 2:
                ids.append(struct.pack("<I", self.special[part]))
            else:
                self.plain(part, ids)
        packed = b"".join(ids)
        return packed, list(map(self.tokens.__getitem__, array("I", packed) if LITTLE else struct.unpack(f"<{len(packed) // 4}I", packed)))

    def decode(self, ids) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def digest_batches(sent):
    def run(batches):
        encoder = Encoder(sent.value)
        for batch in pieces(batches, PIECE):
            sizes, ids, texts = [], [], []
            for value in batch.column("text"):
                packed, tokens = encoder.encode(value.as_py() or "")
                sizes.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_batches(sent):
    def run(batches):
        import numpy as np

        encoder = Encoder(sent.value)
        for batch in pieces(batches, PIECE):
            out = [np.frombuffer(encoder.encode(v.as_py() or "")[0], "<u4").astype(np.int32).tolist() for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def token_batches(sent):
    """Columns in: doc_id, lang, source, text. Out: the same without the text, its ids, their number and the decoded text's SHA-256.

    It comes after other stages in one executor, so it remembers few words.
    """

    def run(batches):
        import numpy as np

        encoder = Encoder(sent.value, FEW)
        for batch in pieces(batches, PIECE):
            ids, sizes, digests = [], [], []
            for value in batch.column("text"):
                packed, tokens = encoder.encode(value.as_py() or "")
                ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
                sizes.append(len(packed) // 4)
                digests.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(digests, pa.string())],
                ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"],
            )

    return run


def decode_batches(sent):
    def run(batches):
        encoder = Encoder(sent.value)
        for batch in pieces(batches, PIECE):
            out = [encoder.decode(v.as_py() or ()) for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return run
