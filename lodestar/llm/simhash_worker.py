"""SimHash fingerprints on the Python workers, from Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash

from .arrow import pieces

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Hashes whose bits are counted at once (64 bytes each).
BLOCK = 1 << 17


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of a text, A-Z lower-cased; of the whole sequence if it is shorter; none without a word."""
    found = text.encode().translate(LOWER).split() if text else []
    if not found:
        return []
    line = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(line, seed)]
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(found) - words])]
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]


def majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """One fingerprint for each run of ``counts`` hashes: a bit is 1 if over half of the run have it; empty runs give 0."""
    out = np.zeros(len(counts), dtype=np.uint64)
    sizes = np.asarray(counts, dtype=np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    bits = np.unpackbits(np.asarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    over = (2 * ones > sizes[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(texts, words: int) -> np.ndarray:
    out, hashes, counts = [], [], []
    for text in texts:
        own = shingle_hashes(text, words)
        hashes += own
        counts.append(len(own))
        if len(hashes) >= BLOCK:
            out.append(majority(hashes, counts))
            hashes, counts = [], []
    out.append(majority(hashes, counts))
    return np.concatenate(out)


def fingerprint_batches(words: int):
    def run(batches):
        for batch in pieces(batches):
            column = batch.column("text")
            prints = fingerprints((v.as_py() for v in column), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's last steps."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_set_batches(copies: int):
    """Columns in: node, text. Out: node and ``copies`` independent fingerprints of the set of its words."""

    def run(batches):
        steps = np.arange(1, copies + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in pieces(batches):
            prints = []
            for value in batch.column("text"):
                text = value.as_py()
                found = set(text.encode().translate(LOWER).split()) if text else ()
                base = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in found), np.uint64, len(found))
                with np.errstate(over="ignore"):
                    all_hashes = mix64((base[None, :] + steps[:, None]).ravel())
                prints.append(majority(all_hashes, [len(found)] * copies).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(prints, pa.list_(pa.int64()))], ["node", "fps"])

    return run


def _sets(batches, words: int):
    """Of each piece of the batches (node, text): (node, its set of shingles' hashes), each node once a task."""
    seen = set()
    for batch in pieces(batches):
        found = []
        for node, value in zip(batch.column("node").to_pylist(), batch.column("text")):
            if node not in seen:
                seen.add(node)
                found.append((node, np.unique(np.asarray(shingle_hashes(value.as_py(), words), dtype=np.uint64))))
        yield found


def shingle_rows(words: int):
    """Columns in: node, text. Out: a row a shingle of each text's set."""

    def run(batches):
        for found in _sets(batches, words):
            flat = np.concatenate([np.empty(0, np.uint64), *(s for _, s in found)])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], ["shingle"])

    return run


def places(counted: pa.Table) -> tuple[bytes, bytes]:
    """Of rows shingle, count, the most frequent first: the hashes, sorted, and each one's place from the rarest, from 1."""
    hashes = counted.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    return hashes[by_hash].tobytes(), (len(hashes) - by_hash).astype(np.int32).tobytes()


def prefix_batches(words: int, likeness: float, sent):
    """Columns in: node, text. Out: the first shingles of each text's set, rare ones first: key, node, size of the set.

    There are enough of them for two sets of the likeness to share one. A set without shingles has the key 0.
    """

    def run(batches):
        hashes, ranks = (np.frombuffer(x, kind) for x, kind in zip(sent.value, (np.uint64, np.int32)))
        for found in _sets(batches, words):
            keys, sizes = [np.empty(0, np.uint64)], []
            for _, own in found:
                n = len(own)
                take = n - math.ceil(likeness * n - 1e-6) + 1
                if len(hashes):
                    spot = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    rank = np.where(hashes[spot] == own, ranks[spot], 0)
                    own = own[np.lexsort((own, rank))]
                first = own[:take] if n else np.zeros(1, np.uint64)
                keys.append(first)
                sizes.append(n)
            counts = np.array([len(k) for k in keys[1:]], np.int64)
            nodes = np.repeat(np.array([node for node, _ in found], np.int64), counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes), pa.array(np.repeat(np.array(sizes, np.int32), counts))], ["key", "node", "size"])

    return run


def block_batches(words: int, likeness: float):
    """Rows block, a, b, text, by block: first its texts (a is the node, b null), then its pairs. Out: the pairs a, b whose sets of shingles have the likeness; two empty sets have it.

    The sets of one block are held, and dropped with it.
    """

    def run(batches):
        block, sets = None, {}
        for batch in pieces(batches):
            out = []
            for at, a, b, text in zip(batch.column("block").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text")):
                if at != block:
                    block, sets = at, {}
                if b is None:
                    sets[a] = np.unique(np.asarray(shingle_hashes(text.as_py(), words), dtype=np.uint64))
                    continue
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) < likeness * max(len(x), len(y)) - 1e-6:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                if not either or both / either >= likeness:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return run
