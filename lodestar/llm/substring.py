"""Substring dedup: against reference texts by broadcast suffix automata, and of a corpus against itself."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import substring_worker
from .arrow import pieces
from .common import ship, small, stored, table

ship(substring_worker)

#: Compressed bytes up to which a side is broadcast (some 64 MB when unpacked); beyond it, Spark shuffles both, which moves
#: the texts once more for each of two joins.
BROADCAST_BYTES = 16 << 20
#: Occurrences from which a key is hot: its rows meet it by broadcast, of at most a HOT-th part as many keys as rows.
HOT = 50_000
#: Characters of reference text in one automaton (some 0.5 GB of states for each million words).
SHARD_CHARS = 1 << 20


def remove_reference_spans(docs: DataFrame, reference: list[str], least: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept``: texts without their spans of ``least`` words or more found in a reference.

    The reference is split into shards of SHARD_CHARS; the automaton of each is broadcast, and all documents stream past
    it for their matching statistics. Null texts have no words. An empty reference removes nothing; an empty table gives
    no rows. Meant for references of a stated size: the cost is the documents' words times the shards.
    """
    spark = docs.sparkSession
    shards: list[list[list[bytes]]] = [[]]
    size = 0
    for text in reference:
        if size + len(text) > SHARD_CHARS and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append((text or "").encode().split())
        size += len(text or "")
    sent = [spark.sparkContext.broadcast(cloudpickle.dumps(substring_worker.Automaton(s))) for s in shards]

    def run(batches):
        automata = [pickle.loads(s.value) for s in sent]
        for batch in pieces(batches):
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").encode().split()
                drop = set()
                for a in automata:
                    for x, y in a.spans(words, least):
                        drop.update(range(x, y))
                rest = [w for i, w in enumerate(words) if i not in drop]
                rows.append((key, len(words), len(drop), b" ".join(rest).decode()))
            columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column("doc_id").type, pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 15, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept``: texts without each word that a repeated window of words covers.

    A window is repeated if its words start anywhere else, in the same text too. Its least q-gram, by hash, is its
    anchor, and equal windows have equal anchors; so only windows with an anchor that occurs twice can repeat, and only
    these are hashed, shuffled and counted. Nothing is sampled: every window has an anchor. Null texts have no words,
    texts of fewer words than a window lose none, and equal rows repeat one another. ``kept`` is the text of the words
    left, joined by one space, or its SHA-256. Windows are told apart by 64-bit hashes: of n windows, n^2 / 2^65 pairs
    are expected to be taken for equal by chance, which is none in 10^9, and 27,000 in 10^12.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # Equal rows share a key, which is right: they lose the same words.
    keyed = rows.select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), "doc_id", "text")
    keys = f"k1 {kind}, k2 long"
    found = stored(keyed.select("k1", "k2", "text").mapInArrow(substring_worker.anchor_batches(window, gram), f"{keys}, at int, anchor long"), "anchors")
    places = stored(_repeated(found, "anchor").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("places")), "places")

    def on(side: DataFrame):
        side = side.withColumnRenamed("k1", "j1").withColumnRenamed("k2", "j2")
        return side, F.col("k1").eqNullSafe(F.col("j1")) & (F.col("k2") == F.col("j2"))

    side, match = on(places)
    near = keyed.select("k1", "k2", "text").join(small_side(side, places), match).select("k1", "k2", "text", "places")
    windows = stored(near.mapInArrow(substring_worker.window_batches(window, gram), f"{keys}, at int, hash long"), "windows")
    starts = _repeated(windows, "hash").groupBy("k1", "k2").agg(F.collect_set("at").alias("starts"))
    runs = stored(starts.mapInArrow(substring_worker.run_batches(window), f"{keys}, runs binary"), "runs")
    side, match = on(runs)
    return keyed.join(small_side(side, runs), match, "left").select("doc_id", "text", "runs").mapInArrow(
        substring_worker.kept_batches(with_text), f"doc_id {kind}, n_words long, n_removed long, kept string"
    )


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key another row has too. Counts are combined before they move, and rows of hot keys stay where they are."""
    counts = stored(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    hot = counts.where(F.col("n") >= HOT).select(F.col(key).alias("hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left")
    cool = marked.where("hot is null").join(counts.where(F.col("n") < HOT).select(key), key)
    return cool.select(*rows.columns).unionByName(marked.where("hot is not null").select(*rows.columns))


def small_side(side: DataFrame, source: DataFrame) -> DataFrame:
    return F.broadcast(side) if small(source, BROADCAST_BYTES) is not source else side


def op6(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.withColumnRenamed("kept", "kept_sha256")
