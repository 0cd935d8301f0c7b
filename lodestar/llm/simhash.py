"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a number m from 1 to 2^(r+1)-1, in turn; mask v holds the positions whose <m, v> is odd. Any r
positions leave some v orthogonal to all of their numbers, so two fingerprints that differ in those positions alone
agree under mask v: a pair within the radius always meets in one of the 2^(r+1)-1 tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash_worker
from .common import ship, small, stored, table
from .graph import components

ship(simhash_worker)

#: A bucket with more fingerprints than this is not compared pair by pair; each looks its near keys up instead.
HOT_BUCKET = 400
#: Fingerprints with this many documents or more are hot; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 2_000
#: Compressed bytes up to which a side is broadcast; beyond it, Spark shuffles both.
BROADCAST_BYTES = 32 << 20
#: Texts of each side of a block of pairs that are verified together.
SIDE = 256


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1)-1 masks, as unsigned numbers."""
    top = (1 << (radius + 1)) - 1
    numbers = [1 + i % top for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(numbers) if bin(m & v).count("1") % 2) for v in range(1, top + 1)]


def _literal(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def close_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs ``a < b`` of different values of the one column ``fp`` (distinct longs) within the Hamming radius, each once.

    Complete for the radius at any bucket size: buckets of up to HOT_BUCKET values are joined within themselves; values
    of larger buckets are joined, by equality, with their variants under up to ``radius`` flips outside the mask.
    """
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_literal(m)).alias("key")) for t, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    sized = stored(rows.groupBy("t", "key").count().where("count > 1"), "buckets")
    hot = sized.where(F.col("count") > HOT_BUCKET)
    cool = rows.join(sized.where(F.col("count") <= HOT_BUCKET), ["t", "key"])
    pairs = (
        cool.select("t", "key", F.col("fp").alias("a"))
        .join(cool.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where("a < b")
        .where(near)
        .select("a", "b")
    )
    if hot.limit(1).count():
        owners = stored(rows.join(hot.select("t", "key"), ["t", "key"]).select("t", "fp").distinct(), "hot")
        for t, mask in enumerate(masks):
            free = [i for i in range(64) if not mask >> i & 1]
            once = F.transform(F.array(*[F.lit(_signed(1 << i)) for i in free]), lambda m: m)
            own = owners.where(F.col("t") == t).select("fp")
            variants = own.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
            flipped = variants
            for _ in range(radius):
                flipped = flipped.select("a", "b", F.explode(once).alias("m")).select("a", F.col("b").bitwiseXOR(F.col("m")).alias("b")).distinct()
                variants = variants.unionByName(flipped)
            found = variants.where("a < b").distinct().join(own.select(F.col("fp").alias("b")), "b")
            pairs = pairs.unionByName(found.where(near).select("a", "b"))
    return pairs.distinct()


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows ``doc_id, fp``, one a row of ``docs``; other columns are left behind.

    A null text counts as one without words, whose fingerprint is 0; ids may be null or repeat.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(simhash_worker.fingerprint_batches(words), f"doc_id {kind}, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """Rows ``doc_id, fp, component_id``: documents linked through fingerprints within the radius share the smallest id.

    Documents with equal fingerprints enter the search as one. Rows whose id is null keep their fingerprint's
    component, which is null only if none of its documents has an id. An empty table gives no rows.
    """
    prints = stored(simhash(docs, id_col, text_col, words), "prints")
    per = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "per")
    roots = components(close_pairs(per.select("fp"), radius))
    linked = per.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = stored(linked.join(least, "root").select("fp", "n", "component_id"), "placed")
    # Documents of hot fingerprints meet them by broadcast (their number is bounded), all others by a shuffle.
    limit = max(1_000, -(-prints.count() // HOT_ROWS))
    hot = placed.where(F.col("n") >= limit).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot"))
    marked = prints.join(F.broadcast(hot), "fp", "left")
    cool = marked.where("is_hot is null").select("doc_id", "fp").join(placed.select("fp", "component_id"), "fp")
    return cool.select("doc_id", "fp", "component_id").unionByName(marked.where("is_hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")))


#: Of the pipeline's stage: independent fingerprints of the set of words, and their radius.
PRINTS, PRINT_RADIUS = 2, 4
#: About so many documents tell which shingles are frequent, and so many of those are put last in the order of shingles.
ORDER_DOCS, ORDER_SHINGLES = 16_384, 1 << 18


def _alike(pairs: DataFrame, rows: DataFrame, words: int, likeness: float) -> DataFrame:
    """Those of the stored pairs ``a, b, spot`` of nodes whose sets of shingles have the likeness.

    Pairs of one ``spot`` are verified together, in blocks of about SIDE texts a side, so that a text is moved and cut
    into shingles once a block and not once a pair: pairs may grow as the square of a group of copies, texts do not.
    """
    sides = pairs.groupBy("spot").agg(*[F.ceil(F.count_distinct(c) / SIDE).cast("int").alias(f"n{c}") for c in "ab"])
    # One block for most spots; a spot of many texts is cut by hash, into na x nb blocks.
    wide = stored(sides.where("na > 1 or nb > 1").select(F.col("spot").alias("wide"), "na", "nb"), "wide")
    cut = pairs.join(small(wide, BROADCAST_BYTES), F.col("spot") == F.col("wide"), "left") if wide.limit(1).count() else pairs.withColumn("na", F.lit(1)).withColumn("nb", F.lit(1))
    part = [F.pmod(F.xxhash64(c), F.coalesce(f"n{c}", F.lit(1))) for c in "ab"]
    placed = stored(cut.select("a", "b", F.xxhash64("spot", *part).alias("block")), "placed")
    wanted = stored(placed.select("block", F.col("a").alias("node")).union(placed.select("block", "b")).distinct(), "wanted")
    known = rows.join(small(wanted.select("node").distinct(), BROADCAST_BYTES), "node", "left_semi").dropDuplicates(["node"])
    texts = wanted.join(stored(known, "texts"), "node").select("block", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    both = texts.unionByName(placed.select("block", "a", "b", F.lit(None).cast("string").alias("text")))
    # Texts come before the pairs of their block.
    return both.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first()).mapInArrow(simhash_worker.block_batches(words, likeness), "a long, b long")


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Stored components of those given (``node, root``) and the links ``a, b``."""
    return stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "roots")


def met_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b, spot`` of ``rows(node, text)`` that covering tables bring together: of the first of each of its buckets and the one before it there, a node goes with the nearest.

    That is a pair a node at most, whatever the buckets' sizes; what it leaves apart is for `prefixes` to find.
    """
    prints = stored(rows.mapInArrow(simhash_worker.word_set_batches(PRINTS), "node long, fps array<long>").dropDuplicates(["node"]), "prints")
    masks = covering_masks(PRINT_RADIUS)
    # A bucket is a table and its key, hashed together: a chance meeting costs one more pair at most.
    keys = F.array(*[F.xxhash64(F.lit(c * len(masks) + t), F.col("fps")[c].bitwiseAND(_literal(m))) for c in range(PRINTS) for t, m in enumerate(masks)])
    buckets = prints.select("node", F.explode(keys).alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("node")
    # The first row of a bucket has none before it, and most buckets have no other row.
    near = buckets.withColumn("before", F.lag("node").over(order)).withColumn("first", F.first("node").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = stored(near.where("before is not null").select(F.col("node").alias("b"), F.explode(F.array("before", "first")).alias("a")).where("a < b").distinct(), "pairs")
    for side in "ab":
        pairs = pairs.join(small(prints, BROADCAST_BYTES).select(F.col("node").alias(side), F.col("fps").alias(f"f{side}")), side)
    bits = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = pairs.select("b", F.struct(bits.alias("bits"), "a").alias("near")).groupBy("b").agg(F.min("near").alias("near"))
    return stored(near.select("near.a", "b", F.col("near.a").alias("spot")), "close")


def _order(rows: DataFrame, words: int) -> tuple[bytes, bytes]:
    """Hashes of frequent shingles, sorted, and their places by rising count, as packed arrays.

    A sample is enough: the places decide how many pairs are compared, and never which are found.
    """
    share = min(1.0, ORDER_DOCS / max(1, rows.count()))
    some = rows.where(F.pmod("node", F.lit(1 << 20)) <= int(share * (1 << 20)))
    counted = some.mapInArrow(simhash_worker.shingle_rows(words), "shingle long").groupBy("shingle").count().where("count > 2")
    return simhash_worker.places(counted.orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES).toArrow())


def prefixes(rows: DataFrame, words: int, likeness: float) -> DataFrame:
    """Rows ``key, node, size``: the prefix of each text's set of shingles, of ``size`` shingles, where another text has the key too.

    Of two sets with a Jaccard likeness of t, in one order of all shingles, the first |x| - ceil(t|x|) + 1 of each share
    one; rare shingles come first, so that few texts share a key.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_order(rows, words))
    found = rows.mapInArrow(simhash_worker.prefix_batches(words, likeness, sent), "key long, node long, size int")
    once = found.repartition("key").dropDuplicates(["key", "node"])
    return stored(once.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n"), "prefixes")


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored rows of `prefixes` with their ``root``, of keys that nodes of different components share."""
    placed = shared.select("key", "node", "size").join(small(roots, BROADCAST_BYTES), "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return stored(placed.join(keys, "key"), "mixed")


def _reach(common: str, m: str, n: str, likeness: float) -> Column:
    """Whether sets of m and n shingles may have the likeness if their prefixes share so many."""
    rest = F.greatest(*[F.ceil(likeness * F.col(size) - 1e-6) - 1 for size in (m, n)])
    fits = F.least(m, n) >= likeness * F.greatest(m, n) - 1e-6
    return fits & ((F.col(common) + rest) * (1 + likeness) >= likeness * (F.col(m) + F.col(n)) - 1e-6)


def hub_pairs(mixed: DataFrame, likeness: float) -> DataFrame:
    """Pairs ``a, b, spot``: each node with the hub that it meets under most keys, in another component.

    The hub of a key is the node with the most shared keys in all: of a text and many edited copies it is the text, as
    a copy's edits are its own. So such groups are linked at one pair a member.
    """
    popular = mixed.groupBy("node").agg(F.count("*").alias("met"))
    rows = mixed.join(popular, "node")
    hubs = rows.groupBy("key").agg(F.max_by(F.struct("node", "root", "size"), F.struct("met", "node")).alias("hub"))
    met = rows.join(hubs, "key").where(F.col("root") != F.col("hub.root")).groupBy("node", "size", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size")).agg(F.count("*").alias("keys"))
    best = met.where(_reach("keys", "size", "hub_size", likeness)).groupBy("node").agg(F.max_by("hub", F.struct("keys", "hub")).alias("hub"))
    pairs = best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), "hub")
    return stored(pairs.groupBy("a", "b").agg(F.min("hub").alias("spot")), "hubs")


def unmet_pairs(mixed: DataFrame, likeness: float) -> DataFrame:
    """Pairs ``a, b, spot`` in different components that may have the likeness; none that has it is left out.

    A pair has as much in common as its prefixes have, and at most all that comes after one of them. Keys of a single
    component, whose pairs are linked already, are not in ``mixed``. The spot is the least key that a pair shares: copies
    of one text share many, so theirs are few.
    """
    x = mixed.select("key", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("size").alias("m"))
    y = mixed.select("key", F.col("node").alias("y"), F.col("root").alias("ry"), F.col("size").alias("n"))
    fits = F.least("m", "n") >= likeness * F.greatest("m", "n") - 1e-6
    found = x.join(y, "key").where("x < y and rx <> ry").where(fits).groupBy("x", "y", "m", "n").agg(F.count("*").alias("common"), F.min("key").alias("spot"))
    return stored(found.where(_reach("common", "m", "n", likeness)).select(F.col("x").alias("a"), F.col("y").alias("b"), "spot"), "unmet")


def copy_groups(rows: DataFrame, words: int = 5, likeness: float = 0.8) -> DataFrame:
    """Components ``node, root`` of ``rows(node, text)`` linked by shingle sets of the given Jaccard likeness, where a node has a link.

    Fingerprints link what they can at a fixed cost a text (`met_pairs`); then hubs (`hub_pairs`); and an exact join over
    what is still in different groups (`unmet_pairs`) finds the rest, so the groups are those of all pairs.
    """
    roots = stored(components(_alike(met_pairs(rows), rows, words, likeness)), "roots")
    shared = prefixes(rows, words, likeness)
    for candidates in (hub_pairs, unmet_pairs):
        shared = _mixed(shared, roots)
        pairs = candidates(shared, likeness)
        if pairs.limit(1).count():
            roots = _grown(roots, _alike(pairs, rows, words, likeness))
    return roots


def near_copies(docs: DataFrame, words: int = 5, likeness: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group linked by shingle sets of the given Jaccard likeness, the smallest id stays.

    Groups are those of `copy_groups`; whatever is linked has been verified on its full set of shingles. Texts are told
    apart by 64-bit hashes. Exact copies, and texts without a word, are copies of one another; of equal rows one stays;
    null ids come after all others. Columns may have any names. An empty table gives no rows.
    """
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(node.alias("node"), F.col(text_col).alias("text"))
    roots = copy_groups(rows, words, likeness)
    ids = docs.select(F.col(id_col).alias("id"), node.alias("node")).groupBy("id", "node").agg(F.count("*").alias("n"))
    grouped = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    stays = grouped.groupBy("root").agg(F.min(first).alias("first"), F.sum("n").alias("size")).where("size > 1")
    stays = stays.select("root", F.col("first.id").alias("first_id"), F.col("first.node").alias("first_node"))
    goes = grouped.join(stays, "root").withColumn("is_first", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node")))
    goes = stored(goes.where("not is_first or n > 1").select(F.col("id").alias("gone_id"), F.col("node").alias("gone_node"), "is_first"), "goes")
    # Rows travel as one struct, so that no column of theirs can clash with those made here.
    boxed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), node.alias("node"))
    joined = boxed.join(small(goes, BROADCAST_BYTES), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("node") == F.col("gone_node")), "left")
    alone = joined.where("is_first is null").select("row.*")
    if goes.where("is_first").limit(1).count():  # equal rows, of which one stays
        alone = alone.unionByName(joined.where("is_first").dropDuplicates(["id", "node"]).select("row.*"))
    return alone


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
