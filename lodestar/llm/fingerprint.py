"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL expressions only.

A digest goes into one cell of each of three tables of 8 cells; a cell keeps a count and the XOR of its digests and of
their check hashes. The difference of two sketches keeps what the texts don't share. A cell of one digest shows itself
by its check hash; taking it out of its other cells uncovers more, until all is found or the sketch was too small. Then
the digests are split by hash into as many sketches as hold them, and again with another salt on failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: A paragraph is a line; longer lines are cut at the first sentence's end after so many characters.
PIECE = r"([^\n]{160,}?[.!?](?=\s)|[^\n]+)"
#: Digests, of both texts together, for each sketch of 24 cells when a comparison is retried.
LOAD = 12
ROUNDS, RETRIES = 8, 3
#: Rows of a bucket of the order by doc_id, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2_000, 65_536


def digests(text: str) -> Column:
    """The distinct XXH64 hashes of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(1)), lambda p: F.xxhash64(p)))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _entries(digests: str, salt: str, groups: str = "1") -> str:
    """Digest, check hash and group of each digest."""
    group = "0L" if groups == "1" else f"pmod(xxhash64(d, 100 + {salt}), {groups})"
    return f"transform({digests}, d -> named_struct('d', d, 'h', xxhash64(d, {salt}), 'g', {group}))"


def _cells(entries: str) -> str:
    """24 cells of entries bound to a name; cell i takes those whose three bits of table i div 8 are i mod 8."""
    return (
        f"transform(sequence(0, 23), i -> aggregate(filter({entries}, e -> (shiftrightunsigned(e.h, 3 * shiftright(i, 3)) & 7L) = i % 8), "
        "named_struct('n', 0, 'k', 0L, 'h', 0L), (a, e) -> named_struct('n', a.n + 1, 'k', a.k ^ e.d, 'h', a.h ^ e.h)))"
    )


def _sketch(digests: str) -> str:
    return _let("en", _entries(digests, "0"), _cells("en"))


def _less(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def _peel(difference: str, salt: str) -> str:
    """Struct of what is left: ``p`` digests only in the first, ``q`` only in the second, ``ok`` if nothing is left."""
    pure = f"array_distinct(filter(s.c, x -> abs(x.n) = 1 AND x.h = xxhash64(x.k, {salt})))"
    out = (
        "transform(s.c, (x, i) -> aggregate(filter(u, e -> (shiftrightunsigned(e.h, 3 * shiftright(i, 3)) & 7L) = i % 8), x, "
        "(a, e) -> named_struct('n', a.n - e.n, 'k', a.k ^ e.k, 'h', a.h ^ e.h)))"
    )
    found = f"named_struct('c', {out}, 'p', s.p + size(filter(u, e -> e.n = 1)), 'q', s.q + size(filter(u, e -> e.n = -1)), 'on', true)"
    still = "named_struct('c', s.c, 'p', s.p, 'q', s.q, 'on', false)"
    step = f"if(s.on, {_let('u', pure, f'if(size(u) = 0, {still}, {found})')}, s)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('c', {difference}, 'p', 0, 'q', 0, 'on', true), (s, r) -> {step}, "
        "s -> named_struct('p', s.p, 'q', s.q, 'ok', forall(s.c, x -> x.n = 0 AND x.k = 0L AND x.h = 0L)))"
    )


def _first_try(a: str, b: str) -> str:
    """From the two base sketches; not tried if hardly a cell is empty, which is beyond what 24 cells can give back."""
    full = "size(filter(z, x -> x.n = 0 AND x.k = 0L AND x.h = 0L)) < 3"
    return _let("z", _less(a, b), f"if({full}, named_struct('p', 0, 'q', 0, 'ok', false), {_peel('z', '0')})")


def _larger(a: str, b: str, salt: int) -> str:
    """Split by hash into sketches for LOAD digests each; ``ok`` if all of them give everything back."""
    groups = f"((size({a}) + size({b})) div {LOAD} + 1)"
    of = lambda name: f"filter({name}, e -> e.g = g)"
    one = _let("fa", of("ea"), _let("fb", of("eb"), _peel(_less(_cells("fa"), _cells("fb")), str(salt))))
    summed = (
        f"aggregate(transform(sequence(0L, gs - 1), g -> {one}), named_struct('p', 0, 'q', 0, 'ok', true), "
        "(t, x) -> named_struct('p', t.p + x.p, 'q', t.q + x.q, 'ok', t.ok AND x.ok))"
    )
    return _let("gs", groups, _let("ea", _entries(a, str(salt), "gs"), _let("eb", _entries(b, str(salt), "gs"), summed)))


def likeness(rows: DataFrame, name: str, a: str, b: str, cells_a: str, cells_b: str) -> DataFrame:
    """Adds the Jaccard likeness of the digest sets ``a`` and ``b`` from their sketches' difference, retried larger.

    Two texts without paragraphs are alike (1.0). After the last retry, which hardly one in millions needs, the sets
    themselves are compared, so no row stays without its result.
    """
    found = rows.withColumn("_try", F.expr(_first_try(cells_a, cells_b)))
    for salt in range(1, RETRIES + 1):
        found = found.withColumn("_try", F.expr(f"if(_try.ok, _try, {_larger(a, b, salt)})"))
    exact = f"named_struct('p', size(array_except({a}, {b})), 'q', size(array_except({b}, {a})), 'ok', true)"
    found = found.withColumn("_try", F.expr(f"if(_try.ok, _try, {exact})"))
    return found.withColumn(name, F.expr(f"if(size({a}) + _try.q = 0, 1.0D, (size({a}) - _try.p) / cast(size({a}) + _try.q AS double))")).drop("_try")


def printed(cells: str) -> Column:
    """A sketch as a string: count, digests and check hashes of each cell."""
    return F.expr(f"array_join(transform({cells}, c -> if(c.n = 0, '-', concat(c.n, ':', lower(hex(c.k)), ':', lower(hex(c.h))))), ',')")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``next_text``: the text of the following row by descending doc_id, of the first row after the last.

    Null ids come last, equal ids go by text, and a lone row follows itself. The order is cut into buckets by quantiles
    of the id, of BUCKET_ROWS rows each, or a MOST_BUCKETS-th part of all rows if that is more. A task sorts one bucket,
    and spills what memory cannot hold. Rows of one id, and those without an id, are in one bucket: ids are meant to tell
    rows apart, and the result is whole where they don't, but it waits for that task. The first id of each bucket is a quantile itself; its row is
    copied to the bucket before, in the same shuffle, and closes it.
    """
    n = docs.count()
    wanted = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    shares = ",".join(str(i / wanted) for i in range(1, wanted + 1))
    cuts = F.expr(f"percentile_approx(doc_id, cast(split('{shares}', ',') as array<double>), {max(10_000, 4 * wanted)})")
    ids = docs.where("doc_id is not null").agg(F.max("doc_id").alias("top"), cuts.alias("cuts")).first()
    heads = sorted({ids["top"], *(ids["cuts"] or ())}, reverse=True) if ids["top"] is not None else []
    last = max(len(heads) - 1, 0)
    if heads:
        bounds = f"cast(split('{','.join(map(str, heads))}', ',') as array<bigint>)"
        # Heads fall; the bucket is the last one whose head is not under the id.
        steps = max(1, last.bit_length())
        search = (
            f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {last}), (s, i) -> if(s.lo = s.hi, s, "
            f"if(element_at({bounds}, shiftright(s.lo + s.hi + 1, 1) + 1) >= doc_id, named_struct('lo', shiftright(s.lo + s.hi + 1, 1), 'hi', s.hi), "
            "named_struct('lo', s.lo, 'hi', shiftright(s.lo + s.hi + 1, 1) - 1))), s -> s.lo)"
        )
        bucket = F.expr(f"if(doc_id is null, {last}, {search})")
        is_head = F.expr(f"coalesce(element_at({bounds}, bucket + 1) = doc_id, false)")
    else:
        bucket, is_head = F.lit(0), F.lit(False)
    rows = docs.withColumn("bucket", bucket.cast("int"))
    if last:
        before = F.pmod(F.col("bucket") - 1, F.lit(last + 1)).cast("int")
        own, copy = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("c")), F.struct(before.alias("b"), F.lit(True).alias("c"))
        rows = rows.withColumn("at", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))))
        rows = rows.withColumn("bucket", F.col("at.b")).withColumn("is_copy", F.col("at.c")).drop("at")
    else:
        rows = rows.withColumn("is_copy", F.lit(False))
    order = Window.partitionBy("bucket").orderBy("is_copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    boxed = F.struct("text")
    following = F.lead(boxed).over(order)
    if not last:
        following = F.coalesce(following, F.first(boxed).over(whole))
    return rows.withColumn("next_text", following["text"]).where("not is_copy").drop("is_copy", "bucket")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, digests, cells, fingerprint``: the sketch of each text; a null text counts as empty, with an empty sketch."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", digests("text").alias("digests"))
    rows = rows.withColumn("cells", F.expr(_sketch("digests")))
    return rows.withColumn("fingerprint", printed("cells"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one a row of ``docs``.

    In the edited text the last third of the code points, rounded down, gives way to as many first ones of the next
    document (all, if it has fewer). A null text counts as empty. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows)
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    kinds = {"own": "text", "new": "edited", "nxt": "next_text"}
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), *(digests(t).alias(f"d_{k}") for k, t in kinds.items())
    )
    rows = rows.select("*", *(F.expr(_sketch(f"d_{k}")).alias(f"c_{k}") for k in kinds))
    rows = likeness(rows, "near_edited", "d_own", "d_new", "c_own", "c_new")
    rows = likeness(rows, "near_next", "d_own", "d_nxt", "c_own", "c_nxt")
    return rows.select("doc_id", "n_chars", "edited_sha256", printed("c_own").alias("fingerprint"), printed("c_new").alias("edited_fingerprint"), "near_edited", "near_next")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
