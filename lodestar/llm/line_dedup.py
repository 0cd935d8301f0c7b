"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, stored_bytes, table

#: A line goes if more than this share of its site's pages have it, and at least so many of them.
RATIO, LEAST_PAGES = 0.05, 5
#: Compressed bytes of all sites' boilerplate up to which it is broadcast; beyond it, pages and lines meet by a shuffle
#: on site and salt, so that a site of many pages is spread over SALTS tasks.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def _key(line: Column) -> Column:
    return F.unhex(_digest(line))


def _digest(line: Column) -> Column:
    return F.md5(F.trim(line))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, site_col: str = "source", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """Rows ``site, pages, keys``: per site its rows, and the MD5 digests of its boilerplate lines (trimmed, not blank).

    A line counts once a page. The keys are counted, partly before the shuffle, and never the lines; a site of p pages
    with l lines each on average has l / ratio boilerplate lines at most, whatever p is, so one array holds them.
    Pages without a site are one site; a null text is a page without lines. If ``distinct``, pages of equal text count
    once a site, so that copies of a page do not make all its lines boilerplate.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split(text_col, "\n"), lambda x: ~_blank(x)), _key))
    # A null key stands for the page itself, so that one shuffle gives both counts.
    keys = F.concat(F.array(F.lit(None).cast("binary")), F.coalesce(lines, F.array().cast("array<binary>")))
    pages = docs.select(F.col(site_col).alias("site"), keys.alias("keys"), F.xxhash64(text_col).alias("text_hash"))
    if distinct:  # the keys move once for this, and the texts never
        pages = pages.groupBy("site", "text_hash").agg(F.first("keys").alias("keys"), F.count("*").alias("copies"))
    else:
        pages = pages.withColumn("copies", F.lit(1).cast("long"))
    counts = pages.select("site", "copies", F.explode("keys").alias("key")).groupBy("site", "key").agg(F.count("*").alias("n"), F.sum("copies").alias("pages"))
    counts = stored(counts.where((F.col("n") >= least) | F.col("key").isNull()), "lines")
    totals = counts.where("key is null").select("site", "pages", F.col("n").alias("counted"))
    found = counts.where("key is not null").select(F.col("site").alias("s"), "key", "n").join(totals, F.col("s").eqNullSafe(F.col("site")))
    found = found.where(F.col("n") > F.col("counted") * ratio).groupBy("site", "pages").agg(F.collect_set(F.lower(F.hex("key"))).alias("keys"))
    return stored(found, "boilerplate")


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, site_col: str = "source", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (the text without boilerplate lines), ``n_lines`` and ``n_dropped`` besides.

    Lines end at line feeds; those left keep their order and are joined by line feeds. Blank lines always stay. A null
    text stays null and has no lines. Columns of ``docs`` may have any names; those of the three names give way.
    """
    found = boilerplate(docs, ratio, least, site_col, text_col, distinct)
    # Rows travel as one struct, so that no column of theirs can clash with those made here.
    rows = docs.select(F.struct("*").alias("row"), F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    known = found.select(F.col("site").alias("of_site"), "keys")
    match = F.col("site").eqNullSafe(F.col("of_site"))
    if stored_bytes(found) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(known), match, "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        known = known.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(known, match & (F.col("salt") == F.col("of_salt")), "left")
    lines = F.split("text", "\n")
    rows = rows.select("row", lines.alias("lines"), F.array_intersect(F.transform(lines, _digest), "keys").alias("gone"))
    left = F.filter("lines", lambda x: ~F.array_contains("gone", _digest(x)))
    rows = rows.select("row", "lines", F.when(F.coalesce(F.size("gone"), F.lit(0)) > 0, left).otherwise(F.col("lines")).alias("left"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    made = {"kept": F.array_join("left", "\n"), "n_lines": size("lines"), "n_dropped": size("lines") - size("left")}
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH d AS (SELECT *, row_number() OVER () AS page FROM documents),
l AS (SELECT d.page, d.source, u.line, u.n FROM d,
        LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS n) u),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT l.source, trim(l.line) AS line FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source WHERE trim(l.line) <> ''
      GROUP BY l.source, trim(l.line) HAVING count(DISTINCT l.page) > {RATIO} * any_value(p.pages) AND count(DISTINCT l.page) >= {LEAST_PAGES}),
k AS (SELECT l.page, count(*) AS n_lines, count(b.line) AS n_dropped,
        coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE b.line IS NULL), '') AS kept
      FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.line GROUP BY l.page)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.page = k.page
"""
