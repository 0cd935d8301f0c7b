"""Secret scans: base rules, and randomness tests with length-aware control of false discoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import secrets_worker
from .common import ship, stored, table

ship(secrets_worker)


#: Steps of a power of ten in which p values are counted for the cut over the whole table.
STEPS = 1_000


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, one a row of ``docs``; texts are read once and never shuffled.

    Offsets count code points, ends are exclusive. A null text counts as empty, ids may be null or repeat, and other
    columns are left behind. ``spans`` lists kind:start:end of the base rules and of tokens found to be random. A token
    that the battery of tests takes for random is reported if its p value as text passes Benjamini and Hochberg's cut
    over all tokens of the table, so that the share of text among what is reported is bounded for the whole of it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,kind:int,end:long,n:int,p:double>>"
    found = stored(rows.mapInArrow(secrets_worker.scan_batches, schema), "spans")
    tried = found.select(F.explode("found").alias("x")).where("x.kind = 3").select("x.n", "x.p")
    mean = tried.agg(F.avg("n").alias("mean")).first()["mean"] or 1.0
    # p values under 1e-99 count as that; a step's upper end stands for all of it, which can only make the cut stricter.
    step = F.ceil(F.lit(STEPS) * F.log10(F.greatest(F.col("p") * F.lit(mean) / F.col("n"), F.lit(1e-99)))).cast("long")
    cut, passed, total = None, 0, 0
    counted = [(r["step"], r["count"]) for r in tried.groupBy(step.alias("step")).count().orderBy("step").collect()]  # 100,000 rows at most
    total = sum(n for _, n in counted)
    for at, n in counted:
        passed += n
        if 10 ** (at / STEPS) <= secrets_worker.FDR * passed / total:
            cut = at
    names = F.array(*map(F.lit, secrets_worker.KINDS))
    keep = lambda x: (x["kind"] < 3) | (F.ceil(F.lit(STEPS) * F.log10(F.greatest(x["p"] * F.lit(mean) / x["n"], F.lit(1e-99)))) <= F.lit(cut if cut is not None else -(1 << 40)))
    spans = F.transform(F.filter("found", keep), lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"))


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
