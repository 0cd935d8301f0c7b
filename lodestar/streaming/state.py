"""Running state over streams: reward totals, exponential means, technique lifecycles, and incremental postings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.lexical import Tokens

STATE = "state string, fitness double, n long, low long"
OUT = "technique string, " + STATE


def advance(state: tuple[str, float, int, int], value: float, alpha: float = 0.3) -> tuple[str, float, int, int]:
    """One observation more; the rules of ``operators.tuning.lifecycle_step``."""
    name, fitness, n, low = state
    fitness = value if n == 0 else alpha * value + (1 - alpha) * fitness
    n += 1
    if name == "embryonic" and n >= 10:
        name = "active"
    elif name == "active" and fitness > 0.7:
        name = "preferred"
    elif name == "preferred" and fitness < 0.4:
        name = "declining"
    elif name == "declining":
        low = low + 1 if fitness < 0.2 else 0
        if low >= 5:
            name = "disabled"
    return name, fitness, n, low


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else ("embryonic", 0.0, 0, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    for value in rows["value"]:
        now = advance(now, float(value))
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=["technique", "state", "fitness", "n", "low"])


def lifecycle_stream(observations: DataFrame) -> DataFrame:
    """State of each technique after every trigger, from a stream ``technique, seq, value``.

    The order within a trigger is that of ``seq``; across triggers, of arrival. Only the state is kept, not the history.
    """
    return observations.groupBy("technique").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def arm_stream(rewards: DataFrame) -> DataFrame:
    """Pulls and totals by arm of a stream ``arm, reward``, for the update mode."""
    return rewards.groupBy("arm").agg(F.count("*").alias("pulls"), F.sum("reward").alias("total"))


def windowed_rewards(rewards: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rewards by arm and tumbling window of ``ts``; what comes later than the watermark is dropped by Spark."""
    return rewards.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "arm").agg(F.count("*").alias("pulls"), F.avg("reward").alias("mean"))


def postings_stream(docs: DataFrame, path: str, checkpoint: str, tokens: Tokens = T.compound_tokens):
    """Appends postings of arriving documents to a table; counting terms within a document needs no state."""
    terms = docs.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode(F.array_distinct("t")).alias("term"), "t")
    rows = terms.select("doc_id", "dl", "term", F.size(F.filter("t", lambda x: x == F.col("term"))).alias("tf"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
