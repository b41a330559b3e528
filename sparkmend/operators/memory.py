"""Decision memory: decay, outcomes, recall, supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOME_WEIGHTS = {"success": 1.2, "failure": 0.8}


def decayed(confidence: Column, last_used: Column, as_of: Column, days: int = 90, loss: float = 0.1) -> Column:
    """Confidence less `loss`, not below 0, if the last use is older than `days`."""
    return F.when(F.datediff(as_of, last_used) > days, F.greatest(F.lit(0.0), F.round(confidence - loss, 6))).otherwise(confidence)


def is_active(confidence: Column, floor: float = 0.2) -> Column:
    return confidence >= floor


def after_outcome(confidence: Column, outcome: Column) -> Column:
    """A failure costs 0.3, a success gives 0.1, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence + F.when(outcome == "failure", -0.3).when(outcome == "success", 0.1).otherwise(0.0)))


def recall_score(similarity: Column, confidence: Column, outcome: Column) -> Column:
    out = F.lit(1.0)
    for name, w in OUTCOME_WEIGHTS.items():
        out = F.when(outcome == name, w).otherwise(out)
    return similarity * confidence * out


def outcome_rates(decisions: DataFrame, communities: str, outcome: str) -> DataFrame:
    """community, n, success, failure, partial, unknown: shares, three places."""
    rows = decisions.select(F.explode(communities).alias("community"), F.coalesce(outcome, F.lit("unknown")).alias("o"))
    return rows.groupBy("community").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg((F.col("o") == k).cast("double")), 3).alias(k) for k in ("success", "failure", "partial", "unknown")))


def supersede_turns(turns: DataFrame, keys: list[str], order: str, question: str, answer: str, shortest: int = 25) -> DataFrame:
    """keys, order, superseded_by: turns whose question recurs later with other numbers in the answer; the first such later turn.

    Questions are alike by their normal form here; a pair UDF can be put before it for likeness by meaning.
    """
    norm = F.trim(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}]+", " "))
    numbers = F.sort_array(F.array_distinct(F.regexp_extract_all(F.col(answer), F.lit("[0-9]+"), F.lit(0))))
    rows = turns.where(F.length(question) >= shortest).select(*keys, order, norm.alias("q"), numbers.alias("n"))
    later = rows.select(*keys, F.col(order).alias("__later"), "q", F.col("n").alias("m"))
    hit = rows.join(later, [*keys, "q"]).where((F.col("__later") > F.col(order)) & (F.col("n") != F.col("m")))
    return hit.groupBy(*keys, order).agg(F.min("__later").alias("superseded_by"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
