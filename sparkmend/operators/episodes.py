"""Agents' episodes and tool calls: usage, roll-ups, hand-offs, similar failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.functions.text import failure_signature


def tool_usage(calls: DataFrame, agent: str, tool: str, failed: str, millis: str) -> DataFrame:
    return calls.groupBy(agent, tool).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col(failed), 1).otherwise(0)).alias("failures"), F.avg(millis).cast("long").alias("mean_ms"))


def rollup(calls: DataFrame, episode: str, order: str, ts: str, tool: str, error: str, first: int = 40) -> DataFrame:
    """episode, n_calls, n_retries (equal tools in a row), last_error (signature), tools (the first of them in order), seconds."""
    w = Window.partitionBy(episode).orderBy(order)
    c = calls.withColumn("__again", (F.col(tool) == F.lag(tool).over(w)).cast("int")).withColumn("__n", F.row_number().over(w))
    early = F.collect_list(F.when(F.col("__n") <= first, F.struct("__n", F.col(tool).alias("t"))))
    out = c.groupBy(episode).agg(
        F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("__again"), F.lit(0)).alias("n_retries"), F.max_by(F.when(F.col(error).isNotNull(), F.col(error)), F.when(F.col(error).isNotNull(), F.col(order))).alias("e"),
        F.sort_array(early).alias("s"), F.round(F.max(F.col(ts).cast("timestamp").cast("double")) - F.min(F.col(ts).cast("timestamp").cast("double")), 3).alias("seconds"),
    )
    return out.select(episode, "n_calls", "n_retries", failure_signature(F.col("e")).alias("last_error"), F.array_join("s.t", ",").alias("tools"), "seconds")


def handoffs(calls: DataFrame, group: str, agent: str, ts: str, tie: str) -> DataFrame:
    """group, from_agent, to_agent, gap: neighbours in time of different agents, and the seconds between them."""
    w = Window.partitionBy(group).orderBy(ts, tie)
    c = calls.select(group, agent, ts, tie, F.lag(agent).over(w).alias("from_agent"), F.lag(ts).over(w).alias("before"))
    gap = F.round(F.col(ts).cast("timestamp").cast("double") - F.col("before").cast("timestamp").cast("double"), 2)
    return c.where(F.col("from_agent") != F.col(agent)).select(group, tie, "from_agent", F.col(agent).alias("to_agent"), gap.alias("gap"))


def similar_failures(episodes: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """asked_id, episode_id, score: 1 for an equal signature, 0.5 for one within the other, and half the Jaccard share of tools; best k.

    Asked episodes meet those of the same tool or signature, by an equi-join on both.
    """
    e = episodes.select(F.col("episode_id"), F.col("signature"), F.array_distinct("tools").alias("tools"))
    a = asked.select(F.col("episode_id").alias("asked_id"), F.col("signature").alias("sig"), F.array_distinct("tools").alias("own"))
    keyed = e.select("*", F.explode(F.array_distinct(F.concat(F.transform("tools", lambda t: F.concat(F.lit("t:"), t)), F.array_compact(F.array(F.concat(F.lit("s:"), "signature")))))).alias("key"))
    wanted = a.select("*", F.explode(F.array_distinct(F.concat(F.transform("own", lambda t: F.concat(F.lit("t:"), t)), F.array_compact(F.array(F.concat(F.lit("s:"), "sig")))))).alias("key"))
    near = keyed.join(wanted, "key").where("episode_id <> asked_id").drop("key").dropDuplicates(["asked_id", "episode_id"])
    equal = F.coalesce(F.col("signature") == F.col("sig"), F.lit(False))
    inside = F.coalesce(F.contains("signature", "sig") | F.contains("sig", "signature"), F.lit(False))
    both = F.size(F.array_union("tools", "own"))
    score = F.when(equal, 1.0).when(inside, 0.5).otherwise(0.0) + F.when(both > 0, 0.5 * F.size(F.array_intersect("tools", "own")) / both).otherwise(0.0)
    scored = near.select("asked_id", "episode_id", F.round(score, 6).alias("score")).where("score > 0")
    w = Window.partitionBy("asked_id").orderBy(F.desc("score"), "episode_id")
    return scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
