"""Claims and tool calls as streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkmend.operators.governance import CLAIM_KEYS, FLOOR, VERDICTS, gate

KEPT = ("claim_id", "canonical", "claimant", "low", "high", "verdict")


def gated(claims: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Verdicts of streamed claims, by the same rule as in a batch.

    State is held by namespace, subject and relation: the claims stored so far, as JSON. Within a micro-batch claims are taken by asserted_at
    and id; one that comes in a later micro-batch is judged after all before it, whatever its time.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(["asserted_at", "claim_id"]).astype(object)
        rows = pdf.where(pdf.notna(), None).to_dict("records")
        out = gate(rows, known, floor)
        state.update((json.dumps([{k: r[k] for k in KEPT} for r in known]),))
        yield pd.DataFrame(out, columns=["claim_id", "write_verdict", "other_id", "note"]).astype({"other_id": "Int64"})

    return claims.groupBy(*CLAIM_KEYS).applyInPandasWithState(judge, VERDICTS, "known string", "append", GroupStateTimeout.NoTimeout)


def hourly_usage(calls: DataFrame, ts: str = "ts", agent: str = "user_id", tool: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """Calls by agent, tool and hour; hours close once the watermark has passed them."""
    return calls.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(F.window("__ts", "1 hour"), agent, tool).agg(F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("hour"), agent, tool, "calls")


def over_quota(calls: DataFrame, most: int, ts: str = "ts", agent: str = "user_id", span: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """agent, window end, calls: agents over their quota in any sliding window."""
    w = F.window("__ts", span, slide)
    out = calls.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(w, agent).agg(F.count(F.lit(1)).alias("calls"))
    return out.where(F.col("calls") > most).select(agent, F.col("window.end").alias("until"), "calls")


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first of each key; keys older than the watermark are forgotten."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
