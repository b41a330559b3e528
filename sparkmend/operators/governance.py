"""Claims: conflicts, the admission gate, trust, calibration, quotas and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.operators.order import ranked_all

FLOOR = 0.35
TRUST = {"accepted": 2, "confirmed": 6, "conflicted": -3, "retracted": -25, "lost": -60, "won": 30}
CLAIM_KEYS = ["namespace", "subject", "relation"]
VERDICTS = "claim_id long, write_verdict string, other_id long, note string"


def open_interval(low: Column, high: Column) -> tuple[Column, Column]:
    return F.coalesce(low, F.lit(-9999)), F.coalesce(high, F.lit(9999))


def conflicts(claims: DataFrame) -> DataFrame:
    """a, b: claims of one namespace, subject and relation whose validity overlaps and whose values differ (a < b)."""
    a, b = claims.alias("a"), claims.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in CLAIM_KEYS]
    a_low, a_high = open_interval(F.col("a.valid_from"), F.col("a.valid_until"))
    b_low, b_high = open_interval(F.col("b.valid_from"), F.col("b.valid_until"))
    on = (F.col("a.claim_id") < F.col("b.claim_id")) & (F.col("a.canonical") != F.col("b.canonical")) & (a_low <= b_high) & (b_low <= a_high)
    for s in same:
        on = on & s
    return a.join(b, on).select(F.col("a.claim_id").alias("a"), F.col("b.claim_id").alias("b"))


def gate(rows: list[dict], known: list[dict], floor: float = FLOOR) -> list[tuple[int, str, int | None, str]]:
    """Verdicts of new claims of one key in their order, against `known`, which grows. The sequential rule that batch and stream share.

    Below the floor a claim is quarantined, once for a value and claimant. The same value by the same claimant reasserts. Else the stored claims are
    looked through in order: the same value confirms, a value of other times supersedes, and the first other value of
    the same times is a conflict and ends the search.
    """
    out = []
    for r in rows:
        low, high = (r["valid_from"] if r["valid_from"] is not None else -9999), (r["valid_until"] if r["valid_until"] is not None else 9999)
        r = r | {"low": low, "high": high}
        alike = [k for k in known if k["canonical"] == r["canonical"] and k["claimant"] == r["claimant"]]
        if (r["confidence"] or 0.0) < floor:
            if alike:
                out.append((r["claim_id"], "DUPLICATE", alike[0]["claim_id"], "quarantined before" if alike[0]["verdict"] == "QUARANTINED" else "known"))
            else:
                out.append((r["claim_id"], "QUARANTINED", None, ""))
                known.append(r | {"verdict": "QUARANTINED"})
            continue
        stored = [k for k in known if k["verdict"] != "QUARANTINED"]
        again = [k for k in stored if k["canonical"] == r["canonical"] and k["claimant"] == r["claimant"]]
        if again:
            out.append((r["claim_id"], "REASSERTED", again[0]["claim_id"], ""))
            continue
        verdict, other, notes = "ACCEPTED", None, []
        for k in stored:
            if k["canonical"] == r["canonical"]:
                notes.append(f"confirms {k['claim_id']}")
            elif low > k["high"] or k["low"] > high:
                notes.append(f"supersedes {k['claim_id']}")
            else:
                verdict, other = "CONFLICTED", k["claim_id"]
                break
        known.append(r | {"verdict": verdict})
        out.append((r["claim_id"], verdict, other, "; ".join(notes)))
    return out


def admit(claims: DataFrame, floor: float = FLOOR) -> DataFrame:
    """claim_id, write_verdict, other_id, note for a batch, each key in order of asserted_at and id.

    A key's claims must be judged in order, so a key is the unit of work; different keys are judged side by side. Claims without subject or relation
    are REJECTED and take no part.
    """
    bad = F.coalesce(F.trim("subject"), F.lit("")) == F.lit("")
    bad = bad | (F.coalesce(F.trim("relation"), F.lit("")) == F.lit(""))
    rejected = claims.where(bad).select("claim_id", F.lit("REJECTED").alias("write_verdict"), F.lit(None).cast("long").alias("other_id"), F.lit("").alias("note"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in CLAIM_KEYS)
                if own != key:
                    key, known = own, []
                out += gate([row], known, floor)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["claim_id", "write_verdict", "other_id", "note"])

    needed = ["claim_id", *CLAIM_KEYS, "canonical", "claimant", "valid_from", "valid_until", "confidence"]
    # sorted keys one behind the other in each partition: no call and no frame for each key
    dealt = claims.where(~bad).repartition(*CLAIM_KEYS).sortWithinPartitions(*CLAIM_KEYS, "asserted_at", "claim_id").select(*needed)
    return dealt.mapInArrow(judge, VERDICTS).unionByName(rejected)


def trailing_count(keys: list[str], time: str, seconds: int = 3600) -> Column:
    """Rows of the key in the seconds up to and with this row."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return F.count(F.lit(1)).over(w)


def trust_scores(signals: DataFrame, agent: str) -> DataFrame:
    """agent, score, band from signals(agent, kind, n): 500 and the weighted signals, kept within 0 and 1000."""
    known = F.create_map(*(F.lit(x) for pair in TRUST.items() for x in pair))
    total = F.coalesce(F.sum(F.try_element_at(known, F.col("kind")) * F.col("n")), F.lit(0)) + 500
    out = signals.groupBy(agent).agg(F.least(F.lit(1000), F.greatest(F.lit(0), total)).cast("long").alias("score"))
    s = F.col("score")
    return out.withColumn("band", F.when(s >= 700, "high").when(s >= 450, "normal").when(s >= 250, "low").otherwise("untrusted"))


def calibration(df: DataFrame, confidence: str, right: str, tie: str, bins: int = 8) -> DataFrame:
    """bin, edge, accuracy, n: rows by confidence in chunks of a bins-th (the rest is a bin more), each chunk's highest confidence and share of right ones."""
    ranked = ranked_all(df.select(confidence, right, tie), [confidence, tie])
    n = df.count()
    step = max(1, n // bins)
    out = ranked.groupBy(F.floor((F.col("rank") - 1) / step).cast("long").alias("bin"))
    return out.agg(F.max(confidence).alias("edge"), F.round(F.avg(F.col(right).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def calibrated(confidence: Column, bins: list[tuple[float, float]]) -> Column:
    """The accuracy of the first bin whose edge is above the confidence, else of the last; a confidence on an edge belongs to the next bin."""
    out = None
    for edge, accuracy in bins[:-1]:
        out = F.when(confidence < edge, accuracy) if out is None else out.when(confidence < edge, accuracy)
    return F.lit(bins[-1][1]) if out is None else out.otherwise(bins[-1][1])


def contradictions(triples: DataFrame) -> DataFrame:
    """subject, relation, n_values, n_sources, values: relations with two values or more that hold a digit, from two sources or more."""
    numeric = triples.where(F.col("canonical").rlike("[0-9]"))
    out = numeric.groupBy("subject", "relation").agg(F.count_distinct("canonical").alias("n_values"), F.count_distinct("source").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("canonical")), "|").alias("values"))
    return out.where("n_values >= 2 and n_sources >= 2")


def adjudicate(conflict_sides: DataFrame, winners: DataFrame) -> DataFrame:
    """conflict_id, claim_id, verdict, retracted after the decisions winners(conflict_id, claim_id): the winner is ACCEPTED, the others are retracted; undecided conflicts stay."""
    w = winners.select("conflict_id", F.col("claim_id").alias("winner"))
    out = conflict_sides.join(w, "conflict_id", "left")
    won = F.col("claim_id") == F.col("winner")
    return out.select("conflict_id", "claim_id", F.when(F.col("winner").isNull(), "CONFLICTED").when(won, "ACCEPTED").otherwise("RETRACTED").alias("verdict"), F.coalesce(~won, F.lit(False)).alias("retracted"))


def retained(calls: DataFrame, episodes: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Calls younger than `days`, and all of episodes that failed or ended in part."""
    kept = episodes.where(F.col("outcome").isin("FAILURE", "PARTIAL")).select("episode_id").distinct().withColumn("__k", F.lit(True))
    return calls.join(kept, "episode_id", "left").where((F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))) | F.coalesce("__k", F.lit(False))).drop("__k")


def allowed(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """The claims with `allowed`: an agent without a policy may write all, one with policies the named relations or, by `*`, any. Policies are
    policies(namespace, agent_id, relation)."""
    told = policies.groupBy("namespace", "agent_id").agg(F.collect_set("relation").alias("__may"))
    out = claims.join(told, ["namespace", "agent_id"], "left")
    return out.withColumn("allowed", F.col("__may").isNull() | F.array_contains("__may", "*") | F.coalesce(F.array_contains("__may", F.col("relation")), F.lit(False))).drop("__may")


def within_quota(claims: DataFrame, most: int, seconds: int = 3600) -> DataFrame:
    """The claims with `throttled`: more than `most` written ones of the namespace and agent in the time up to it, itself included.

    Every claim counts that was submitted, so a batch cannot exceed what single claims could not.
    """
    return claims.withColumn("throttled", trailing_count(["namespace", "agent_id"], "asserted_at", seconds) > most)
