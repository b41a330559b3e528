"""Small ranking and reporting operators: search, percentiles, leader clustering, recall, beam queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.operators.components import connected_components
from sparkmend.operators.order import ranked_all


def find(nodes: DataFrame, label: str, node: str, term: str, limit: int = 20) -> DataFrame:
    """node, label, exact: labels equal to the term, or ids that end in it, before those that hold it."""
    t, low = term.lower(), F.lower(label)
    exact = (low == t) | F.endswith(F.lower(F.col(node).cast("string")), F.lit(":" + t)) | F.endswith(low, F.lit(t))
    return nodes.where(exact | F.contains(low, F.lit(t))).select(node, label, exact.alias("exact")).orderBy(F.desc("exact"), node).limit(limit)


def sorted_percentiles(df: DataFrame, value: str, tie: str) -> DataFrame:
    """p50 and p95 by position in the sorted list: [n // 2] and [int(.95 n) - 1]."""
    n = df.where(F.col(value).isNotNull()).count()
    r = ranked_all(df.where(F.col(value).isNotNull()).select(value, tie), [value, tie])
    at = {"p50": n // 2 + 1, "p95": max(1, int(0.95 * n))}
    return r.agg(*(F.max(F.when(F.col("rank") == k, F.col(value))).alias(name) for name, k in at.items()))


def leader_clusters(items: DataFrame, pairs: DataFrame, item: str, name: str) -> DataFrame:
    """item, leader, canonical: within each component of similar pairs, in order of item, the first without a leader leads all it is similar to;
    the shortest name of a cluster is canonical (the first of equals). Items without a pair lead themselves."""
    comps = connected_components(pairs, "a", "b")
    rows = comps.join(items.select(F.col(item).alias("node"), F.col(name).alias("__name")), "node").select("component", F.col("node").alias("a"), F.lit(None).cast(pairs.schema["a"].dataType).alias("b"), F.col("__name").alias("name"))
    links = pairs.join(comps.withColumnRenamed("node", "a"), "a").select("component", "a", "b", F.lit(None).cast("string").alias("name"))

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {a: n for a, b, n in zip(pdf["a"], pdf["b"], pdf["name"]) if pd.isna(b)}
        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            if not pd.isna(b):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        leader: dict = {}
        for a in sorted(names):
            if a not in leader:
                leader[a] = a
                for b in near.get(a, ()):
                    leader.setdefault(b, a)
        best: dict = {}
        for a in sorted(names):
            k = leader[a]
            if k not in best or len(names[a] or "") < len(best[k] or ""):
                best[k] = names[a]
        return pd.DataFrame({"item": list(leader), "leader": list(leader.values()), "canonical": [best[k] for k in leader.values()]})

    kind = comps.schema["node"].dataType.simpleString()
    found = rows.unionByName(links).groupBy("component").applyInPandas(lead, f"item {kind}, leader {kind}, canonical string")
    alone = items.select(F.col(item).alias("item"), F.col(name).alias("canonical")).join(found.select("item"), "item", "left_anti").select("item", F.col("item").alias("leader"), "canonical")
    return found.unionByName(alone)


def supersede_copies(items: DataFrame, pairs: DataFrame, item: str, confidence: str, time: str) -> DataFrame:
    """loser, winner: in order of pairs, the one of lower confidence, then older, gives way, unless either did before."""
    facts = items.select(F.col(item).alias("node"), F.col(confidence).alias("c"), F.col(time).cast("string").alias("t"))
    comps = connected_components(pairs, "a", "b")
    links = pairs.join(comps.withColumnRenamed("node", "a"), "a")
    for s in "ab":
        links = links.join(facts.select(F.col("node").alias(s), F.col("c").alias(f"c_{s}"), F.col("t").alias(f"t_{s}")), s)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: dict = {}
        for r in sorted(pdf.itertuples(index=False), key=lambda r: (r.a, r.b)):
            if r.a not in gone and r.b not in gone:
                low, high = (r.a, r.b) if (r.c_a, r.t_a) < (r.c_b, r.t_b) else (r.b, r.a)
                gone[low] = high
        return pd.DataFrame({"loser": list(gone), "winner": list(gone.values())})

    kind = comps.schema["node"].dataType.simpleString()
    return links.groupBy("component").applyInPandas(settle, f"loser {kind}, winner {kind}")


def best_target(scored: DataFrame, key: str, target: str, score: str, least: float) -> DataFrame:
    """key, target, score: the best target of each key, if it is good enough; the least target of equals."""
    good = scored.where(F.col(score) >= least)
    best = F.max_by(F.struct(target, score), F.struct(F.col(score), -F.col(target)))
    return good.groupBy(key).agg(best.alias("b")).select(key, f"b.{target}", f"b.{score}")


def distinct_labels(scored: DataFrame, keys: list[str], label: str, score: str, tie: str, least: float, k: int) -> DataFrame:
    """The k best rows of each key above `least`, one a label."""
    w = Window.partitionBy(*keys, label).orderBy(F.desc(score), tie)
    first = scored.where(F.col(score) >= least).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    r = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return first.withColumn("__n", F.row_number().over(r)).where(F.col("__n") <= k).drop("__n")


def paged(df: DataFrame, order: list[str], offset: int, limit: int, holds: str | None = None, equal: dict[str, str] | None = None) -> DataFrame:
    """A page of the rows that have the given values and hold a string anywhere."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    if holds:
        df = df.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(holds.lower())))
    return df.orderBy(*order).offset(offset).limit(limit)


def visible(namespace: Column, own: str) -> Column:
    return namespace.isNull() | (namespace == own)


def timeline(stages: list[tuple[str, DataFrame]], measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage, and what `measure` gives (one row), for the table after each stage."""
    out = None
    for i, (name, df) in enumerate(stages):
        row = measure(df).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "*")
        out = row if out is None else out.union(row)
    return out
