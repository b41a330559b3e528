"""Majority votes, functional dependencies and the repairs that rest on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.operators.shared import written


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value, votes, total, share, first: each group's most frequent value, of equals that seen first.

    Null values don't vote. Two partial aggregations, so a hot group's rows are summed before they meet.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    best = F.max_by(F.struct(value, "votes", "first"), F.struct(F.col("votes"), -F.col("first")))
    return counted.groupBy(*keys).agg(best.alias("b"), F.sum("votes").alias("total")).select(*keys, F.col(f"b.{value}").alias(value), "b.votes", "total", (F.col("b.votes") / F.col("total")).alias("share"), "b.first")


def fd_confidence(df: DataFrame, pairs: list[tuple[str, str]], least_multi: float = 0.3) -> DataFrame:
    """lhs, rhs, confidence of each dependency, over groups of two rows or more.

    Pairs whose left side repeats in less than least_multi of the rows, or has fewer than two values, are left out. All pairs go through one
    unpivot and two aggregations.
    """
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(a).alias("lhs"), F.lit(b).alias("rhs"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs))).alias("x")).select("x.*")
    counts = cells.groupBy("lhs", "rhs", "a", "b").agg(F.count("*").alias("n"))
    groups = counts.groupBy("lhs", "rhs", "a").agg(F.max("n").alias("most"), F.sum("n").alias("size"))
    multi = F.col("size") >= 2
    told = groups.groupBy("lhs", "rhs").agg(
        F.sum(F.when(multi, F.col("most"))).alias("agree"), F.sum(F.when(multi, F.col("size"))).alias("multi"), F.sum("size").alias("rows"), F.count("*").alias("values")
    )
    told = told.where((F.col("multi") >= least_multi * F.col("rows")) & (F.col("values") >= 2))
    return told.select("lhs", "rhs", (F.col("agree") / F.col("multi")).alias("confidence"))


def fd_repair(df: DataFrame, lhs: str, rhs: str, order: str, least_share: float = 0.7) -> DataFrame:
    """The rows with `repaired` (the right side's majority where its share suffices, else the value) and `changed`."""
    vote = majority(df, [lhs], rhs, order).select(F.col(lhs).alias("__k"), F.col(rhs).alias("__v"), F.col("share").alias("__s"))
    good = F.col("__s") >= least_share
    out = df.join(vote, F.col(lhs) == F.col("__k"), "left").withColumn("repaired", F.when(good, F.col("__v")).otherwise(F.col(rhs)))
    return out.withColumn("changed", ~F.col("repaired").eqNullSafe(F.col(rhs))).drop("__k", "__v", "__s")


def repair_round(df: DataFrame, fds: list[tuple[str, str]], row_id: str, least_share: float = 0.6, rare: int = 2) -> DataFrame:
    """One pass over the dependencies in order, each seeing what those before changed.

    A value is replaced if its group has three rows or more, another value has over half of them, two votes or more,
    no equal, and at least least_share, and the value itself is there at most `rare` times in the group.
    """
    for k, (a, b) in enumerate(fds):
        counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), b)))
        groups = counts.groupBy(a).agg(F.sum("n").alias("size"), F.slice(ranked, 1, 2).alias("top")).where((F.col("size") >= 3) & (F.col(a) != ""))
        best, votes = F.col(f"top.{b}")[0], -F.col("top.minus")[0]
        tied = (F.size("top") > 1) & (F.col("top.minus")[0] == F.try_element_at(F.col("top.minus"), F.lit(2)))
        wins = groups.where((votes >= 2) & (votes * 2 > F.col("size")) & (votes >= least_share * F.col("size")) & ~F.coalesce(tied, F.lit(False))).select(F.col(a).alias("__a"), best.alias("__best"))
        own = counts.where(F.col("n") <= rare).select(F.col(a).alias("__a2"), F.col(b).alias("__b2"))
        out = df.join(wins, F.col(a) == F.col("__a"), "left").join(own, (F.col(a) == F.col("__a2")) & (F.col(b) == F.col("__b2")), "left")
        fixed = F.when(F.col("__best").isNotNull() & F.col("__a2").isNotNull(), F.col("__best")).otherwise(F.col(b))
        df = out.withColumn(b, fixed).select(*df.columns)
        if k % 10 == 9:
            df = written(df, "fd_repair")
    return df


def repair_by_fds(df: DataFrame, row_id: str, columns: list[str], least_confidence: float = 0.9, rounds: int = 3) -> DataFrame:
    """Finds the dependencies among columns and repairs in up to `rounds` passes, until a pass changes no cell."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    found = {(r.lhs, r.rhs) for r in fd_confidence(df, pairs).where(F.col("confidence") >= least_confidence).collect()}
    fds = [p for p in pairs if p in found]
    if not fds:
        return df
    for _ in range(rounds):
        new = written(repair_round(df, fds, row_id), "fd_round")
        before, after = (x.select(F.col(row_id).alias(row_id), F.xxhash64(*columns).alias("h")) for x in (df, new))
        changed = before.withColumnRenamed("h", "g").join(after, row_id).where("g <> h").limit(1).count()
        df = new
        if not changed:
            break
    return df


def truth_round(cells: DataFrame, weights: DataFrame | None, start: float = 0.8) -> DataFrame:
    """One round of truth discovery over cells(key, src, attr, val, pos): key, attr, val, weight of the heaviest value."""
    weighed = cells.withColumn("w", F.lit(start)) if weights is None else cells.join(weights, "src", "left").withColumn("w", F.coalesce("w", F.lit(start)))
    votes = weighed.groupBy("key", "attr", "val").agg(F.round(F.sum("w"), 9).alias("w"), F.min("pos").alias("first"))
    best = F.max_by(F.struct("val", "w"), F.struct(F.col("w"), -F.col("first")))
    return votes.groupBy("key", "attr").agg(best.alias("b")).select("key", "attr", "b.val", F.col("b.w").alias("weight"))


def source_weights(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """src, w: (agreeing cells + 1) / (cells + 2)."""
    agree = F.sum(F.when(F.col("val") == F.col("t"), 1).otherwise(0))
    return cells.join(truth.select("key", "attr", F.col("val").alias("t")), ["key", "attr"]).groupBy("src").agg(((agree + 1) / (F.count("*") + 2)).alias("w"))


def truth_discovery(cells: DataFrame, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Truth and source weights after `rounds` rounds; weights are one small row a source."""
    cells = written(cells.where(F.col("val").isNotNull()), "cells")
    weights = None
    for _ in range(rounds):
        truth = written(truth_round(cells, weights), "truth")
        weights = written(source_weights(cells, truth), "weights")
    return truth, weights


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str = "attr", value: str = "val") -> DataFrame:
    cells = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns))
    return df.select(*keys, F.explode(cells).alias("__x")).select(*keys, f"__x.{name}", f"__x.{value}")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def profile_shapes(df: DataFrame, columns: list[str], of) -> DataFrame:
    """attr, shape, n for each column."""
    return unpivoted(df, [], columns).where("val is not null").groupBy("attr", of(F.col("val")).alias("shape")).agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
