"""Quality of tables without a clean copy, and scores against one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmend.functions.text import is_placeholder
from sparkmend.operators.vote import union_all


def column_quality(df: DataFrame, table: str, rules: dict[str, str | None]) -> DataFrame:
    """tbl, col, cells, filled, valid: one row a required column. `rules` gives each column's pattern, None for any value.

    All columns are counted in one pass over the table, then turned into rows.
    """
    parts = []
    for c, pattern in rules.items():
        text = F.col(c).cast("string")
        filled = ~is_placeholder(text)
        valid = filled & (text.rlike(pattern) if pattern else F.lit(True))
        parts.append(F.struct(F.lit(table).alias("tbl"), F.lit(c).alias("col"), F.count(F.lit(1)).alias("cells"), F.count(F.when(filled, 1)).alias("filled"), F.count(F.when(valid, 1)).alias("valid")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def integrity(refs: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """ref, cells, good: filled references that exist in the other table's key, for each (name, table, column, other, key)."""
    out = []
    for name, df, c, other, key in refs:
        keys = other.select(F.col(key).alias("__k")).where("__k is not null").distinct()
        joined = df.select(F.col(c).alias("__c")).where("__c is not null").join(keys, F.col("__c") == F.col("__k"), "left")
        out.append(joined.agg(F.count(F.lit(1)).alias("cells"), F.count("__k").alias("good")).select(F.lit(name).alias("ref"), "cells", "good"))
    return union_all(out)


def duplicates(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One row: rows, and how many are more than their key's first."""
    groups = df.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, n: how many rows each rule's frame holds."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in rules.items()])


def precision_recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """precision, recall, f1 of a set of rows against another of the same columns; empty sets are right.

    One full outer join by row, so nothing but three counts reaches the last aggregation.
    """
    cols = true.columns
    both = found.select(*cols).distinct().withColumn("__f", F.lit(1)).join(true.distinct().withColumn("__t", F.lit(1)), cols, "full")
    n = both.agg(F.count("__f").alias("f"), F.count("__t").alias("t"), F.count(F.when(F.col("__f").isNotNull() & F.col("__t").isNotNull(), 1)).alias("b"))
    p, r = F.when(F.col("f") > 0, F.col("b") / F.col("f")).otherwise(1.0), F.when(F.col("t") > 0, F.col("b") / F.col("t")).otherwise(1.0)
    return n.select(F.col("b").alias("hits"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def repair_score(dirty: DataFrame, repaired: DataFrame, clean: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """precision, recall, f1 of repaired cells: right among changed ones, and right among those that were wrong."""
    frames = [x.select(F.col(row_id), *(F.col(c).alias(f"{c}__{k}") for c in columns)) for k, x in (("d", dirty), ("r", repaired), ("c", clean))]
    joined = frames[0].join(frames[1], row_id).join(frames[2], row_id)

    def cells(test) -> Column:
        return sum((F.sum(F.when(test(F.col(f"{c}__d"), F.col(f"{c}__r"), F.col(f"{c}__c")), 1).otherwise(0)) for c in columns), F.lit(0))

    n = joined.agg(
        cells(lambda d, r, c: ~d.eqNullSafe(r)).alias("changed"),
        cells(lambda d, r, c: ~d.eqNullSafe(r) & r.eqNullSafe(c)).alias("right"),
        cells(lambda d, r, c: ~d.eqNullSafe(c)).alias("wrong"),
    )
    p, r = (F.when(F.col(x) > 0, F.col("right") / F.col(x)).otherwise(0.0) for x in ("changed", "wrong"))
    return n.select("changed", "right", "wrong", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 3).alias("f1"))


def rank_metrics(ranked: DataFrame, gold: DataFrame, query: str, item: str, rank: str, k: int = 10) -> DataFrame:
    """queries, hit1, hit5, recall_k, mrr over ranked(query, item, rank from 1) against gold(query, item)."""
    g = gold.select(query, item).distinct()
    size = g.groupBy(query).agg(F.count(F.lit(1)).alias("__n"))
    hits = ranked.join(g, [query, item], "left_semi").groupBy(query).agg(F.min(rank).alias("__best"), F.count(F.when(F.col(rank) <= k, 1)).alias("__found"))
    per = size.join(hits, query, "left")
    found = F.coalesce("__found", F.lit(0))
    mean = lambda c: F.round(F.avg(c), 6)
    return per.agg(
        F.count(F.lit(1)).alias("queries"), mean(F.when(F.col("__best") <= 1, 1.0).otherwise(0.0)).alias("hit1"), mean(F.when(F.col("__best") <= 5, 1.0).otherwise(0.0)).alias("hit5"),
        mean(found / F.col("__n")).alias("recall_k"), mean(F.coalesce(1.0 / F.col("__best"), F.lit(0.0))).alias("mrr"),
    )
