"""Sinks: exports, diff upserts of a store of Parquet tables, incremental digests, graph export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.operators.shared import written


def export(frames: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """Each frame as one file set below the folder; arrays joined by commas for CSV."""
    for name, df in frames.items():
        flat = df.select(*(F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if f.dataType.typeName() == "array" and form == "csv" else F.col(f.name) for f in df.schema.fields))
        writer = flat.write.mode("overwrite")
        (writer.option("header", True).csv if form == "csv" else writer.json if form == "json" else writer.parquet)(f"{folder}/{name}")


def content_hash(df: DataFrame, keys: list[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*(c for c in df.columns if c not in keys))))


def changed_rows(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not stored or whose content is another."""
    old = stored.select(*(F.col(k).alias(f"__{k}") for k in keys), content_hash(stored, keys).alias("__old"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = new.withColumn("__new", content_hash(new, keys)).join(old, on, "left")
    return joined.where("__old is null or __old <> __new").select(*new.columns)


def upsert(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The store with the changed rows put in: the new row of a key wins. Rows that stayed are not rewritten by a later changed_rows."""
    changed = written(changed_rows(new, stored, keys), "changed")
    rest = stored.join(changed.select(*(F.col(k).alias(f"__{k}") for k in keys)), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    return rest.unionByName(changed, allowMissingColumns=True)


def file_changes(now: DataFrame, before: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, state: unchanged files can be reused, changed and new ones are parsed again, dropped ones forgotten. By SHA-1 of the content."""
    a = now.select(F.col(path).alias("path"), F.sha1(F.col(text).cast("binary")).alias("h"))
    b = before.select(F.col(path).alias("path"), F.sha1(F.col(text).cast("binary")).alias("g"))
    state = F.when(F.col("g").isNull(), "new").when(F.col("h").isNull(), "dropped").when(F.col("g") == F.col("h"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, plane, size: 3 + 0.55 a link, up to 18 links."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    size = F.round(3 + F.least(F.coalesce("d", F.lit(0)), F.lit(18)) * 0.55, 2)
    return nodes.join(degree, "node", "left").select("node", "plane", size.alias("size"))


def empty_store(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
