"""Small helpers shared by the operators: selecting the columns they read, and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that others with clashing names cannot interfere."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches of long texts into pieces of bounded size (one row at least). At the end memory that Arrow keeps for reuse goes back: workers live on."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, int(rows * most_bytes / max(1, batch.nbytes))))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for the table to have none of them in any case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lowered(text: str) -> str:
    """A-Z as a-z, all else as it is: what lower() does to bytes."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
