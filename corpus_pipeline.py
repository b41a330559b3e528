"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, and sampled pieces.

Each stage is one operator over all documents its predecessor kept, with its decisions carried out. Stages but the last
return the columns of documents, with n_chars kept true where a text changes; the last adds piece_ids, which decode to the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.llm.columns import read
from sparkmend.llm.decontam import remove_hits
from sparkmend.llm.langid import fit, keep_with_language
from sparkmend.llm.line_dedup import drop_repeated_lines
from sparkmend.llm.piece_sampling import with_pieces
from sparkmend.llm.simhash import keep_one_of_each
from sparkmend.operators.shared import written


def counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is; a null text keeps what it had."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, without a letter, or in a script no labelled document has) go."""
    return keep_with_language(docs, fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays."""
    return counted(drop_repeated_lines(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles about 0.8 alike) stays, that of the least id."""
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words and more that benchmark items have are cut out."""
    return counted(remove_hits(docs, read(spark, sf_dir, "benchmark")))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their sampled piece ids."""
    return with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("piece_sampling", pieces_stage),
]
# Edit distance, fingerprints and draws are beyond SQL; tests hold the stages, one behind the other, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
