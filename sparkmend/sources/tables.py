"""Readers: all-string CSV, text, records as sentences, mail, web pages, and a reader by extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend.functions.text import html_text
from sparkmend.sources.office import FORMATS, read_office


def all_strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, empty_is_null: bool = True, required: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, all columns strings, nothing guessed. Required columns that are missing raise an error that lists them."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if not empty_is_null:
        reader = reader.option("emptyValue", "").option("nullValue", "\x00")
    df = (reader.schema(all_strings(columns)) if columns else reader.option("inferSchema", False)).csv(path)
    if missing := [c for c in required or [] if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    if empty_is_null:
        return df.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns))
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns))


def renamed(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns by position under another table's names."""
    if len(df.columns) != len(like.columns):
        raise ValueError(f"{len(df.columns)} columns against {len(like.columns)}")
    return df.toDF(*like.columns)


def sentences(df: DataFrame, joiner: str = " | ") -> Column:
    """`column: value` of the filled cells of a row."""
    return F.concat_ws(joiner, *(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in df.columns))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_tree(spark: SparkSession, path: str, extensions: list[str], skip: tuple[str, ...] = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")) -> DataFrame:
    """path, text of the files below a folder with one of the extensions, without the skipped folders."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.endswith(F.lower("path"), F.lit(e.lower()))
    dirs = "|".join(s.replace(".", r"\.") for s in skip)
    return df.where(wanted & ~F.col("path").rlike(f"/({dirs})/"))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """path, text: From, To, Subject, Date and the plain parts of mail files, an Arrow batch of files at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_bytes, policy

        for pdf in batches:
            texts = []
            for raw in pdf["content"]:
                mail = message_from_bytes(bytes(raw), policy=policy.default)
                head = [f"{h}: {mail[h]}" for h in ("From", "To", "Subject", "Date") if mail[h]]
                body = [p.get_content().strip() for p in mail.walk() if p.get_content_type() == "text/plain"]
                texts.append("\n".join([*head, "", *body]))
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def read_pages(pages: DataFrame, url: str = "url", html: str = "html", shortest: int = 80, longest: int = 200_000) -> DataFrame:
    """url, text: pages as text with title and source in front; pages of too little text are left out."""
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    text = html_text(F.regexp_replace(html, r"(?is)<title[^>]*>.*?</title>", " "))
    out = pages.select(F.col(url).alias("url"), title.alias("__title"), text.alias("__text")).where(F.length("__text") >= shortest)
    return out.select("url", F.concat(F.lit("# "), "__title", F.lit("\nSource: "), "url", F.lit("\n\n"), F.substring("__text", 1, longest)).alias("text"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".txt": read_text,
    ".md": read_text,
    ".csv": lambda spark, path: (lambda df: df.select(F.lit(path).alias("path"), sentences(df).alias("text")))(read_csv(spark, path)),
    ".eml": read_mail,
    **{kind: lambda spark, path: read_office(spark, path).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text")) for kind in FORMATS},
}


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """path, text by the extension's reader; others can be put in READERS (scans, recordings)."""
    dot = path[path.rfind(".") :].lower()
    if dot not in READERS:
        raise ValueError(f"no reader for {dot or path}")
    return READERS[dot](spark, path)


def transcript(text: DataFrame, key: str, line_no: str, line: str) -> DataFrame:
    """key, message, role, text of transcripts in lines: `role: words` begins a message, other lines go on with it."""
    from pyspark.sql import Window

    roles = {"user": "user", "human": "user", "you": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant"}
    head = r"(?i)^\s*(user|human|you|assistant|ai|bot)\s*:\s?(.*)$"
    w = Window.partitionBy(key).orderBy(line_no)
    named = F.nullif(F.lower(F.regexp_extract(line, head, 1)), F.lit(""))
    rows = text.withColumn("__r", named).withColumn("__m", F.sum(F.col("__r").isNotNull().cast("int")).over(w)).where("__m > 0")
    known = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
    body = F.when(F.col("__r").isNotNull(), F.regexp_extract(line, head, 2)).otherwise(F.col(line))
    parts = rows.select(key, F.col("__m").alias("message"), line_no, "__r", body.alias("__b")).groupBy(key, "message").agg(F.max("__r").alias("__r"), F.array_join(F.sort_array(F.collect_list(F.struct(line_no, "__b")))["__b"], "\n").alias("text"))
    return parts.select(key, "message", F.try_element_at(known, F.col("__r")).alias("role"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def iri_tail(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def date_prefix(c: Column) -> Column:
    """The first ten characters of a time stamp, if it begins with a year (a minus in front allowed)."""
    return F.when(c.rlike("^-?[0-9]{4}"), F.substring(c, 1, 10))


def events_of(awards: DataFrame, prize: str = "prize", year: str = "year") -> DataFrame:
    """event_id, name, prize, year: the distinct pairs by year and prize, numbered from EV0000."""
    from sparkmend.operators.order import ranked_all

    pairs = awards.where(F.col(prize).isNotNull() & F.col(year).isNotNull()).select(F.col(prize).alias("prize"), F.col(year).cast("string").alias("year")).distinct()
    named = ranked_all(pairs, ["year", "prize"])
    return named.select(F.format_string("EV%04d", F.col("rank") - 1).alias("event_id"), F.concat_ws(" ", "prize", "year").alias("name"), "prize", "year")


def load_people(raw: DataFrame, places: DataFrame) -> DataFrame:
    """person_id, name, birth_date, death_date, gender, birth_place_id, death_place_id from rows of addresses and time stamps.

    One row a person, the first by `pos`; labels that are only an item number are left out; places that are not there become null.
    """
    from sparkmend.operators.vote import keep_first

    ids = ("person", "birth_place", "death_place")
    named = raw.where(~F.col("name").rlike(r"^Q[0-9]+$")).select("pos", "name", *(iri_tail(F.col(c)).alias(c) for c in ids), *(date_prefix(F.col(c)).alias(c) for c in ("birth_date", "death_date")), "gender")
    people = keep_first(named, ["person"], F.col("pos"))
    for c in ("birth_place", "death_place"):
        known = places.select(F.col("place_id").alias(f"{c}_id")).distinct()
        people = people.join(known, F.col(c) == F.col(f"{c}_id"), "left")
    return people.select(F.col("person").alias("person_id"), "name", "birth_date", "death_date", "gender", "birth_place_id", "death_place_id", "pos")


ARTIFACT_KEYS = ("goals", "user_stories", "requirements", "files", "dependencies", "interfaces", "shared_knowledge")


def artifact_claims(artifacts: DataFrame, key: str, body: str) -> DataFrame:
    """key, relation, object: statements of planning documents in JSON. Lists are sorted and joined; interfaces give a statement for each
    `Class.method(signature)`."""
    schema = ", ".join(f"{k} array<string>" for k in ARTIFACT_KEYS if k != "interfaces") + ", interfaces string"
    parsed = artifacts.select(F.col(key).alias("key"), F.from_json(body, schema).alias("j"))
    lists = [F.struct(F.lit(k).alias("relation"), F.array_join(F.sort_array(F.col(f"j.{k}")), "; ").alias("object")) for k in ARTIFACT_KEYS if k != "interfaces"]
    plain = parsed.select("key", F.explode(F.array(*lists)).alias("x")).select("key", "x.relation", "x.object").where("object <> ''")
    blocks = parsed.select("key", F.explode(F.split(F.coalesce(F.col("j.interfaces"), F.lit("")), r"(?=\bclass\s)")).alias("b")).withColumn("c", F.regexp_extract("b", r"class\s+(\w+)", 1)).where("c <> ''")
    methods = blocks.select("key", "c", F.explode(F.regexp_extract_all("b", F.lit(r"[+\-]?\s*(\w+\([^)]*\))"), F.lit(1))).alias("m"))
    return plain.unionByName(methods.select("key", F.lit("interface").alias("relation"), F.concat("c", F.lit("."), "m").alias("object")))
