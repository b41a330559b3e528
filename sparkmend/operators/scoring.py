"""Scores and rules of evaluation, claims and memory that are one projection or aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corroboration(edges: DataFrame, relation: str = "confirms") -> DataFrame:
    """node, n: `confirms` links at the node, either way."""
    return edges.where(F.col("relation") == relation).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def provenance(claims: DataFrame, claim_id: str, sources: str, known: DataFrame, known_id: str, known_at: str, asserted_at: str, context_only: str) -> DataFrame:
    """src, dst, relation: a stored earlier claim among the sources is a premise (derived_from, or informed_by if only context), other sources ground."""
    rows = claims.select(F.col(claim_id).alias("src"), F.col(asserted_at).alias("__t"), F.col(context_only).alias("__c"), F.explode(F.slice(sources, 1, 8)).alias("dst"))
    k = known.select(F.col(known_id).alias("__k"), F.col(known_at).alias("__at"))
    joined = rows.join(k, F.col("dst") == F.col("__k"), "left")
    premise = F.coalesce(F.col("__at") < F.col("__t"), F.lit(False))
    out = joined.where(F.col("__k").isNull() | premise)
    return out.select("src", "dst", F.when(F.col("__k").isNull(), "grounds").when(F.col("__c"), "informed_by").otherwise("derived_from").alias("relation"))


def pairwise_scores(found: DataFrame, true: DataFrame, item: str, cluster: str) -> DataFrame:
    """pairs found, true and in both, precision, recall, f1 over pairs that share a cluster; counted from cluster sizes, no pair is made."""
    pairs = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("long").alias("n"))
    both = found.select(item, F.col(cluster).alias("f")).join(true.select(item, F.col(cluster).alias("t")), item)
    n = pairs(found, cluster).select(F.col("n").alias("found")).join(pairs(true, cluster).select(F.col("n").alias("true"))).join(pairs(both, "f", "t").select(F.col("n").alias("hits")))
    p, r = F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(1.0), F.when(F.col("true") > 0, F.col("hits") / F.col("true")).otherwise(1.0)
    return n.select("found", "true", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def cell_accuracy(rows: DataFrame, columns: list[str], dirty: str = "d", clean: str = "c", repaired: str = "r") -> DataFrame:
    """before, after, harmed: shares of right cells, and cells that were right and no longer are; columns are named column_suffix."""
    right = lambda s: sum((F.sum(F.col(f"{c}_{s}").eqNullSafe(F.col(f"{c}_{clean}")).cast("int")) for c in columns), F.lit(0))
    harmed = sum((F.sum((F.col(f"{c}_{dirty}").eqNullSafe(F.col(f"{c}_{clean}")) & ~F.col(f"{c}_{repaired}").eqNullSafe(F.col(f"{c}_{clean}"))).cast("int")) for c in columns), F.lit(0))
    n = F.count(F.lit(1)) * len(columns)
    return rows.agg(F.round(right(dirty) / n, 6).alias("before"), F.round(right(repaired) / n, 6).alias("after"), harmed.cast("long").alias("harmed"))


def behaviour(df: DataFrame, expected: str, got: str, good: tuple[str, ...] = ("answer", "refuse", "conflict", "clarify")) -> DataFrame:
    """Shares of answers where none was due, of what was due, and of refusals where an answer was."""
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return df.agg(mean((F.col(got) == "answer") & (F.col(expected) == "refuse")).alias("hallucination"), mean((F.col(got) == F.col(expected)) & F.col(got).isin(*good)).alias("correct"), mean((F.col(got) == "refuse") & (F.col(expected) == "answer")).alias("wrong_refusal"))


def scope_by_year(chunks: DataFrame, question: str, source: str, keys: list[str]) -> DataFrame:
    """Rows whose source names a year that the question asks for, unless no row of the question's does."""
    year = F.nullif(F.regexp_extract(question, r"\b(20[0-9]{2})\b", 1), F.lit(""))
    hit = F.coalesce(year.isNotNull() & F.contains(F.col(source), year), F.lit(False))
    w = Window.partitionBy(*keys)
    return chunks.withColumn("__h", hit).withColumn("__any", F.max("__h").over(w)).where(F.col("__h") | ~F.col("__any")).drop("__h", "__any")


def best_attempt(attempts: DataFrame, key: str, confidence: str, garbage: str) -> DataFrame:
    """Each page's most confident attempt, and whether it passes: confidence of 0.85 and garbage of 0.2 at most."""
    cols = [c for c in attempts.columns if c != key]
    best = attempts.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(confidence, -F.col(garbage))).alias("b")).select(key, "b.*")
    return best.withColumn("passes", (F.col(confidence) >= 0.85) & (F.col(garbage) <= 0.2))


def token_typos(names: DataFrame, row_id: str, name: str, frequent: int = 3) -> DataFrame:
    """row_id, token, fix: words that occur once, of three letters or more, and become a frequent word by swapping neighbours or losing a doubled letter; the most frequent, then least, such word.

    Candidates are made from the rare word, so frequent words are met by an equi-join.
    """
    tokens = names.select(F.col(row_id).alias("row_id"), F.explode(F.split(F.lower(F.trim(name)), r"\s+")).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))
    rare = counts.where((F.col("n") == 1) & (F.length("token") > 2)).select("row_id", "token")
    at = F.sequence(F.lit(1), F.length("token") - 1)
    piece = lambda a, b: F.substr(F.col("token"), a, b)
    swapped = F.transform(at, lambda i: F.concat(piece(F.lit(1), i - 1), piece(i + 1, F.lit(1)), piece(i, F.lit(1)), piece(i + 2, F.length("token"))))
    single = F.transform(F.filter(at, lambda i: piece(i, F.lit(1)) == piece(i + 1, F.lit(1))), lambda i: F.concat(piece(F.lit(1), i - 1), piece(i + 1, F.length("token"))))
    made = rare.select("row_id", "token", F.explode(F.array_distinct(F.concat(swapped, single))).alias("fix")).where("fix <> token")
    common = counts.where(F.col("n") >= frequent).select(F.col("token").alias("fix"), F.col("n").alias("m"))
    return made.join(common, "fix").groupBy("row_id", "token").agg(F.min_by("fix", F.struct(-F.col("m"), "fix")).alias("fix"))


def rate_limited(df: DataFrame, keys: list[str], time: str, tie: str, most: int = 10, seconds: int = 60) -> Column:
    """Whether the row's key has more than `most` rows in the seconds up to it."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return F.count(F.lit(1)).over(w) > most


def plausible_swap(born: Column, died: Column, awards: Column) -> Column:
    """Confidence that birth and death are swapped: 0.95 if every award fits the swapped life, else 0.7; null if they are in order."""
    fits = (F.size(awards) > 0) & F.forall(awards, lambda y: (y >= died + 15) & (y <= born + 1))
    return F.when(died < born, F.when(F.coalesce(fits, F.lit(False)), 0.95).otherwise(0.7))


def implied_gender(people: DataFrame, links: DataFrame) -> DataFrame:
    """person_id, gender, action: a father is male, a mother female; a missing gender is filled by the first link, another one is flagged."""
    implied = links.where(F.col("rel").isin("father", "mother")).select(F.col("dst").alias("person_id"), F.when(F.col("rel") == "father", "male").otherwise("female").alias("g"), "pos")
    first = implied.groupBy("person_id").agg(F.min_by("g", "pos").alias("first"), F.count_distinct("g").alias("kinds"))
    out = people.select("person_id", F.col("gender").alias("own")).join(first, "person_id")
    told = F.coalesce("own", "first")
    action = F.when((told != F.col("first")) | (F.col("kinds") > 1), "FLAG").when(F.col("own").isNull(), "FILL")
    return out.select("person_id", told.alias("gender"), action.alias("action")).where("action is not null")


def award_age_flags(people: DataFrame, awards: DataFrame, youngest: int = 17, oldest: int = 100) -> DataFrame:
    """person_id, year, age: the first award, by year, at an age outside the bounds."""
    aged = awards.join(people, "person_id").select("person_id", "year", (F.col("year") - F.col("born")).alias("age"))
    odd = aged.where((F.col("age") < youngest) | (F.col("age") > oldest))
    return odd.groupBy("person_id").agg(F.min(F.struct("year", "age")).alias("x")).select("person_id", "x.year", "x.age")


def fix_rates(errors: DataFrame, repaired: DataFrame, row_id: str, column: str) -> DataFrame:
    """kind, errors, fixed, rate from a log of injected errors(row_id, kind, old) and the repaired column."""
    r = repaired.select(F.col(row_id).alias("row_id"), F.col(column).alias("__v"))
    hit = F.count(F.when(F.col("__v").eqNullSafe(F.col("old")), 1))
    return errors.join(r, "row_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("errors"), hit.alias("fixed")).withColumn("rate", F.round(F.col("fixed") / F.col("errors"), 6))


def decided_trials(trials: DataFrame, key: str, passed: str) -> DataFrame:
    """key, winner side: keys with exactly one pass and one failure; others say nothing."""
    n = trials.groupBy(key).agg(F.count(F.when(F.col(passed), 1)).alias("p"), F.count(F.when(~F.col(passed), 1)).alias("f"), F.max(F.when(F.col(passed), F.col("side"))).alias("winner"))
    return n.where("p = 1 and f = 1").select(key, "winner")


def search_claims(claims: DataFrame, queries: DataFrame, k: int = 12) -> DataFrame:
    """query_id, claim_id: live claims whose subject has a term of the question (longer than two letters, the first twelve), newest first, k a query.

    Subjects and questions meet word by word.
    """
    terms = queries.select("query_id", F.explode(F.slice(F.filter(F.array_distinct(F.split(F.lower("question"), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) > 2), 1, 12)).alias("w"))
    live = claims.where(~F.col("write_verdict").isin("QUARANTINED") & ~F.col("retracted"))
    held = live.select("claim_id", "asserted_at", F.explode(F.array_distinct(F.split(F.lower("subject"), r"[^\p{L}\p{N}]+"))).alias("w"))
    hits = held.join(terms, "w").select("query_id", "claim_id", "asserted_at").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("asserted_at"), F.desc("claim_id"))
    return hits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select("query_id", "claim_id")


def citation(file: Column, page: Column, extraction: Column, confidence: Column, kind: Column) -> Column:
    """`file, p. 3 (OCR 87%) [code]`."""
    return F.concat(file, F.when(page.isNotNull(), F.concat(F.lit(", p. "), page.cast("string"))).otherwise(""), F.when(extraction == "ocr", F.concat(F.lit(" (OCR "), F.round(confidence * 100).cast("int").cast("string"), F.lit("%)"))).otherwise(""), F.when(kind.isin("code", "figure"), F.concat(F.lit(" ["), kind, F.lit("]"))).otherwise(""))


def edited_cell(df: DataFrame, row_id: str, key, column: str, value: str | None) -> tuple[DataFrame, DataFrame]:
    """The table with one cell set (an empty string is null), and the row as it was. Unknown columns and rows raise an error."""
    if column not in df.columns or column == row_id:
        raise ValueError(f"{column} cannot be edited")
    before = df.where(F.col(row_id) == key)
    if before.isEmpty():
        raise ValueError(f"no row {key}")
    new = F.lit(value if value != "" else None).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(F.col(row_id) == key, new).otherwise(F.col(column))), before
