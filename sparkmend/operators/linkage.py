"""Record linkage by weighted fields, people scores, formats of columns, key detection, template learning, error injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmend.functions.similarity import osa_udf, token_sort_udf
from sparkmend.operators.blocking import blocked_pairs


# Fields of a linkage record, how they are compared, and their weights.
LINK_FIELDS = (
    ("given_name", "name", 1.0), ("surname", "name", 1.5), ("date_of_birth", "code", 1.5), ("soc_sec_id", "code", 2.0), ("postcode", "code", 0.8),
    ("suburb", "text", 0.7), ("address_1", "text", 0.8), ("address_2", "text", 0.3), ("street_number", "exact", 0.4), ("state", "exact", 0.3),
)


def link_keys() -> list[Column]:
    key = lambda tag, *parts: F.when(F.concat_ws("", *parts) != "", F.concat(F.lit(tag), F.concat_ws("|", *parts)))
    return [
        key("s", F.soundex("surname"), F.substring("given_name", 1, 1)), key("d", F.col("date_of_birth")), key("i", F.col("soc_sec_id")),
        key("p", F.col("postcode"), F.soundex("given_name")), key("a", F.soundex("surname"), F.col("postcode")),
    ]


def linked(records: DataFrame, row_id: str, least: float = 0.5, cap: int = 60) -> DataFrame:
    """a, b, score of candidate pairs: the weighted mean of field similarities over fields that both have."""
    pairs = blocked_pairs(records, row_id, link_keys(), cap)
    sides = [records.select(F.col(row_id).alias(i), *(F.nullif(F.trim(f), F.lit("")).alias(f"{f}_{i}") for f, _, _ in LINK_FIELDS)) for i in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    total, weight = F.lit(0.0), F.lit(0.0)
    for f, kind, w in LINK_FIELDS:
        x, y = F.col(f"{f}_a"), F.col(f"{f}_b")
        there = x.isNotNull() & y.isNotNull()
        if kind == "exact":
            s = (x == y).cast("double")
        elif kind == "text":
            s = token_sort_udf()(x, y) / 100
        else:
            s = osa_udf()(x, y)
            s = F.when(s >= 0.7, s).otherwise(0.0) if kind == "code" else s
        total, weight = total + F.when(there, s * w).otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    scored = both.withColumn("score", F.when(weight > 0, total / weight).otherwise(0.0))
    return scored.select("a", "b", F.round("score", 6).alias("score")).where(F.col("score") >= least)


def strip_units(df: DataFrame, column: str, least: float = 0.9, usual: float = 0.6) -> DataFrame:
    """The column without units, if nearly all values are a number and a unit and no unit is the usual one. One profile, then a projection."""
    pattern = r"^\s*(-?[0-9][0-9,.]*)\s*([A-Za-z%°/]*)\.?\s*$"
    text = F.col(column).cast("string")
    number, unit = F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 2))
    units = df.where(text.isNotNull() & (text != "")).groupBy(F.when(text.rlike(pattern), unit).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    facts = units.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("u").isNotNull(), F.col("n"))).alias("fit"), F.max_by("u", "n").alias("top"), F.max(F.when(F.col("u").isNotNull(), F.col("n"))).alias("most")).first()
    if not facts["all"] or (facts.fit or 0) < least * facts["all"] or (facts.top and facts.most >= usual * facts["all"]):
        return df
    return df.withColumn(column, F.when(text.rlike(pattern), F.regexp_replace(number, r"\.0$", "")).otherwise(F.col(column)))


def redundant_suffix(df: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Column a without a trailing ` b`, where it occurs often enough, in less than half of the rows, and the rest is a value of a as well."""
    tail = F.concat(F.lit(" "), F.col(b))
    ends = F.endswith(F.col(a), tail) & (F.col(b) != "")
    n = df.agg(F.count(F.when(ends, 1)).alias("hits"), F.count(F.lit(1)).alias("rows")).first()
    if n.hits < least or n.hits >= 0.5 * n.rows:
        return df
    short = F.regexp_replace(F.substr(F.col(a), F.lit(1), F.length(a) - F.length(tail)), "[ ,]+$", "")
    known = df.select(F.col(a).alias("__short")).distinct().withColumn("__known", F.lit(True))
    out = df.withColumn("__short", F.when(ends, short)).join(known, "__short", "left")
    return out.withColumn(a, F.when(F.col("__known"), F.col("__short")).otherwise(F.col(a))).select(*df.columns)


def source_columns(df: DataFrame, columns: list[str]) -> list[tuple[str, str, float]]:
    """(key, source, share) candidates for truth discovery: a source column of 2 to 100 values, keys whose groups of three rows or more hold half
    of the rows, and whose rows come from different sources. Best first."""
    counts = df.agg(*(F.count_distinct(c).alias(c) for c in columns), F.count(F.lit(1)).alias("__n")).first()
    out = []
    for src in (c for c in columns if 2 <= counts[c] <= 100):
        for key in (c for c in columns if c != src):
            g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(src).alias("s"))
            f = g.agg(F.sum(F.when(F.col("n") >= 3, F.col("n"))).alias("rows"), F.count(F.when(F.col("n") >= 3, 1)).alias("keys"), F.count(F.lit(1)).alias("all"), F.avg(F.when(F.col("n") >= 2, F.col("s") / F.col("n"))).alias("share")).first()
            if (f.rows or 0) >= 0.5 * counts["__n"] and f["keys"] >= 0.05 * f["all"] and (f.share or 0) >= 0.95:
                out.append((key, src, round(f.share, 2), f.rows))
    return [(k, s, v) for k, s, v, _ in sorted(out, key=lambda x: (-x[2], -x[3]))]


def mail_template(people: DataFrame, name: str, year: str, mail: str) -> tuple[str | None, float]:
    """The usual domain, and the share of first.lastYY@domain among mails: learned, to fill and check fields by."""
    domain = F.substring_index(mail, "@", -1)
    top = people.where(F.col(mail).contains("@")).groupBy(domain.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if top is None:
        return None, 0.0
    words = F.split(F.lower(F.trim(name)), r"\s+")
    made = F.concat(words[0], F.lit("."), F.element_at(words, -1), F.lpad((F.col(year).cast("int") % 100).cast("string"), 2, "0"), F.lit("@" + top.d))
    share = people.where(F.col(mail).isNotNull() & F.col(year).isNotNull() & F.col(name).isNotNull()).agg(F.avg((F.lower(mail) == made).cast("double"))).first()[0]
    return top.d, round(share or 0.0, 6)


def injected(df: DataFrame, row_id: str, column: str, seed: int = 7, share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The table with errors put in by a hash of seed and row (swapped letters, dropped letters, doubled letters, placeholders), and the log of them."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1_000_000))
    hit = (h < int(share * 1_000_000)) & (F.length(column) > 3)
    at = (F.lit(1) + h % (F.length(column) - 2)).cast("int")
    cut = lambda a, b: F.substr(F.col(column), a, b)
    head, one, two, tail = cut(F.lit(1), at - 1), cut(at, F.lit(1)), cut(at + 1, F.lit(1)), cut(at + 2, F.length(column))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("swap", "drop", "double", "blank"))), (F.shiftright(h, 3) % 4 + 1).cast("int"))
    new = F.when(kind == "swap", F.concat(head, two, one, tail)).when(kind == "drop", F.concat(head, two, tail)).when(kind == "double", F.concat(head, one, one, two, tail)).otherwise("N/A")
    marked = df.withColumn("__new", F.when(hit, new)).withColumn("__kind", F.when(hit, kind))
    log = marked.where(F.col("__kind").isNotNull()).select(F.col(row_id).alias("row_id"), F.lit(column).alias("col"), F.col("__kind").alias("kind"), F.col(column).alias("old"), F.col("__new").alias("new"))
    return marked.withColumn(column, F.coalesce("__new", column)).select(*df.columns), log




def extract_usual_shape(df: DataFrame, column: str, usual: float = 0.6) -> DataFrame:
    """Values off the column's usual shape that hold exactly one piece of that shape, no other letters, become that piece.

    The usual shape must cover `usual` of the filled values and not be the only one. One profile, then a projection.
    """
    from sparkmend.functions.text import shape, shape_regex

    text = F.col(column).cast("string")
    shapes = df.where(text.isNotNull() & (text != "")).groupBy(shape(text).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    facts = shapes.agg(F.sum("n").alias("all"), F.max_by("s", F.struct("n", "s")).alias("top"), F.max("n").alias("most"), F.count(F.lit(1)).alias("kinds")).first()
    if not facts["all"] or facts.kinds < 2 or facts.most < usual * facts["all"]:
        return df
    pattern = shape_regex(facts.top)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.replace(text, hits[0], F.lit(""))
    at = F.instr(text, hits[0])
    before, after = F.substr(text, at - 1, F.lit(1)), F.substr(text, at + F.length(hits[0]), F.lit(1))
    edges = ((at == 1) | (before == " ")) & ((after == "") | (after == " "))
    fits = (F.size(hits) == 1) & (hits[0] != text) & ~rest.rlike("[A-Za-z]") & (~rest.rlike("[A-Za-z0-9]") | edges)
    return df.withColumn(column, F.when(F.coalesce(fits, F.lit(False)), hits[0]).otherwise(F.col(column)))


def filled_from_mail(people: DataFrame, name: str, year: str, mail: str, share: float = 0.8) -> DataFrame:
    """The table with missing mails made by the learned template, where it holds for `share` of those there, and `made` for such rows."""
    domain, held = mail_template(people, name, year, mail)
    if domain is None or held < share:
        return people.withColumn("made", F.lit(False))
    words = F.split(F.lower(F.trim(name)), r"\s+")
    made = F.concat(words[0], F.lit("."), F.element_at(words, -1), F.lpad((F.col(year).cast("int") % 100).cast("string"), 2, "0"), F.lit("@" + domain))
    missing = F.col(mail).isNull() & made.isNotNull()
    return people.withColumn("made", missing).withColumn(mail, F.coalesce(mail, made))
