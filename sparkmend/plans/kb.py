"""Repair of a four-table knowledge base: people, places, events and relationships, all strings.

Stages follow one another as DataFrames: placeholders, places, events, people, relationships; each sees what those before it
repaired. Each adds to one log, a row for an issue and what was done about it, with confidence, rule and reason; an action below 0.6 only
flags and leaves the cell. Sequential decisions (guarded merging) run within components, the rest is joins, votes and
partial aggregations over the whole tables. `pos`, the order of the rows, breaks ties.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.functions import text as X
from sparkmend.functions.similarity import osa_udf, place_udf, token_sort_udf
from sparkmend.operators.blocking import blocked_pairs, guarded_merge, near_values, vocabulary_fix
from sparkmend.operators.scoring import token_typos
from sparkmend.operators.shared import written
from sparkmend.operators.vote import keep_first, majority, union_all
from sparkmend.plans.registry import query, table

SCHEMAS = {
    "people": ("person_id", "name", "birth_date", "death_date", "gender", "birth_place_id", "death_place_id"),
    "places": ("place_id", "name", "country"),
    "events": ("event_id", "name", "prize", "year", "place_id"),
    "relationships": ("src", "rel", "dst", "year"),
}
# Links joined up by one task; beyond, by rounds over the whole cluster with the same result.
IN_ONE_TASK = 50_000
LOG = "tbl string, kind string, issue string, records string, col string, before string, after string, confidence double, status string, rule string, detail string"


class Repaired(NamedTuple):
    people: DataFrame
    places: DataFrame
    events: DataFrame
    relationships: DataFrame
    actions: DataFrame
    ids: DataFrame  # tbl, old, new: the entity of each record


def entry(tbl: str, kind: str, issue: str, records: Column, col, before, after, confidence, rule: str, detail=None) -> list[Column]:
    """A row of LOG."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    c = lit(confidence).cast("double")
    cells = dict(tbl=lit(tbl), kind=lit(kind), issue=lit(issue), records=lit(records), col=lit(col), before=lit(before), after=lit(after))
    return [*(x.cast("string").alias(n) for n, x in cells.items()), F.round(c, 3).alias("confidence"), X.confidence_band(c).alias("status"), F.lit(rule).alias("rule"), F.coalesce(lit(detail).cast("string"), F.lit(rule)).alias("detail")]


def blanked(df: DataFrame, tbl: str) -> tuple[DataFrame, DataFrame]:
    """Placeholders to null in every column, and an action for each that held one."""
    key = SCHEMAS[tbl][0]
    cells = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in SCHEMAS[tbl]))
    hit = df.select(F.col(key).alias("k"), F.explode(cells).alias("x")).where(F.col("x.v").isNotNull() & X.is_placeholder(F.col("x.v")))
    log = hit.select(*entry(tbl, "NORMALIZE", "MISSING", F.col("k"), F.col("x.c"), F.col("x.v"), None, 1.0, "placeholder"))
    return df.select("pos", *(X.blank_placeholder(F.col(c)).alias(c) for c in SCHEMAS[tbl])), log


def named(ids: DataFrame, old: str, new: str) -> DataFrame:
    return ids.select(F.col("old").alias(old), F.col("new").alias(new))


def merged(df: DataFrame, tbl: str, clusters: DataFrame, chosen: dict[str, DataFrame] | None = None, quiet: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Entities (one a cluster, id of the least member), the id map, and merge and resolve actions.

    A column is what `chosen` has for the cluster, else its majority, the first seen on a tie; copies that disagree are an issue, and a tie
    is only flagged. All columns are counted in one pass.
    """
    key, columns = SCHEMAS[tbl][0], SCHEMAS[tbl][1:]
    chosen = chosen or {}
    rows = df.join(clusters.select(F.col("node").alias(key), "cluster"), key, "left").withColumn("cluster", F.coalesce("cluster", key))
    rows = written(rows.select("pos", "cluster", *SCHEMAS[tbl]), f"{tbl}_clusters")
    cells = rows.select("cluster", "pos", key, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))).alias("x")).select("cluster", "pos", key, "x.c", "x.v")
    votes = cells.where("v is not null").groupBy("cluster", "c", "v").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    ranked = votes.groupBy("cluster", "c").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first", "v"))).alias("all"), F.sum("n").alias("total"))
    ranked = written(ranked.select("cluster", "c", F.col("all")[0]["v"].alias("best"), (-F.col("all")[0]["minus"]).alias("n"), "total", (F.size("all") > 1).alias("differ"), F.coalesce(F.try_element_at("all", F.lit(2))["minus"] == F.col("all")[0]["minus"], F.lit(False)).alias("tie"), F.to_json(F.map_from_entries(F.transform("all", lambda x: F.struct(x["v"], -x["minus"])))).alias("seen")), f"{tbl}_votes")
    wide = ranked.groupBy("cluster").pivot("c", list(columns)).agg(F.first("best"))
    out = rows.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_set(key)), ",").alias("source_records"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).join(wide, "cluster", "left")
    for c, vote in chosen.items():
        out = out.drop(c).join(vote.select("cluster", F.col(c)), "cluster", "left")
    entities = written(out.select(F.col("cluster").alias(key), *columns, "source_records", "n", "pos"), f"{tbl}_entities")
    merges = entities.where("n > 1").select(*entry(tbl, "MERGE", "DUPLICATE", F.col("source_records"), None, None, F.col(key), 0.95, "blocking + similarity"))
    differ = ranked.where("differ").where(~F.col("c").isin(*chosen, *quiet)).join(entities.select(F.col(key).alias("cluster"), "source_records"), "cluster")
    resolved = differ.select(*entry(tbl, "RESOLVE", "CONTRADICTION", F.col("source_records"), F.col("c"), F.col("seen"), F.when(~F.col("tie"), F.col("best")), F.when(F.col("tie"), 0.5).otherwise(F.col("n") / F.col("total")), "majority over duplicates"))
    return entities.drop("n"), rows.select(F.col(key).alias("old"), F.col("cluster").alias("new")), [merges, resolved]


def repair_places(df: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rare countries that are typos of frequent ones; then records of one place: alike in name without its country, of one country where both have one."""
    df, log = blanked(df, "places")
    df = written(df, "places")
    fixes = written(vocabulary_fix(df, "country", "pos", osa_udf()), "country_fixes")
    typos = df.join(fixes, F.col("country") == F.col("rare"))
    typos = typos.select(*entry("places", "CORRECT", "TYPO", F.col("place_id"), "country", F.col("country"), F.col("fix"), F.col("confidence"), "noisy-channel vocabulary"))
    sure = fixes.where("confidence >= 0.6").select(F.col("rare").alias("country"), "fix")
    df = df.join(sure, "country", "left").withColumn("country", F.coalesce("fix", "country")).select("pos", *SCHEMAS["places"])
    # a country behind the last comma, misspelled or not, is no part of the name
    trimmed = F.trim("name")
    split = df.withColumn("tail", F.when(F.instr(trimmed, ",") > 0, F.lower(X.squeezed(F.element_at(F.split(trimmed, ","), -1)))))
    tails = split.where("tail is not null").select(F.col("tail").alias("v")).distinct()
    countries = df.where("country is not null").select(F.lower("country").alias("w")).distinct()
    known = near_values(tails, countries).where(osa_udf()(F.col("v"), F.col("w")) >= 0.8).select(F.col("v").alias("tail"), F.lit(True).alias("country_tail")).distinct()
    bare = F.when(F.col("country_tail"), F.regexp_replace(trimmed, r",[^,]*$", "")).otherwise(trimmed)
    keyed = written(split.join(known, "tail", "left").withColumn("k", F.lower(X.squeezed(F.coalesce(bare, F.lit(""))))).drop("tail", "country_tail"), "place_keys")
    pairs = blocked_pairs(keyed, "place_id", [F.col("k"), F.concat(F.lit("S"), F.soundex(F.regexp_replace("k", "[^a-z]", "")))], 40)
    a, b = (keyed.select(F.col("place_id").alias(i), F.col("k").alias(f"k_{i}"), F.col("country").alias(f"c_{i}")) for i in "ab")
    scored = pairs.join(a, "a").join(b, "b").where("c_a is null or c_b is null or c_a = c_b").where(place_udf()(F.col("k_a"), F.col("k_b")) >= 0.8)

    def same_country(x: list[dict], y: list[dict]) -> bool:
        p, q = ({r["country"] for r in s if r["country"]} for s in (x, y))
        return not p or not q or bool(p & q)

    clusters = written(guarded_merge(written(scored.select("a", "b"), "place_pairs"), df.select("place_id", "country"), "place_id", same_country, IN_ONE_TASK), "place_clusters")
    # of names without capitals throughout and without a comma, if there are such, the most frequent, then that of the most usual words
    words = F.filter(F.split(F.lower(F.translate("name", ",", " ")), r"\s+"), lambda w: w != "")
    freq = df.where("name is not null").select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    spelled = df.where("name is not null").join(clusters.select(F.col("node").alias("place_id"), "cluster"), "place_id").withColumn("clean", (F.col("name") != F.upper("name")) & (F.instr("name", ",") == 0))
    least = spelled.select("name", F.explode(F.split(F.lower("name"), r"\s+")).alias("w")).distinct().join(freq, "w", "left").groupBy("name").agg(F.min(F.coalesce("f", F.lit(0))).alias("least"))
    counted = spelled.groupBy("cluster", "name", "clean").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).join(least, "name", "left")
    best = counted.groupBy("cluster").agg(F.max_by("name", F.struct("clean", "n", "least", -F.col("first"))).alias("picked"))
    own = df.select(F.col("place_id").alias("cluster"), F.col("name").alias("own"), "pos")
    names = own.join(best, "cluster", "left").select("cluster", F.coalesce("picked", "own").alias("name"))
    entities, ids, merges = merged(df, "places", clusters, {"name": names})
    return entities, ids, [log, typos, *merges]


def repair_events(df: DataFrame, places: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """A prize's place by its majority of 0.7; events of one prize and year are one; the year is voted by labels, columns and award links."""
    df, log = blanked(df, "events")
    df = df.join(named(places, "place_id", "new_place"), "place_id", "left").withColumn("place_id", F.coalesce("new_place", "place_id")).select("pos", *SCHEMAS["events"])
    df = written(df, "events")
    held = df.where("prize is not null").groupBy("prize", "place_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    usual = held.groupBy("prize").agg(F.max_by("place_id", F.struct("n", -F.col("first"))).alias("usual"), (F.max("n") / F.sum("n")).alias("share")).where("share >= 0.7 and usual is not null")
    moved = df.join(usual, "prize", "left")
    off = F.col("usual").isNotNull() & ~F.col("usual").eqNullSafe(F.col("place_id"))
    places_log = moved.where(off).select(*entry("events", "CORRECT", "CONTRADICTION", F.col("event_id"), "place_id", F.col("place_id"), F.col("usual"), F.col("share"), "dependency prize->place"))
    df = written(moved.select("pos", "event_id", "name", "prize", "year", F.coalesce("usual", "place_id").alias("place_id"), F.coalesce(X.label_year(F.col("name")).cast("string"), F.col("year")).alias("y")), "placed_events")
    first = df.where("prize is not null and y is not null").groupBy("prize", "y").agg(F.min("event_id").alias("cluster"))
    clusters = written(df.join(first, ["prize", "y"]).select(F.col("event_id").alias("node"), "cluster"), "event_clusters")
    member = df.join(clusters, F.col("event_id") == F.col("node"))
    said = member.select("cluster", "event_id", F.explode(F.array(F.struct(F.lit(0).alias("o"), X.label_year(F.col("name")).cast("string").alias("year")), F.struct(F.lit(1).alias("o"), F.col("year")))).alias("x")).select("cluster", F.struct("event_id", "x.o").alias("at"), "x.year")
    awarded = links.where("rel = 'received' and year is not null").select(F.col("dst").alias("node"), "year").join(clusters, "node").select("cluster", F.struct(F.col("node").alias("event_id"), F.lit(2).alias("o")).alias("at"), "year")
    counted = said.union(awarded).where("year is not null").groupBy("cluster", "year").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    ranked = counted.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "at", "year")))[0].alias("b"), F.sum("n").alias("total"))
    vote = written(ranked.select("cluster", F.col("b.year").alias("year"), (-F.col("b.minus") / F.col("total")).alias("share")), "event_years")
    wrong = member.select("event_id", "cluster", "year").join(vote.select("cluster", F.col("year").alias("voted"), "share"), "cluster").where("year is not null and year <> voted")
    years = wrong.select(*entry("events", "CORRECT", "CONTRADICTION", F.col("event_id"), "year", F.col("year"), F.col("voted"), F.least(F.lit(0.99), F.col("share") + 0.3), "vote: label + copies + award links"))
    prize = member.where("event_id = cluster").select("cluster", "prize")
    names = vote.join(prize, "cluster").select("cluster", F.concat_ws(" ", "prize", "year").alias("name"))
    alone = df.select(F.col("event_id").alias("node"), "name", "year").join(clusters, "node", "left_anti")
    names = names.unionByName(alone.select(F.col("node").alias("cluster"), "name"))
    all_years = vote.select("cluster", "year").unionByName(alone.select(F.col("node").alias("cluster"), "year"))
    entities, ids, merges = merged(df.drop("y"), "events", clusters, {"name": names, "year": all_years})
    return entities, ids, [log, places_log, years, *merges]


def plausible(years: Column, born: Column, least: int, most: int) -> Column:
    return F.forall(F.coalesce(years, F.array().cast("array<int>")), lambda y: (y - born >= least) & (y - born <= most))


def repair_people(df: DataFrame, places: DataFrame, awards: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Places by merged ids (unknown ones flagged), swapped dates, mistyped name parts, genders that family links imply; then records of one person.

    awards: person_id, awards (the years of a person record's events). links: the relationships.
    """
    df, log = blanked(df, "people")
    df = written(df.join(awards, "person_id", "left"), "people")
    broken = []
    for c in ("birth_place_id", "death_place_id"):
        df = df.join(named(places, c, f"new_{c}"), c, "left")
        broken.append(df.where(F.col(c).isNotNull() & F.col(f"new_{c}").isNull()).select(*entry("people", "FLAG", "BROKEN_REF", F.col("person_id"), c, F.col(c), None, 0.0, "referential integrity")))
        df = df.withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
    born, died = X.year_of(F.col("birth_date")), X.year_of(F.col("death_date"))
    swap = F.coalesce(died < born, F.lit(False))
    fits = F.forall("awards", lambda y: (y >= died + 15) & (y <= born + 1))
    sure = F.when(F.coalesce(F.size("awards") > 0, F.lit(False)) & F.coalesce(fits, F.lit(False)), 0.95).otherwise(0.7)
    both = F.concat_ws("/", "birth_date", "death_date")
    swapped = df.where(swap).select(*entry("people", "CORRECT", "CONTRADICTION", F.col("person_id"), "birth_date/death_date", both, F.concat_ws("/", "death_date", "birth_date"), sure, "temporal order + award dates"))
    df = written(df.select("pos", "person_id", "name", F.when(swap, F.col("death_date")).otherwise(F.col("birth_date")).alias("birth_date"), F.when(swap, F.col("birth_date")).otherwise(F.col("death_date")).alias("death_date"), "gender", "birth_place_id", "death_place_id", "awards").withColumn("k", X.person_name(F.col("name"))), "dated_people")
    # name parts that occur once and become a frequent one by a typing error
    typos = token_typos(df.where("name is not null"), "person_id", "k").where(~F.col("token").isin(*X.NICKNAMES))
    typos = written(typos.groupBy(F.col("row_id").alias("person_id")).agg(F.collect_list(F.struct("token", "fix")).alias("fixes")), "name_typos")
    df = df.join(typos, "person_id", "left")
    capital = lambda w, f: F.when(w == F.upper(w), F.upper(f)).otherwise(F.initcap(f))
    mended = F.aggregate("fixes", F.col("name"), lambda name, x: F.array_join(F.transform(F.split(name, r"(?<=[\s,])|(?=[\s,])"), lambda w: F.when(F.lower(w) == x["token"], capital(w, x["fix"])).otherwise(w)), ""))
    new_name = F.when(F.col("fixes").isNotNull(), mended).otherwise(F.col("name"))
    renamed = df.where("fixes is not null").where(new_name != F.col("name")).select(*entry("people", "CORRECT", "TYPO", F.col("person_id"), "name", F.col("name"), new_name, 0.85, "noisy-channel name token"))
    # gender by family links: the first link fills, others that disagree flag
    implied = links.where("rel in ('father', 'mother')").select(F.col("dst").alias("person_id"), F.when(F.col("rel") == "father", "male").otherwise("female").alias("implied"), F.col("pos").alias("at"), "src")
    implied = implied.groupBy("person_id").agg(F.min_by("implied", "at").alias("implied"), F.sort_array(F.collect_set("implied")).alias("every"))
    df = written(df.withColumn("name", new_name).drop("fixes").join(implied, "person_id", "left"), "named_people")
    filled = df.where("gender is null and implied is not null").select(*entry("people", "FILL", "MISSING", F.col("person_id"), "gender", None, F.col("implied"), 0.95, "implied by family link"))
    told = F.coalesce("gender", "implied")
    odd = df.where(F.exists("every", lambda g: g != told)).select(*entry("people", "FLAG", "CONTRADICTION", F.col("person_id"), "gender", told, None, 0.0, "family link vs gender"))
    df = df.withColumn("gender", told).drop("implied", "every", "k")

    keyed = written(df.withColumn("k", X.person_name(F.col("name"))).withColumn("last", F.element_at(F.split("k", " "), -1)), "people_keys")
    blocks = [F.concat(F.lit("L"), F.soundex(F.nullif("last", F.lit("")))), F.concat(F.lit("B"), "birth_date"), F.concat(F.lit("M"), F.substring("birth_date", 5, 6), F.substring("last", 1, 3))]
    pairs = blocked_pairs(keyed, "person_id", blocks, 40)
    side = ("k", "last", "birth_date", "gender", "birth_place_id")
    a, b = (keyed.select(F.col("person_id").alias(i), *(F.col(c).alias(f"{c}_{i}") for c in side)) for i in "ab")
    there = lambda c: F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull()
    dates = F.when(~there("birth_date"), 0.0).when(F.col("birth_date_a") == F.col("birth_date_b"), 0.3).when(F.substring("birth_date_a", 5, 6) == F.substring("birth_date_b", 5, 6), 0.15).otherwise(-0.3)
    gender = F.when(there("gender") & (F.col("gender_a") != F.col("gender_b")), -0.5).otherwise(0.0)
    home = F.when(~there("birth_place_id"), 0.0).when(F.col("birth_place_id_a") == F.col("birth_place_id_b"), 0.1).otherwise(-0.1)
    scored = pairs.join(a, "a").join(b, "b").withColumn("rest", dates + gender + home).where("rest >= 0.02 - 1e-9")  # a name adds 0.6 at most
    scored = scored.withColumn("r", token_sort_udf()(F.col("k_a"), F.col("k_b")) / 100)
    given = [F.element_at(F.split(f"k_{i}", " "), 1) for i in "ab"]
    one = lambda g: F.length(F.rtrim(g, F.lit("."))) == 1
    initial = (F.col("last_a") == F.col("last_b")) & (F.col("k_a") != "") & (F.substring(given[0], 1, 1) == F.substring(given[1], 1, 1)) & (one(given[0]) | one(given[1]))
    name = F.when(initial, F.greatest(F.lit(0.9), F.col("r"))).otherwise(F.col("r"))
    good = written(scored.where(0.6 * name + F.col("rest") >= 0.62 - 1e-9).select("a", "b"), "people_pairs")
    clusters = written(guarded_merge(good, df.select("person_id"), "person_id", None, IN_ONE_TASK), "people_clusters")

    rows = df.join(clusters.withColumnRenamed("node", "person_id"), "person_id", "left").withColumn("cluster", F.coalesce("cluster", "person_id"))
    rows = written(rows, "clustered_people")
    ages = rows.select(F.explode("awards").alias("y"), X.year_of(F.col("birth_date")).alias("b")).select((F.col("y") - F.col("b")).alias("age")).where("age between 17 and 100")
    spread = ages.groupBy("age").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each possible age at most
    half, typical = sum(r.n for r in spread) // 2, 55
    for r in sorted(spread):
        if half >= 0:
            typical, half = r.age, half - r.n
    # of birth dates that copies disagree on: plausible ones by the ages at awards and death, the most frequent, the nearest to the typical age at an award
    every = rows.groupBy("cluster").agg(F.flatten(F.collect_list("awards")).alias("won"), F.collect_list(X.year_of(F.col("death_date"))).alias("ends"), F.count_distinct("birth_date").alias("dates"), F.array_join(F.sort_array(F.collect_set("person_id")), ",").alias("source_records"))
    dates_ = rows.where("birth_date is not null").groupBy("cluster", "birth_date").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    judged = dates_.join(every, "cluster").withColumn("b", X.year_of(F.col("birth_date"))).withColumn("good", F.coalesce(plausible(F.col("won"), F.col("b"), 17, 100) & plausible(F.col("ends"), F.col("b"), 15, 110), F.lit(False)))
    off = F.coalesce(F.array_min(F.transform("won", lambda y: F.abs(y - F.col("b") - typical))), F.lit(0))
    picked = judged.groupBy("cluster", "dates", "source_records").agg(F.max_by("birth_date", F.struct("good", "n", -off, -F.col("first"))).alias("birth_date"), F.sum(F.col("good").cast("int")).alias("n_good"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("birth_date", "n"))))).alias("seen"))
    picked = written(picked, "birth_dates")
    disputed = picked.where("dates > 1").select(*entry("people", "RESOLVE", "CONTRADICTION", F.col("source_records"), "birth_date", F.col("seen"), F.col("birth_date"), F.when(F.col("n_good") == 1, 0.95).otherwise(0.6), "duplicates + age at award"))
    short = F.lower(F.element_at(F.split("name", r"\s+"), 1)).isin(*X.NICKNAMES)
    proper = (F.col("name") != F.upper("name")) & (F.instr("name", ",") == 0) & ~F.col("name").rlike(r"^\w\. ") & ~short
    names = rows.where("name is not null").groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).withColumn("proper", proper)
    names = names.groupBy("cluster").agg(F.max_by("name", F.struct("proper", "n", -F.col("first"))).alias("name"))
    entities, ids, merges = merged(df, "people", clusters, {"birth_date": picked.select("cluster", "birth_date"), "name": names})
    checked = entities.join(every.select(F.col("cluster").alias("person_id"), "won"), "person_id").withColumn("b", X.year_of(F.col("birth_date"))).withColumn("life", X.year_of(F.col("death_date")) - F.col("b"))
    long = F.coalesce(~F.col("life").between(15, 110), F.lit(False))
    early = F.exists("won", lambda y: ~(y - F.col("b")).between(17, 100))
    flags = [checked.where(long).select(*entry("people", "FLAG", "CONTRADICTION", F.col("person_id"), "birth_date", F.col("birth_date"), None, 0.0, "human lifespan")), checked.where(~long & early).select(*entry("people", "FLAG", "CONTRADICTION", F.col("person_id"), "birth_date", F.col("birth_date"), None, 0.0, "age at award"))]
    return entities, ids, [log, *broken, swapped, renamed, filled, odd, disputed, *merges, *flags]


def repair_relationships(df: DataFrame, people: DataFrame, events: DataFrame, person_rows: DataFrame, event_rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Ends on merged ids; links with an unknown end go and are flagged; an award's year is its event's; one row a link; inverse links that mostly exist are completed."""
    ends = people.select(F.lit(False).alias("e"), "old", "new").union(events.select(F.lit(True), "old", "new"))
    df = df.join(named(people, "src", "s"), "src", "left").withColumn("e", F.col("rel") == "received")
    df = df.join(ends.select("e", F.col("old").alias("dst"), F.col("new").alias("d")), ["e", "dst"], "left")
    df = written(df.join(event_rows.select(F.col("event_id").alias("d"), F.lit(True).alias("e"), F.col("year").alias("held")), ["e", "d"], "left"), "links")
    row = F.concat(F.lit("row"), F.col("pos").cast("string"))
    dangling = df.where("s is null or d is null").select(*entry("relationships", "FLAG", "BROKEN_REF", row, "dst", F.col("dst"), None, 0.0, "referential integrity", F.concat_ws(" ", "src", "rel", "dst")))
    good = df.where("s is not null and d is not null")
    wrong = F.col("held").isNotNull() & ~F.col("held").eqNullSafe(F.col("year"))
    years = good.where(wrong).select(*entry("relationships", "CORRECT", "CONTRADICTION", row, "year", F.col("year"), F.col("held"), 0.95, "event is authoritative"))
    good = good.select(F.col("s").alias("src"), "rel", F.col("d").alias("dst"), F.coalesce("held", "year").alias("year"), "pos")
    links = written(keep_first(good, ["src", "rel", "dst"], F.col("pos")).select("src", "rel", "dst", "year", F.col("pos").alias("from_row")), "distinct_links")
    # the inverse of a child's link is the parent's, by the gender of the one it starts from
    gender = person_rows.select(F.col("person_id").alias("src"), "gender")
    parent = F.when(F.col("gender") == "male", "father").when(F.col("gender") == "female", "mother")
    inverse = F.when(F.col("rel").isin("spouse", "sibling"), F.col("rel")).when(F.col("rel").isin("father", "mother"), "child").when(F.col("rel") == "child", parent)
    family = links.where("rel <> 'received'").join(gender, "src", "left").select(F.col("dst").alias("src"), inverse.alias("rel"), F.col("src").alias("dst"))
    family = written(family.join(links.select("src", "rel", "dst", F.lit(1).alias("there")), ["src", "rel", "dst"], "left"), "inverse_links")
    n, closed = family.agg(F.count(F.lit(1)), F.count("there")).first()
    share = closed / n if n else 0.0
    missing = family.where("rel is not null and there is null").select("src", "rel", "dst").distinct()
    added = missing.select("src", "rel", "dst", F.lit(None).cast("string").alias("year"), F.lit(None).cast("long").alias("from_row"))
    log = missing.select(*entry("relationships", "FILL", "MISSING", F.concat_ws(",", "src", "dst"), F.col("rel"), None, F.concat_ws(" ", "src", "rel", "dst"), share, "learned inverse completeness"))
    if share >= 0.6:
        links = links.union(added)
    births = person_rows.select("person_id", X.year_of(F.col("birth_date")).alias("b"))
    older = links.where("rel in ('father', 'mother')").join(births.select(F.col("person_id").alias("src"), F.col("b").alias("child")), "src").join(births.select(F.col("person_id").alias("dst"), F.col("b").alias("parent")), "dst")
    young = older.where("parent > child - 12").select(*entry("relationships", "FLAG", "CONTRADICTION", F.concat_ws(",", "src", "dst"), None, None, None, 0.0, "parent age"))
    return links, [dangling, years, *([log] if share >= 0.6 else []), young]


def repair(people: DataFrame, places: DataFrame, events: DataFrame, relationships: DataFrame) -> Repaired:
    """All stages. Tables have the columns of SCHEMAS and `pos`, the order of their rows, which breaks ties. The tables given stay as they are."""
    for name, df in (("people", people), ("places", places), ("events", events), ("relationships", relationships)):
        if gone := set(SCHEMAS[name]) - set(df.columns):
            raise ValueError(f"{name} lacks {sorted(gone)}")
    links = written(relationships.select(*SCHEMAS["relationships"], "pos"), "relationships")
    new_places, place_ids, log1 = repair_places(places)
    new_events, event_ids, log2 = repair_events(events, place_ids, links)
    won = links.where("rel = 'received'").join(named(event_ids, "dst", "event_id"), "dst").join(new_events.select("event_id", F.col("year").alias("held")), "event_id")
    awards = won.where(F.col("held").rlike("^[0-9]+$")).groupBy(F.col("src").alias("person_id")).agg(F.sort_array(F.collect_list(F.col("held").cast("int"))).alias("awards"))
    new_people, people_ids, log3 = repair_people(people, place_ids, awards, links)
    new_links, log4 = repair_relationships(links, people_ids, event_ids, new_people, new_events)
    actions = union_all([*log1, *log2, *log3, *log4]).dropDuplicates(["tbl", "kind", "records", "col", "before", "after"])
    ids = union_all([ids.select(F.lit(t).alias("tbl"), "old", "new") for t, ids in (("people", people_ids), ("places", place_ids), ("events", event_ids))])
    return Repaired(new_people, new_places, new_events, new_links, actions, ids)


def issues(actions: DataFrame) -> DataFrame:
    """tbl, issue, records, col, detail: what was found wrong, once each."""
    return actions.select("tbl", "issue", "records", "col", "detail").distinct()


def from_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A knowledge base drawn from the driver's tables, with duplicates, typos, placeholders and broken links put in by row number."""
    customer, nation, orders, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders", "region"))
    k = F.col("c_custkey")
    word = lambda salt: F.translate(F.substring(F.md5(F.concat(k.cast("string"), F.lit(salt))), 1, 7), "0123456789", "ghijklmnop")
    year, month = 1900 + k % 90, 1 + k % 12
    date = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), (1 + k % 28).cast("int"))
    death = F.when(k % 5 == 0, F.format_string("%04d-03-04", (year + 60 + k % 20).cast("int")))
    base = customer.select((k * 2).alias("pos"), F.concat(F.lit("P"), k.cast("string")).alias("person_id"), F.initcap(F.concat(word("a"), F.lit(" "), word("b"))).alias("name"), F.when(k % 40 == 7, F.lit("N/A")).otherwise(date).alias("birth_date"), death.alias("death_date"), F.when(k % 2 == 0, "male").otherwise("female").alias("gender"), F.concat(F.lit("L"), F.col("c_nationkey").cast("string")).alias("birth_place_id"), F.lit(None).cast("string").alias("death_place_id"))
    copies = base.where("pos % 40 = 0").select((F.col("pos") + 1).alias("pos"), F.concat("person_id", F.lit("x")).alias("person_id"), F.concat(F.element_at(F.split("name", " "), 2), F.lit(", "), F.element_at(F.split("name", " "), 1)).alias("name"), "birth_date", "death_date", "gender", "birth_place_id", "death_place_id")
    n = F.col("n_nationkey")
    town = F.initcap(F.translate(F.substring(F.md5(n.cast("string")), 1, 9), "0123456789", "ghijklmnop"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select((n * 2).cast("long").alias("pos"), F.concat(F.lit("L"), n.cast("string")).alias("place_id"), town.alias("name"), F.col("r_name").alias("country"))
    places = places.union(places.where("pos % 10 = 0").select(F.col("pos") + 1, F.concat("place_id", F.lit("x")), F.concat("name", F.lit("h")), F.lit("?")))
    y = (1950 + F.col("o_orderkey") % 50).cast("string")
    prize = F.concat(F.lit("Prize "), (F.col("o_orderkey") % 6).cast("string"))
    events = orders.select(F.col("o_orderkey").alias("pos"), F.format_string("EV%04d", F.col("o_orderkey")).alias("event_id"), F.concat_ws(" ", prize, y).alias("name"), prize.alias("prize"), F.when(F.col("o_orderkey") % 17 == 0, "1900").otherwise(y).alias("year"), F.concat(F.lit("L"), (F.col("o_orderkey") % 6).cast("string")).alias("place_id"))
    link = orders.select((F.col("o_orderkey") * 2).alias("pos"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("src"), F.when(F.col("o_orderkey") % 3 == 0, "received").otherwise("spouse").alias("rel"), F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 31 == 0, "EV-none").otherwise(F.format_string("EV%04d", F.col("o_orderkey")))).otherwise(F.concat(F.lit("P"), (F.col("o_custkey") + 1).cast("string"))).alias("dst"), F.when(F.col("o_orderkey") % 3 == 0, (1950 + F.col("o_orderkey") % 50).cast("string")).alias("year"))
    return {"people": base.union(copies), "places": places, "events": events, "relationships": link}


@query()
def kb_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by table, kind and status."""
    return repair(**from_tables(spark, sf_dir)).actions.groupBy("tbl", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query()
def kb_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(**from_tables(spark, sf_dir)).people.select("person_id", "name", "birth_date", "death_date", "gender", "source_records")


def copied(people: DataFrame, relationships: DataFrame, person_id: str, new_id: str) -> tuple[DataFrame, DataFrame]:
    """The tables with one person once more, the name turned to `Last, First`, with the same awards: a duplicate to find."""
    own = people.where(F.col("person_id") == person_id)
    turned = F.regexp_replace("name", r"^(.*)\s+(\S+)$", "$2, $1")
    again = own.withColumn("person_id", F.lit(new_id)).withColumn("name", turned).select(*people.columns)
    awards = relationships.where((F.col("src") == person_id) & (F.col("rel") == "received")).withColumn("src", F.lit(new_id))
    return people.unionByName(again), relationships.unionByName(awards.select(*relationships.columns))
