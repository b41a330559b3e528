"""How good a knowledge base is, with and without a clean copy, and seeded damage to try a repair on."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.functions import text as X
from sparkmend.operators.shared import written
from sparkmend.operators.vote import union_all
from sparkmend.plans import kb
from sparkmend.plans.registry import query, table

REQUIRED = {"people": ("name", "birth_date", "gender", "birth_place_id"), "places": ("name", "country"), "events": ("name", "prize", "year", "place_id")}
JUDGED = {"people": ("name", "birth_date", "death_date", "gender", "birth_place_id", "death_place_id"), "places": ("name", "country"), "events": ("name", "year", "place_id")}
REFERENCES = {("people", "birth_place_id"): "places", ("people", "death_place_id"): "places", ("events", "place_id"): "places"}
Tables = dict[str, DataFrame]


def value(c: Column) -> Column:
    """The trimmed cell, null if it says nothing."""
    return F.when(~X.is_placeholder(c), F.trim(c))


def person_key(name: Column) -> Column:
    """First letter and last word of a name, `Last, First` turned round; a single word as it is."""
    low = F.lower(F.coalesce(value(name), F.lit("")))
    turned = F.when(F.instr(low, ",") > 0, F.concat_ws(" ", F.trim(F.regexp_replace(low, "^[^,]*,", "")), F.trim(F.substring_index(low, ",", 1)))).otherwise(low)
    words = F.filter(F.split(turned, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 1, F.concat_ws("|", F.substring(words[0], 1, 1), F.element_at(words, -1))).otherwise(turned)


def label(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(value(name), F.lit("")), r"([0-9]{4})\s*$", 1), F.lit(""))


def counts_of(tables: Tables) -> DataFrame:
    """One row of the counts that the dimensions are made of, and of violations by rule."""
    p, pl, e, r = (tables[t] for t in ("people", "places", "events", "relationships"))
    cells = union_all([tables[t].select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cs))).alias("x")).select("x.*") for t, cs in REQUIRED.items()])
    v = value(F.col("v"))
    well = F.when(F.col("c") == "birth_date", v.rlike(r"^\d{4}-\d{2}-\d{2}$")).when(F.col("c") == "year", v.rlike("^[0-9]{4}$")).otherwise(True)
    filled = cells.agg(F.count(F.lit(1)).alias("cells"), F.count(v).alias("filled"), F.count(F.when(v.isNotNull() & well, 1)).alias("valid"))
    keys = union_all([
        p.select(F.concat_ws("#", F.lit("p"), person_key(F.col("name")), F.substring(F.coalesce(value(F.col("birth_date")), F.lit("")), 6, 9)).alias("k")),
        pl.select(F.concat_ws("#", F.lit("l"), F.trim(F.lower(F.regexp_replace(F.coalesce(value(F.col("name")), F.lit("")), "(?s),.*$", "")))).alias("k")),
        e.select(F.concat_ws("#", F.lit("e"), F.coalesce("prize", F.lit("\x00")), F.coalesce(label(F.col("name")), F.lit("\x00"))).alias("k")),
    ])
    copies = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("entities"), F.sum(F.col("n") - 1).alias("copies"))
    year = lambda c: X.year_of(value(F.col(c)))
    events = e.select("event_id", F.lit(True).alias("e"), year("year").alias("held"), (label(F.col("name")) != value(F.col("year"))).alias("off"))
    lives = p.select("person_id", year("birth_date").alias("b"), (year("death_date") - year("birth_date")).alias("life"))
    back = r.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rel").alias("back")).where("back in ('child', 'spouse')").distinct()
    links = r.select("src", "rel", "dst", value(F.col("year")).alias("y"), (F.col("rel") == "received").alias("is_event"))
    links = links.withColumn("back", F.when(F.col("rel").isin("father", "mother"), "child").when(F.col("rel") == "spouse", "spouse"))
    links = links.join(back.withColumn("closed", F.lit(True)), ["src", "dst", "back"], "left")
    people = lives.select(F.col("person_id").alias("id"), "b", F.lit(False).alias("is_event"))
    targets = people.select(F.col("id").alias("dst"), "is_event", F.lit(None).cast("int").alias("held"), F.lit(True).alias("found")).union(events.select("event_id", "e", "held", F.lit(True)))
    links = links.join(targets, ["dst", "is_event"], "left").join(people.select(F.col("id").alias("src"), "b", F.lit(True).alias("known")), "src", "left")
    age = F.col("held") - F.col("b")
    broken = links.agg(
        F.count(F.lit(1)).alias("links"), (F.count("found") + F.count("known")).alias("ends"),
        F.count(F.when(F.col("is_event") & (F.col("y").cast("int") != F.col("held")), 1)).alias("award_year"), F.count(F.when(F.col("is_event") & ~age.between(17, 100), 1)).alias("award_age"),
        F.count(F.when((F.col("back") == "child") & F.col("closed").isNull(), 1)).alias("no_child_link"), F.count(F.when((F.col("back") == "spouse") & F.col("closed").isNull(), 1)).alias("one_sided"),
    )
    own = events.agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("off"), 1)).alias("event_year")).crossJoin(lives.agg(F.count(F.lit(1)).alias("persons"), F.count(F.when(~F.col("life").between(15, 110), 1)).alias("lifespan")))
    refs = union_all([tables[t].select(value(F.col(c)).alias("place_id")) for t, c in REFERENCES]).where("place_id is not null")
    refs = refs.join(pl.select("place_id", F.lit(1).alias("there")).distinct(), "place_id", "left").agg(F.count(F.lit(1)).alias("refs"), F.count("there").alias("good_refs"))
    out = filled
    for one in (copies, broken, own, refs):  # rows of one each
        out = out.crossJoin(one)
    return out


def dq(tables: Tables) -> DataFrame:
    """One row: completeness, validity, uniqueness, consistency, integrity, dq (their mean), violations. Shares of nothing are 1."""
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(1.0), 4)
    c = F.col
    wrong = c("award_year") + c("award_age") + c("no_child_link") + c("one_sided") + c("event_year") + c("lifespan")
    entities = c("persons") + c("events") + c("links")
    row = counts_of(tables).select(
        share(c("filled"), c("cells")).alias("completeness"), share(c("valid"), c("filled")).alias("validity"), share(c("entities") - c("copies"), c("entities")).alias("uniqueness"),
        share(entities - wrong, entities).alias("consistency"), share(c("good_refs") + c("ends"), c("refs") + 2 * c("links")).alias("integrity"), wrong.alias("violations"),
    )
    return row.select("*", F.round((c("completeness") + c("validity") + c("uniqueness") + c("consistency") + c("integrity")) / 5, 4).alias("dq"))


def true_ids(done: kb.Repaired, truth: DataFrame) -> DataFrame:
    """tbl, new, gold: the clean id of each entity, that of most of its records, the least of equals. truth: tbl, old, gold."""
    votes = done.ids.join(truth, ["tbl", "old"], "left").withColumn("gold", F.coalesce("gold", "old")).groupBy("tbl", "new", "gold").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("tbl", "new").agg(F.min_by("gold", F.struct(-F.col("n"), F.col("gold"))).alias("gold"))


def score(done: kb.Repaired, dirty: Tables, clean: Tables, truth: DataFrame) -> DataFrame:
    """measure, value: cell accuracy before and after and harm (right before, wrong after) for each table, pairwise precision and
    recall of merges, and precision, recall and F1 of the links before and after, ids read as those of the clean copy."""
    names = written(true_ids(done, truth), "true_ids")
    of_record = written(done.ids.join(truth, ["tbl", "old"], "left").withColumn("gold", F.coalesce("gold", "old")), "true_records")
    place = of_record.where("tbl = 'places'").select(F.col("old").alias("v"), "new").join(names.where("tbl = 'places'").select("new", F.col("gold").alias("means")), "new").select("v", "means")
    parts = []
    for t, cs in JUDGED.items():
        key = kb.SCHEMAS[t][0]
        cells = lambda df, k, name: df.select(F.col(k).alias("id"), F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.nullif(F.trim(c), F.lit("")).alias(name)) for c in cs))).alias("x")).select("id", "x.c", f"x.{name}")  # noqa: B023, E731
        rows = of_record.where(F.col("tbl") == t).select(F.col("old").alias("record"), F.col("new").alias("entity"), F.col("gold").alias("gold_id"))
        both = rows.join(cells(dirty[t], key, "b").withColumnRenamed("id", "record"), "record").join(cells(getattr(done, t), key, "a").withColumnRenamed("id", "entity"), ["entity", "c"])
        both = both.join(cells(clean[t], key, "g").withColumnRenamed("id", "gold_id"), ["gold_id", "c"])
        for side in "ab":
            meaning = place.select(F.col("v").alias(side), F.col("means").alias(f"m_{side}"))
            reference = F.col("c").isin(*(c for (x, c) in REFERENCES if x == t))
            both = both.join(meaning, side, "left").withColumn(side, F.when(reference, F.coalesce(f"m_{side}", side)).otherwise(F.col(side))).drop(f"m_{side}")
        right = {side: F.col(side).eqNullSafe(F.col("g")) for side in "ab"}
        told = both.agg(F.count(F.lit(1)).alias("cells"), *(F.count(F.when(x, 1)).alias(n) for n, x in (("before", right["b"]), ("after", right["a"]), ("harm", right["b"] & ~right["a"]))))
        parts.append(told.select(F.lit(t).alias("t"), F.expr("stack(4, 'cells', cast(cells as double), 'accuracy_before', before / cells, 'accuracy_after', after / cells, 'harm', cast(harm as double)) as (m, value)")))
        pairs = lambda *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)))  # noqa: B023, E731
        found, real, same = (pairs(*by).first()[0] for by in (("entity",), ("gold_id",), ("entity", "gold_id")))
        parts.append(rows.sparkSession.createDataFrame([(t, "merge_precision", same / found if found else 1.0), (t, "merge_recall", same / real if real else 1.0)], "t string, m string, value double"))
    ends = of_record.select("tbl", F.col("old").alias("v"), "gold").union(names.select("tbl", "new", "gold")).distinct()
    ends = ends.groupBy("tbl", "v").agg(F.min("gold").alias("gold"))

    def read(df: DataFrame) -> DataFrame:
        df = df.select("src", "rel", "dst", F.nullif(F.trim("year"), F.lit("")).alias("year"), F.when(F.col("rel") == "received", "events").otherwise("people").alias("tbl"))
        df = df.join(ends.where("tbl = 'people'").select(F.col("v").alias("src"), F.col("gold").alias("s")), "src", "left").join(ends.select("tbl", F.col("v").alias("dst"), F.col("gold").alias("d")), ["tbl", "dst"], "left")
        return df.select(F.coalesce("s", "src").alias("src"), "rel", F.coalesce("d", "dst").alias("dst"), F.coalesce("year", F.lit("")).alias("year")).distinct()

    gold = written(read(clean["relationships"]), "gold_links")
    n_gold = gold.count()
    for name, df in (("before", dirty["relationships"]), ("after", done.relationships)):
        mine = written(read(df), f"links_{name}")
        hit, n = mine.join(gold, ["src", "rel", "dst", "year"]).count(), mine.count()
        p, r = hit / n if n else 0.0, hit / n_gold if n_gold else 0.0
        parts.append(gold.sparkSession.createDataFrame([("relationships", f"{m}_{name}", float(v)) for m, v in (("precision", p), ("recall", r), ("f1", 2 * p * r / (p + r) if p + r else 0.0))], "t string, m string, value double"))
    return union_all([p.select(F.concat_ws("_", "t", "m").alias("measure"), F.round("value", 6).alias("value")) for p in parts])


def draw(salt: str, seed: int, *by: str) -> Column:
    """A number from 0 to 1 for each row, the same in every run and however the rows are dealt."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}:{salt}"), *by), F.lit(1 << 30)) / float(1 << 30)


def mistyped(c: Column, dice: Column) -> Column:
    """Two neighbours swapped, or a letter lost, or one doubled, at a place that the dice choose; shorter strings than four stay."""
    at = (F.floor(dice * 997 % 1 * (F.length(c) - 3)) + 2).cast("int")
    piece = lambda a, n: F.substr(c, a, n)
    rest = F.length(c)
    head, one, two = piece(F.lit(1), at - 1), piece(at, F.lit(1)), piece(at + 1, F.lit(1))
    made = F.when(dice < 1 / 3, F.concat(head, two, one, piece(at + 2, rest))).when(dice < 2 / 3, F.concat(head, piece(at + 1, rest))).otherwise(F.concat(head, one, piece(at, rest)))
    return F.when(F.length(c) >= 4, made).otherwise(c)


def corrupted(clean: Tables, seed: int = 7, copies: float = 0.12, typos: float = 0.05, missing: float = 0.05, wrong: float = 0.05) -> tuple[Tables, DataFrame, DataFrame]:
    """Damaged tables, the truth (tbl, old, gold), and a log (tbl, kind, id, col, was, now) of every change.

    Copies of a share of the records under other spellings; typing errors, emptied cells, dates and years that are off, places that are wrong;
    links that lead to copies, lose their inverse, or lead nowhere. All by hashes of ids, so a seed always gives the same.
    """
    key = {t: kb.SCHEMAS[t][0] for t in ("people", "places", "events")}
    out, truth, logs = {}, [], []
    name = F.col("name")
    words = F.split(name, r"\s+")
    last, front = F.element_at(words, -1), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    d = draw("variant", seed, "id")
    person = F.when(F.size(words) < 2, mistyped(name, d)).when(d < 0.25, F.concat_ws(", ", last, front)).when(d < 0.5, F.concat(F.substring(name, 1, 1), F.lit(". "), F.substr(name, F.instr(name, " ") + 1))).when(d < 0.75, F.upper(name)).otherwise(mistyped(name, d * 7 % 1))
    spelled = {"people": person, "places": F.when(d < 1 / 3, F.upper(name)).when(d < 2 / 3, mistyped(name, d * 3 % 1)).otherwise(F.concat_ws(", ", "name", "country")), "events": mistyped(name, d)}
    for t, k in key.items():
        rows = clean[t].select(F.col(k).alias("id"), *kb.SCHEMAS[t][1:], "pos")
        again = rows.where(draw("copy", seed, "id") < copies).withColumn("name", spelled[t]).withColumn("old", F.col("id")).withColumn("id", F.concat(F.lit(f"X{t[0].upper()}"), "id"))
        if t == "people":
            again = again.withColumn("birth_place_id", F.when(draw("home", seed, "old") >= 0.4, F.col("birth_place_id")))
        both = rows.withColumn("old", F.col("id")).unionByName(again)
        truth.append(both.select(F.lit(t).alias("tbl"), F.col("id").alias("old"), F.col("old").alias("gold")))
        logs.append(again.select(F.lit(t).alias("tbl"), F.lit("DUPLICATE").alias("kind"), "id", F.lit(None).cast("string").alias("col"), F.col("old").alias("was"), F.col("id").alias("now")))
        out[t] = both.drop("old").withColumn("pos", F.xxhash64(F.lit(seed), "id"))

    def damage(t: str, kind: str, col: str, where: Column, new: Column) -> None:
        before, hit = out[t], F.coalesce(where, F.lit(False))
        logs.append(before.where(hit).select(F.lit(t).alias("tbl"), F.lit(kind).alias("kind"), "id", F.lit(col).alias("col"), F.col(col).alias("was"), new.cast("string").alias("now")))
        out[t] = before.withColumn(col, F.when(hit, new.cast("string")).otherwise(F.col(col)))

    def at(t: str, salt: str) -> Column:
        return draw(f"{t} {salt}", seed, "id")

    def shifted(col: str, by: Column) -> Column:
        return F.concat(F.format_string("%04d", (F.substring(col, 1, 4).cast("int") + by).cast("int")), F.substring(col, 5, 10))

    dated = lambda c: F.col(c).rlike(r"^\d{4}")
    damage("people", "TYPO", "name", at("people", "typo") < typos, mistyped(F.col("name"), at("people", "typo") / typos))
    for k, c in enumerate(("birth_date", "birth_place_id", "gender")):
        damage("people", "MISSING", c, F.col(c).isNotNull() & at("people", "missing").between(missing * k / 3, missing * (k + 1) / 3 - 1e-12), F.element_at(F.array(*map(F.lit, ("", "N/A", "unknown", "?"))), (F.floor(at("people", "which") * 4) + 1).cast("int")))
    damage("people", "CONTRADICTION", "birth_date", dated("birth_date") & (at("people", "wrong") < wrong), shifted("birth_date", F.element_at(F.array(*map(F.lit, (-40, -30, 30, 40, 60))), (F.floor(at("people", "by") * 5) + 1).cast("int"))))
    swap = dated("birth_date") & dated("death_date") & at("people", "swap").between(0, wrong / 2) & (at("people", "wrong") >= wrong)
    out["people"] = out["people"].withColumn("b0", F.col("birth_date")).withColumn("d0", F.col("death_date"))
    hit = F.coalesce(swap, F.lit(False))
    out["people"] = out["people"].withColumn("birth_date", F.when(hit, F.col("d0")).otherwise(F.col("b0"))).withColumn("death_date", F.when(hit, F.col("b0")).otherwise(F.col("d0")))
    for c, was, now in (("birth_date", "b0", "d0"), ("death_date", "d0", "b0")):
        logs.append(out["people"].where(F.col("b0") != F.col("birth_date")).select(F.lit("people").alias("tbl"), F.lit("CONTRADICTION").alias("kind"), "id", F.lit(c).alias("col"), F.col(was).alias("was"), F.col(now).alias("now")))
    out["people"] = out["people"].drop("b0", "d0")
    damage("people", "BROKEN_REF", "birth_place_id", at("people", "nowhere") < 0.02, F.concat(F.lit("Q9"), F.abs(F.xxhash64("id")) % 10_000_000))
    damage("places", "TYPO", "name", at("places", "typo") < typos, mistyped(F.col("name"), at("places", "typo") / typos))
    damage("places", "MISSING", "country", F.col("country").isNotNull() & (at("places", "missing") < missing), F.lit("?"))
    damage("places", "TYPO", "country", (at("places", "missing") >= missing) & (at("places", "country") < typos), mistyped(F.col("country"), at("places", "country") / typos))
    damage("events", "CONTRADICTION", "year", F.col("year").rlike("^[0-9]+$") & (at("events", "year") < wrong), F.col("year").cast("int") + F.element_at(F.array(*map(F.lit, (-2, -1, 1, 3))), (F.floor(at("events", "by") * 4) + 1).cast("int")))
    somewhere = clean["places"].agg(F.min("place_id").alias("a"), F.max("place_id").alias("b"))
    out["events"] = out["events"].crossJoin(somewhere)  # one row
    damage("events", "CONTRADICTION", "place_id", at("events", "place") < wrong, F.when(F.col("place_id") != F.col("a"), F.col("a")).otherwise(F.col("b")))
    out["events"] = out["events"].drop("a", "b")
    dup = truth[0].union(truth[2]).where("old <> gold").select(F.col("tbl"), F.col("gold").alias("v"), F.col("old").alias("copy"))
    r = clean["relationships"].select("src", "rel", "dst", "year", "pos").withColumn("tbl", F.when(F.col("rel") == "received", "events").otherwise("people")).withColumn("id", F.concat_ws("|", "src", "rel", "dst"))
    r = r.join(dup.where("tbl = 'people'").select(F.col("v").alias("src"), F.col("copy").alias("sc")), "src", "left").join(dup.select("tbl", F.col("v").alias("dst"), F.col("copy").alias("dc")), ["tbl", "dst"], "left")
    r = r.withColumn("src", F.when(F.col("sc").isNotNull() & (at("links", "src") < 0.5), F.col("sc")).otherwise(F.col("src"))).withColumn("dst", F.when(F.col("dc").isNotNull() & (at("links", "dst") < 0.5), F.col("dc")).otherwise(F.col("dst")))
    lost = F.col("rel").isin("child", "spouse") & (at("links", "lost") < 0.3)
    logs.append(r.where(lost).select(F.lit("relationships").alias("tbl"), F.lit("MISSING").alias("kind"), F.col("src").alias("id"), F.col("rel").alias("col"), F.col("dst").alias("was"), F.lit(None).cast("string").alias("now")))
    out["relationships"] = r.where(~lost).drop("sc", "dc", "tbl")
    damage("relationships", "CONTRADICTION", "year", (F.col("rel") == "received") & F.col("year").rlike("^[0-9]+$") & (at("links", "year") < wrong), F.col("year").cast("int") + F.element_at(F.array(*map(F.lit, (-1, 1, 2))), (F.floor(at("links", "by") * 3) + 1).cast("int")))
    damage("relationships", "BROKEN_REF", "dst", at("links", "nowhere") < 0.02, F.concat(F.lit("Q9"), F.abs(F.xxhash64("id")) % 10_000_000))
    tables = {t: written(out[t].withColumnRenamed("id", key[t]).select(*kb.SCHEMAS[t], "pos"), f"dirty_{t}") for t in key}
    tables["relationships"] = written(out["relationships"].select(*kb.SCHEMAS["relationships"], "pos"), "dirty_links")
    return tables, written(union_all(truth), "truth"), written(union_all(logs), "damage")


def clean_base(spark: SparkSession, sf_dir: str) -> Tables:
    """A knowledge base without faults, drawn from the driver's tables: people of three generations from customers, places from parts, prizes of 120 years."""
    given = {"male": ("William", "Robert", "Richard", "James", "John", "Charles", "Edward", "Michael", "Thomas", "Joseph"), "female": ("Anna", "Clara", "Ellen", "Flora", "Greta", "Helen", "Irene", "Laura", "Maria", "Nora")}
    customer, part, nation = (table(spark, sf_dir, t) for t in ("customer", "part", "nation"))
    k = F.col("c_custkey")
    dice = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "c_custkey"), F.lit(n))
    word = lambda c, salt: F.initcap(F.translate(F.substring(F.md5(F.concat(c.cast("string"), F.lit(salt))), 1, 8), "0123456789", "ghijklmnop"))
    gender = F.when(F.floor(k / 3) % 2 == 0, "male").otherwise("female")
    first = F.when(gender == "male", F.element_at(F.array(*map(F.lit, given["male"])), (dice("given", 10) + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, given["female"])), (dice("given", 10) + 1).cast("int")))
    born = (1870 + 30 * (k % 3) + dice("born", 8)).cast("int")
    n_places = part.count()
    at_place = lambda salt: F.concat(F.lit("L"), (dice(salt, n_places) + 1).cast("string"))
    day = lambda y, salt: F.format_string("%04d-%02d-%02d", y, (dice(salt + "m", 12) + 1).cast("int"), (dice(salt + "d", 28) + 1).cast("int"))
    person = lambda c: F.concat(F.lit("P"), c.cast("string"))
    people = customer.select(k.cast("long").alias("pos"), person(k).alias("person_id"), F.concat_ws(" ", first, word(k, "s")).alias("name"), day(born, "b").alias("birth_date"), F.when(dice("dead", 3) > 0, day((born + 75 + dice("age", 20)).cast("int"), "e")).alias("death_date"), gender.alias("gender"), at_place("birth").alias("birth_place_id"), F.when(dice("dead", 3) > 0, at_place("death")).alias("death_place_id"))
    q = F.col("p_partkey")
    places = part.join(F.broadcast(nation), F.pmod(F.xxhash64("p_partkey"), F.lit(25)) == F.col("n_nationkey")).select(q.cast("long").alias("pos"), F.concat(F.lit("L"), q.cast("string")).alias("place_id"), word(q, "p").alias("name"), F.initcap("n_name").alias("country"))
    event = lambda prize, year: F.concat(F.lit("EV"), prize.cast("string"), F.lit("-"), year.cast("string"))
    names = F.array(*(F.lit(f"{x} Prize") for x in ("Arts", "Biology", "Chemistry", "Drama", "Economy", "Peace")))
    i = F.col("id")
    prize, held = (i % 6).cast("int"), (1890 + F.floor(i / 6)).cast("string")
    events = spark.range(6 * 120).select(i.alias("pos"), event(prize, held).alias("event_id"), F.concat_ws(" ", F.element_at(names, prize + 1), held).alias("name"), F.element_at(names, prize + 1).alias("prize"), held.alias("year"), F.concat(F.lit("L"), (prize % 3 + 1).cast("string")).alias("place_id"))
    won = (born + 35 + dice("won", 30)).cast("string")
    least, most = customer.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    later, parent = k + 3, k - 1
    links = [
        customer.select(person(k).alias("src"), F.lit("received").alias("rel"), event(dice("prize", 6), won).alias("dst"), won.alias("year")),
        *(customer.where((F.floor(k / 3) % 2 == 0) & (later <= most)).select(person(a).alias("src"), F.lit("spouse").alias("rel"), person(b).alias("dst"), F.lit(None).cast("string").alias("year")) for a, b in ((k, later), (later, k))),
        customer.where((k % 3 > 0) & (parent >= least)).select(person(k).alias("src"), F.when(gender == "male", "father").otherwise("mother").alias("rel"), person(parent).alias("dst"), F.lit(None).cast("string").alias("year")),
        customer.where((k % 3 > 0) & (parent >= least)).select(person(parent).alias("src"), F.lit("child").alias("rel"), person(k).alias("dst"), F.lit(None).cast("string").alias("year")),
    ]
    relationships = union_all(links).withColumn("pos", F.xxhash64("src", "rel", "dst"))
    return {t: written(df, f"clean_{t}") for t, df in (("people", people), ("places", places), ("events", events), ("relationships", relationships))}


@query()
def kb_dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of the knowledge base before and after its repair."""
    given = kb.from_tables(spark, sf_dir)
    done = kb.repair(**given)
    after = {t: getattr(done, t) for t in kb.SCHEMAS}
    return dq(given).select(F.lit("before").alias("stage"), "*").union(dq(after).select(F.lit("after"), "*"))


@query()
def kb_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean knowledge base is damaged, repaired, and held against itself."""
    clean = clean_base(spark, sf_dir)
    dirty, truth, _ = corrupted(clean)
    return score(kb.repair(**dirty), dirty, clean, truth)


REPORT = """<!doctype html><meta charset="utf-8"><title>Repair report</title>
<style>body{font:15px sans-serif;margin:2em}td,th{padding:2px 10px;text-align:left}</style>
<h1>Repair report</h1><div id="out"></div>
<script>
const data = DATA;
const out = document.getElementById("out");
for (const [title, rows] of Object.entries(data)) {
  const head = document.createElement("h2"); head.textContent = title; out.append(head);
  const grid = document.createElement("table"); out.append(grid);
  const names = [...new Set(rows.flatMap(Object.keys))];
  for (const row of [Object.fromEntries(names.map(n => [n, n])), ...rows]) {
    const line = document.createElement("tr"); grid.append(line);
    for (const n of names) { const cell = document.createElement("td"); cell.textContent = row[n] ?? ""; line.append(cell); }
  }
}
</script>
"""


def lineage(done: kb.Repaired, given: Tables) -> DataFrame:
    """tbl, entity_id, col, value, from_records, status: for each cell of an entity the records that say the same, and whether it is original, repaired or derived (none says it)."""
    parts = []
    for t in ("people", "places", "events"):
        key, cs = kb.SCHEMAS[t][0], kb.SCHEMAS[t][1:]
        cells = lambda df, k, name: df.select(F.col(k).alias("id"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias(name)) for c in cs))).alias("x")).select("id", "x.col", f"x.{name}")  # noqa: B023, E731
        said = cells(given[t], key, "was").withColumnRenamed("id", "old").join(done.ids.where(F.col("tbl") == t).select("old", F.col("new").alias("id")), "old")
        both = cells(getattr(done, t), key, "value").join(said, ["id", "col"])
        same = F.col("was").eqNullSafe(F.col("value"))
        cell = both.groupBy("id", "col").agg(F.first("value").alias("value"), F.array_join(F.sort_array(F.collect_set(F.when(same & F.col("value").isNotNull(), F.col("old")))), ",").alias("from_records"), F.min(same).alias("all"), F.max(same).alias("any"))
        status = F.when(F.col("all"), "original").when(F.col("any"), "repaired").otherwise("derived")
        parts.append(cell.select(F.lit(t).alias("tbl"), F.col("id").alias("entity_id"), "col", "value", "from_records", status.alias("status")))
    return union_all(parts)


def export(done: kb.Repaired, given: Tables, folder: str) -> None:
    """Writes repaired tables, lineage, issues and actions as CSV, and quality.json and report.html, each a folder of Spark's part files.

    The report holds counts and measures only, so its size does not grow with the tables.
    """
    after = {t: getattr(done, t) for t in kb.SCHEMAS}
    tables = {f"repaired_{t}": df for t, df in after.items()} | {"lineage": lineage(done, given), "issues": kb.issues(done.actions), "actions": done.actions}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    quality = dq(given).select(F.lit("before").alias("stage"), "*").union(dq(after).select(F.lit("after"), "*"))
    counts = done.actions.groupBy("tbl", "kind", "issue", "status").agg(F.count(F.lit(1)).alias("n")).orderBy("tbl", "kind", "issue", "status")
    quality.coalesce(1).write.mode("overwrite").json(f"{folder}/quality.json")
    data = {"Quality": [r.asDict() for r in quality.collect()], "Actions": [r.asDict() for r in counts.collect()]}
    page = REPORT.replace("DATA", json.dumps(data).replace("</", "<\\/"), 1)
    quality.sparkSession.createDataFrame([(page,)], "page string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.html")
