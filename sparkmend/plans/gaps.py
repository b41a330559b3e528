"""Queries of people rules, fix rates, trials, claim search, lineage and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmend.operators import blocking, linkage, scoring
from sparkmend.operators.shared import written
from sparkmend.plans import kb
from sparkmend.plans.registry import query, table


@query("""
with p as (select c_custkey as person_id, case when c_custkey % 4 = 0 then null when c_custkey % 2 = 0 then 'female' else 'male' end as own from customer),
 i as (select o_custkey as person_id, case when o_orderstatus = 'F' then 'male' else 'female' end as g, o_orderkey as pos from orders where o_orderstatus <> 'P' and o_orderpriority = '1-URGENT'),
 f as (select person_id, arg_min(g, pos) as first, count(distinct g) as kinds from i group by 1), t as (select person_id, own, first, kinds, coalesce(own, first) as gender from p join f using (person_id))
select person_id, gender, case when gender <> first or kinds > 1 then 'FLAG' else 'FILL' end as action from t where gender <> first or kinds > 1 or own is null
""")
def implied_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(k.alias("person_id"), F.when(k % 4 == 0, None).when(k % 2 == 0, "female").otherwise("male").alias("gender"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' and o_orderpriority = '1-URGENT'")
    return scoring.implied_gender(people, o.select(F.col("o_custkey").alias("dst"), F.when(F.col("o_orderstatus") == "F", "father").otherwise("mother").alias("rel"), F.col("o_orderkey").alias("pos")))


@query("""
with a as (select o_custkey as person_id, year(o_orderdate) as year, year(o_orderdate) - (1890 + o_custkey % 100) as age from orders), o as (select person_id, year, age, row_number() over (partition by person_id order by year, age) as r from a where age < 17 or age > 100)
select person_id, year, age from o where r = 1
""")
def award_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), (1890 + F.col("c_custkey") % 100).alias("born"))
    awards = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.year("o_orderdate").cast("long").alias("year"))
    return scoring.award_age_flags(people, awards)


@query()
def fix_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors put into part names, repaired by the nearest frequent name, by kind of error."""
    from sparkmend.functions.similarity import osa_udf

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    dirty, log = linkage.injected(part, "p_partkey", "p_name", share=0.01)
    dirty = written(dirty, "dirty")
    fixes = blocking.vocabulary_fix(dirty, "p_name", "p_partkey", osa_udf(), rare_below=5).select(F.col("rare").alias("p_name"), "fix")
    repaired = dirty.join(fixes, "p_name", "left").select("p_partkey", F.coalesce("fix", "p_name").alias("p_name"))
    return scoring.fix_rates(log, repaired, "p_partkey", "p_name")


@query("""
select key, winner from (select l_orderkey as key, count(case when l_returnflag = 'A' then 1 end) as p, count(case when l_returnflag <> 'A' then 1 end) as f, max(case when l_returnflag = 'A' then l_suppkey end) as winner from lineitem group by 1) where p = 1 and f = 1
""")
def decided_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_returnflag") == "A").alias("ok"), F.col("l_suppkey").alias("side"))
    return scoring.decided_trials(t, "key", "ok")


@query("""
with q as (select item_id as query_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') as s from benchmark),
 u as (select query_id, w, min(i) as i from (select query_id, unnest(s) as w, generate_subscripts(s, 1) as i from q) where length(w) > 2 group by 1, 2),
 t as (select query_id, w from (select *, row_number() over (partition by query_id order by i) as r from u) where r <= 12),
 h as (select distinct query_id, doc_id as claim_id, n_chars as asserted_at from (select doc_id, n_chars, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'))) as w from documents where lang <> 'de') join t using (w))
select query_id, claim_id from (select *, row_number() over (partition by query_id order by asserted_at desc, claim_id desc) as r from h) where r <= 12
""")
def search_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for claims, their texts for subjects, German ones for retracted claims, lengths for times."""
    claims = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("subject"), F.lit("ACCEPTED").alias("write_verdict"), (F.col("lang") == "de").alias("retracted"), F.col("n_chars").alias("asserted_at"))
    return scoring.search_claims(claims, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))


@query("""
select doc_id, source || '.txt' || case when doc_id % 2 = 0 then ', p. ' || doc_id % 9 else '' end || case when doc_id % 3 = 0 then ' (OCR ' || (50 + doc_id % 50) || '%)' else '' end || case when doc_id % 5 = 0 then ' [code]' else '' end as cited from documents
""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    c = scoring.citation(F.concat("source", F.lit(".txt")), F.when(k % 2 == 0, k % 9), F.when(k % 3 == 0, "ocr").otherwise("native"), (50 + k % 50) / 100, F.when(k % 5 == 0, "code").otherwise("prose"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("cited"))


@query("""
with b as (select p_partkey as id, p_brand || p_size as k1, p_name || p_type as k2 from part), g as (select x.id as a, y.id as b from b x join b y on x.k1 = y.k1 and x.id < y.id)
select count(*) as gold, count(case when f then 1 end) as found, round(count(case when f then 1 end) / count(*), 6) as recall from (select g.a, g.b, x.k2 = y.k2 as f from g join b x on g.a = x.id join b y on g.b = y.id)
""")
def blocking_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs of one brand and size, how many a block by name and type finds."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("k1"), F.concat("p_name", "p_type").alias("k2"))
    return blocking.block_recall(p, "id", "k1", "k2")


@query("""
with g as (select conv_id, turn from conversations where role = 'assistant') select g.conv_id, g.turn, cast(count(*) as bigint) as reached from g join conversations c on c.conv_id = g.conv_id and c.turn < g.turn and c.turn >= g.turn - 3 group by 1, 2
""")
def follows_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the three turns before an answer are there."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-3, -1)
    return table(spark, sf_dir, "conversations").withColumn("reached", F.count(F.lit(1)).over(w)).where("role = 'assistant' and reached > 0").select("conv_id", "turn", "reached")


@query()
def kb_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell of the repaired people with the records it came from, what they said, and whether it was kept or repaired."""
    given = kb.from_tables(spark, sf_dir)
    done = kb.repair(**given).people
    cols = kb.SCHEMAS["people"][1:]
    cells = done.select("person_id", F.explode(F.split("source_records", ",")).alias("record"), F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols)).alias("x"))
    cells = cells.select("person_id", "record", F.explode("x").alias("x")).select("person_id", "record", "x.col", "x.value")
    was = given["people"].select(F.col("person_id").alias("record"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("was")) for c in cols))).alias("x")).select("record", "x.col", "x.was")
    same = F.max(F.col("was").eqNullSafe(F.col("value")))
    out = cells.join(was, ["record", "col"]).groupBy("person_id", "col", "value").agg(F.array_join(F.sort_array(F.collect_set("record")), ",").alias("from_records"), same.alias("kept"))
    return out.select("person_id", "col", "value", "from_records", F.when(F.col("kept"), "original").otherwise("repaired").alias("status"))
