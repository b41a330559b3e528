"""Queries of single rules: scores, memory, provenance, typos, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmend.functions import code as C
from sparkmend.functions import text as X
from sparkmend.operators import memory as M
from sparkmend.operators import ranking, scoring
from sparkmend.plans.registry import query, table


@query("""
with e as (select o_custkey as src, o_orderkey % 500 as dst from orders where o_orderstatus = 'F') select node, count(*) as n from (select src as node from e union all select dst from e) group by 1
""")
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 500).alias("dst"), F.when(F.col("o_orderstatus") == "F", "confirms").otherwise("grounds").alias("relation"))
    return scoring.corroboration(e)


@query("""
with s as (select o_orderkey as src, o_orderdate as t, o_orderstatus = 'P' as c, unnest([o_orderkey - 1, o_orderkey - 2, -5]) as dst from orders), k as (select o_orderkey as k, o_orderdate as held from orders where o_orderkey % 2 = 0)
select src, dst, case when k is null then 'grounds' when c then 'informed_by' else 'derived_from' end as relation from s left join k on dst = k where k is null or held < t
""")
def provenance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    claims = o.select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "P").alias("context"), F.array(F.col("o_orderkey") - 1, F.col("o_orderkey") - 2, F.lit(-5).cast("long")).alias("sources"))
    known = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"))
    return scoring.provenance(claims, "o_orderkey", "sources", known, "k", "at", "o_orderdate", "context")


@query("""
with f as (select c_custkey as id, c_nationkey as c from customer), t as (select c_custkey as id, c_custkey % 30 as c from customer),
 n as (select (select sum(n * (n - 1) / 2) from (select count(*) as n from f group by c)) as f, (select sum(n * (n - 1) / 2) from (select count(*) as n from t group by c)) as t, (select sum(n * (n - 1) / 2) from (select count(*) as n from f join t using (id) group by f.c, t.c)) as b)
select cast(f as bigint) as found, cast(t as bigint) as "true", cast(b as bigint) as hits, round(b / f, 6) as precision, round(b / t, 6) as recall, round(2 * (b / f) * (b / t) / (b / f + b / t), 6) as f1 from n
""")
def cluster_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return scoring.pairwise_scores(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("c")), c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 30).alias("c")), "id", "c")


@query("""
select round((count(*) * 2 - count(case when p_partkey % 10 = 0 then 1 end)) / (count(*) * 2), 6) as before, round((count(*) * 2 - count(case when p_partkey % 20 = 0 then 1 end) - count(case when p_partkey % 50 = 1 then 1 end)) / (count(*) * 2), 6) as after, count(case when p_partkey % 50 = 1 then 1 end) as harmed from part
""")
def cell_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("b_c"), F.when(k % 10 == 0, None).otherwise(F.col("p_brand")).alias("b_d"), F.when(k % 20 == 0, "?").otherwise(F.col("p_brand")).alias("b_r"), F.col("p_type").alias("t_c"), F.col("p_type").alias("t_d"), F.when(k % 50 == 1, "?").otherwise(F.col("p_type")).alias("t_r"))
    return scoring.cell_accuracy(rows, ["b", "t"])


@query("""
with d as (select case event_id % 3 when 0 then 'answer' when 1 then 'refuse' else 'conflict' end as e, case when value > 30 then 'answer' when value > 10 then 'refuse' else 'conflict' end as g from events)
select round(avg(case when g = 'answer' and e = 'refuse' then 1.0 else 0.0 end), 6) as hallucination, round(avg(case when g = e then 1.0 else 0.0 end), 6) as correct, round(avg(case when g = 'refuse' and e = 'answer' then 1.0 else 0.0 end), 6) as wrong_refusal from d
""")
def behaviour_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("event_id") % 3, F.col("value")
    d = table(spark, sf_dir, "events").select(F.when(k == 0, "answer").when(k == 1, "refuse").otherwise("conflict").alias("e"), F.when(v > 30, "answer").when(v > 10, "refuse").otherwise("conflict").alias("g"))
    return scoring.behaviour(d, "e", "g")


@query("""
with d as (select c_nationkey as q, c_custkey as id, 'annual report ' || case when c_nationkey % 2 = 0 then '2021' else '1999' end as question, 'file_' || (2019 + c_custkey % 5) as source from customer),
 h as (select *, regexp_extract(question, '20[0-9][0-9]') <> '' and contains(source, regexp_extract(question, '20[0-9][0-9]')) as hit from d), w as (select *, max(hit) over (partition by q) as named from h)
select q, id from w where hit or not named
""")
def document_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    d = table(spark, sf_dir, "customer").select(n.alias("q"), F.col("c_custkey").alias("id"), F.concat(F.lit("annual report "), F.when(n % 2 == 0, "2021").otherwise("1999")).alias("question"), F.concat(F.lit("file_"), (2019 + F.col("c_custkey") % 5).cast("string")).alias("source"))
    return scoring.scope_by_year(d, "question", "source", ["q"]).select("q", "id")


@query("""
with a as (select l_orderkey as page, l_linenumber as try, (l_quantity * 2) / 100 as conf, l_discount * 4 as garbage from lineitem), b as (select *, row_number() over (partition by page order by conf desc, garbage, try desc) as r from a)
select page, round(conf, 6) as conf, conf >= 0.85 as sure from b where r = 1
""")
def best_scan_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("try"), (F.col("l_quantity") * 2 / 100).alias("conf"), (F.col("l_discount") * 4).alias("garbage"))
    return scoring.best_attempt(a, "page", "conf", "garbage").select("page", F.round("conf", 6).alias("conf"), (F.col("conf") >= 0.85).alias("sure"))


@query("""
with n as (select p_partkey as id, case when p_partkey = 5 then 'samll ring' when p_partkey = 6 then 'redd widget' else p_name end as name from part) select id as row_id, case id when 5 then 'samll' else 'redd' end as token, case id when 5 then 'small' else 'red' end as fix from n where id in (5, 6)
""")
def name_token_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k == 5, "samll ring").when(k == 6, "redd widget").otherwise(F.col("p_name")).alias("name"))
    return scoring.token_typos(n, "id", "name")


@query("select event_id, count(*) over (partition by event_type order by ts range between interval 10 minute preceding and current row) > 3 as limited from events")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", scoring.rate_limited(e, ["event_type"], "ts", "event_id", 3, 600).alias("limited"))


@query("""
with p as (select o_custkey as id, min(year(o_orderdate)) - 30 as a, max(year(o_orderdate)) + 20 as b, list(cast(year(o_orderdate) as int)) as w from orders group by 1), s as (select id, case when id % 2 = 0 then b else a end as born, case when id % 2 = 0 then a else b end as died, w from p)
select id, cast(case when died < born then case when len([y for y in w if y >= died + 15 and y <= born + 1]) = len(w) then 0.95 else 0.7 end end as double) as confidence from s
""")
def date_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.min(y) - 30).alias("a"), (F.max(y) + 20).alias("b"), F.collect_list(y).alias("w"))
    even = F.col("id") % 2 == 0
    return p.select("id", scoring.plausible_swap(F.when(even, F.col("b")).otherwise(F.col("a")), F.when(even, F.col("a")).otherwise(F.col("b")), F.col("w")).alias("confidence"))


@query("""
with d as (select o_orderkey as id, o_custkey as q, round((o_totalprice % 100) / 100, 4) as sim, (o_orderkey % 10) / 10.0 as c, o_orderstatus as s from orders),
 s as (select id, q, cast(round(sim * c * case s when 'F' then 1.2 when 'O' then 0.8 else 1.0 end, 6) as double) as score from d where sim > 0.5) select q, id, score from (select *, row_number() over (partition by q order by score desc, id) as r from s) where r <= 3
""")
def decision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("q"), F.round((F.col("o_totalprice") % 100) / 100, 4).alias("sim"), ((F.col("o_orderkey") % 10) / 10).alias("c"), F.when(s == "F", "success").when(s == "O", "failure").otherwise("partial").alias("outcome"))
    scored = d.where("sim > 0.5").select("q", "id", F.round(M.recall_score(F.col("sim"), F.col("c"), F.col("outcome")), 6).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("""
with d as (select o_orderkey, round((o_totalprice % 100) / 100, 4) as sim, case o_orderstatus when 'F' then 1.0 when 'O' then 0.7 else 0.4 end as v, o_orderkey % 3 = 0 as conflict, cast(o_orderkey % 5 as double) / 5 as low from orders)
select o_orderkey, cast(round(least(1.0, sim + 0.25) * cast(v as double) * cast(case when conflict then 0.5 else 1.0 end as double) * (1 - cast(0.3 as double) * low), 10) as double) as confidence from d
""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    verdict = F.when(s == "F", "SUFFICIENT").when(s == "O", "PARTIAL").otherwise("INSUFFICIENT")
    c = X.answer_confidence(F.round((F.col("o_totalprice") % 100) / 100, 4), verdict, F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 5) / 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(c, 10).alias("confidence"))


@query("""
select event_id, case when event_id % 3 = 0 then 'python' when event_id % 3 = 1 then 'javascript' else 'unknown' end as language, event_id % 3 <> 2 as code from events
""")
def code_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    t = F.when(k == 0, "import os\ndef f(x):\n    return x\n").when(k == 1, "const f = (x) => {\n  return x;\n}\n").otherwise("The ring was sold.\nNobody knew why it was red.\n")
    return table(spark, sf_dir, "events").select("event_id", X.code_language(t).alias("language"), C.is_code(t).alias("code"))


@query("""
select p_partkey, 'compute_' || replace(p_name, ' ', '_') || ',load_file' as names from part
""")
def code_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("def compute_"), F.regexp_replace("p_name", " ", "_"), F.lit("(x):\n    return load_file(x) + abs(1)\n"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.identifiers(t), ",").alias("names"))


@query("""
with c as (select l_suppkey as agent, l_orderkey as id, l_returnflag as flag, l_discount as d from lineitem), a as (select agent, count(*) as n, count(distinct flag) as flags, round(avg(d), 6) as mean from c group by 1)
select agent, n, flags, mean, n >= 40 as some, n >= 300 as enough from a
""")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("agent")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("flags"), F.round(F.avg("l_discount"), 6).alias("mean"))
    return a.select("*", (F.col("n") >= 40).alias("some"), (F.col("n") >= 300).alias("enough"))


@query("""
with r as (select l_orderkey as id, l_partkey as name, l_returnflag as v, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber) as k from lineitem), t as (select name, v as top from r where k = 1)
select round(avg(case when bad then 1.0 else 0.0 end), 6) as rate from (select name, max(v <> top) as bad from r join t using (name) group by 1)
""")
def conflicting_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    top = l.groupBy("l_partkey").agg(F.max_by("l_returnflag", F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("top"))
    return l.join(top, "l_partkey").groupBy("l_partkey").agg(F.max(F.col("l_returnflag") != F.col("top")).alias("bad")).agg(F.round(F.avg(F.col("bad").cast("double")), 6).alias("rate"))


@query("""
with a as (select o_custkey as p, list_sort(list(o_orderkey)) as k from orders where o_orderpriority = '1-URGENT' group by 1) select c_custkey, c_name, coalesce(array_to_string(k, ','), '') as awards from customer left join a on p = c_custkey
""")
def award_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    return table(spark, sf_dir, "customer").join(a, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce(F.array_join(F.transform("k", lambda x: x.cast("string")), ","), F.lit("")).alias("awards"))


@query("""
select s.step, s.stage, count(*) as n, count(case when bad then 1 end) as bad from (values (0, 'given'), (1, 'placeholders'), (2, 'ranges')) s(step, stage), lateral (select case when s.step = 0 then p_size % 7 = 0 or p_size > 40 when s.step = 1 then p_size > 40 else false end as bad from part) group by 1, 2
""")
def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_size")
    stages = [("given", p.withColumn("bad", (F.col("p_size") % 7 == 0) | (F.col("p_size") > 40))), ("placeholders", p.withColumn("bad", F.col("p_size") > 40)), ("ranges", p.withColumn("bad", F.lit(False)))]
    return ranking.timeline(stages, lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad")))


@query("""
select o_custkey, count(*) as n, max(case when o_orderstatus = 'O' then o_orderkey end) as open_key from orders where o_custkey is null or o_custkey % 2 = 0 group by 1
""")
def namespace_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("ns", F.when(F.col("o_custkey") % 2 == 0, "own").otherwise("other"))
    return o.where(ranking.visible(F.col("ns"), "own")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("open_key"))
