"""Queries of the remaining operators: search, reports, formats, linkage, stores, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmend.functions import code as C
from sparkmend.functions import text as X
from sparkmend.operators import episodes, linkage, ranking, vote
from sparkmend.operators import retrieval as R
from sparkmend.operators.shared import written
from sparkmend.plans.registry import query, table
from sparkmend.sources import store
from sparkmend.sources import tables as S


@query("""
select c_custkey, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || case when c_custkey % 3 <> 0 then ' | c_mktsegment: ' || c_mktsegment else '' end as sentence from customer
""")
def record_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return c.select("c_custkey", S.sentences(c).alias("sentence"))


@query("""
with d as (select p_partkey, case p_partkey % 3 when 0 then p_size || ' mm' when 1 then p_size || '.0 in' else p_size || ' cm' end as size from part)
select p_partkey, regexp_extract(size, '^[0-9]+') as size from d
""")
def strip_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    d = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, F.concat(s, F.lit(" mm"))).when(k == 1, F.concat(s, F.lit(".0 in"))).otherwise(F.concat(s, F.lit(" cm"))).alias("size"))
    return linkage.strip_units(d, "size")


@query("""
with d as (select p_partkey, case when p_partkey % 3 = 0 then p_name || ' ' || p_type else p_name end as n, p_type from part), e as (select *, ends_with(n, ' ' || p_type) as ends, rtrim(substr(n, 1, length(n) - length(p_type) - 1), ' ,') as short from d),
 c as (select count(case when ends then 1 end) as hits, count(*) as rows from e)
select p_partkey, case when ends and hits >= 5 and hits < 0.5 * rows and short in (select n from d) then short else n end as p_name, p_type from e, c
""")
def redundant_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "), "p_type")).otherwise(F.col("p_name")).alias("p_name"), "p_type")
    return linkage.redundant_suffix(d, "p_name", "p_type")


@query("""
select case when c_custkey % 4 = 0 then 'temporal' when c_custkey % 4 = 1 then 'entity' when c_custkey % 4 = 2 then 'event' else 'general' end as intent, count(*) as n from customer group by 1
""")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    q = F.when(k == 0, "When was it sold?").when(k == 1, "Who bought the widget?").when(k == 2, "What happened at the shop?").otherwise("List all widgets")
    return table(spark, sf_dir, "customer").groupBy(X.intent(q).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select o_orderkey, case when p >= 0.9 then 'applied' when p >= 0.6 then 'needs_review' else 'flagged_only' end as band, case o_orderstatus when 'F' then 3 when 'O' then 0 else 2 end as rank
from (select *, (o_orderkey % 100) / 100.0 as p from orders)
""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    label = F.when(s == "F", "no such label").when(s == "O", " ").otherwise("Confidential")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.confidence_band((F.col("o_orderkey") % 100) / 100).alias("band"), X.rank_of(label).alias("rank"))


@query("""
select p_partkey, p_name, lower(p_name) = 'red widget' or ends_with(lower(p_name), 'red widget') as exact from part where contains(lower(p_name), 'red widget') or ends_with(cast(p_partkey as varchar), ':red widget') order by exact desc, p_partkey limit 20
""")
def find_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.find(table(spark, sf_dir, "part"), "p_name", "p_partkey", "Red Widget")


@query("""
with r as (select value, row_number() over (order by value, event_id) as r, count(*) over () as n from events) select max(case when r = n // 2 + 1 then value end) as p50, max(case when r = greatest(1, cast(floor(0.95 * n) as bigint)) then value end) as p95 from r
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sorted_percentiles(table(spark, sf_dir, "events"), "value", "event_id")


@query("""
select * from (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'F' and contains(lower(o_orderpriority), 'high') order by o_orderkey limit 25 offset 50)
""")
def action_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return ranking.paged(o, ["o_orderkey"], 50, 25, holds="HIGH", equal={"o_orderstatus": "F"})


@query("""
with d as (select event_id, user_id, value, event_type, row_number() over (partition by user_id, event_type order by value desc, event_id) as r from events where value >= 5),
 f as (select *, row_number() over (partition by user_id order by value desc, event_id) as k from d where r = 1) select event_id, user_id, value, event_type from f where k <= 3
""")
def distinct_label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    return ranking.distinct_labels(e, ["user_id"], "event_type", "value", "event_id", 5.0, 3)


@query("""
with k as (select l_partkey as key, l_suppkey as target, round(sum(l_discount), 6) as score from lineitem group by 1, 2) select key, target, score from (select *, row_number() over (partition by key order by score desc, target) as r from k where score >= 0.05) where r = 1
""")
def best_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("target")).agg(F.round(F.sum("l_discount"), 6).alias("score"))
    return ranking.best_target(k, "key", "target", "score", 0.05)


@query("""
with n as (select c_custkey as id, c_mktsegment as seg, case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as bal from customer where c_custkey % 7 <> 0), o as (select c_custkey as id, c_mktsegment as seg, c_acctbal as bal from customer where c_custkey % 5 <> 0)
select n.id, n.seg, n.bal from n left join o on n.id = o.id where o.id is null or n.seg <> o.seg or n.bal <> o.bal
""")
def diff_upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    new = c.where("id % 7 <> 0").withColumn("bal", F.when(F.col("id") % 10 == 0, F.col("bal") + 1).otherwise(F.col("bal")))
    return store.changed_rows(new, c.where("id % 5 <> 0"), ["id"])


@query("""
with a as (select cast(doc_id as varchar) as path, case when doc_id % 6 = 0 then text || '!' else text end as t from documents where doc_id % 4 <> 0), b as (select cast(doc_id as varchar) as path, text as t from documents where doc_id % 5 <> 0)
select path, case when b.t is null then 'new' when a.t is null then 'dropped' when a.t = b.t then 'unchanged' else 'changed' end as state from a full join b using (path)
""")
def incremental_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    now = d.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.file_changes(now, d.where("doc_id % 5 <> 0"))


@query("""
with d as (select o_custkey as node, count(*) as d from orders group by 1) select c_custkey as node, c_mktsegment as plane, round(3 + least(coalesce(d, 0) + case when c_custkey in (select l_suppkey from lineitem where l_orderkey < 0) then 1 else 0 end, 18) * cast(0.55 as double), 2) as size from customer left join d on c_custkey = node
""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("plane"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey") - 1).alias("dst"))
    return store.graph_export(nodes, edges)


@query("""
select item_id, sha1(lower(trim(text))) as key, substr(text, 1, 600) as preview, strlen(text) as bytes from benchmark
""")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha1(F.lower(F.trim(t)).cast("binary")).alias("key"), F.substring(t, 1, 600).alias("preview"), F.octet_length(t).cast("long").alias("bytes"))


@query("""
with q as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-zé]{2,}'))) as e from benchmark), d as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-zé]{2,}'))) as e from documents),
 s as (select query_id, doc_id, count(*) as hits from q join d using (e) group by 1, 2) select query_id, doc_id, hits from (select *, row_number() over (partition by query_id order by hits desc, doc_id) as r from s) where r <= 25
""")
def entity_match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-zé]{2,}"), F.lit(0))))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), names(F.col("text")).alias("e"))
    d = table(spark, sf_dir, "documents").select("doc_id", names(F.col("text")).alias("e")).join(q.select("e").distinct(), "e", "left_semi")
    s = q.join(d, "e").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    return R.top_k(s, ["query_id"], "hits", "doc_id", 25).drop("rank")


@query("""
with d as (select doc_id, source, text as head, row_number() over (partition by source order by doc_id) as r from documents) select source, regexp_extract(head, '^[^\\n]*') as first_line from d where r = 1
""")
def gap_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("head"))
    return first.select("source", F.regexp_extract("head", "^[^\n]*", 0).alias("first_line"))


@query("""
select o_custkey, count(*) as n, string_agg(cast(o_orderkey as varchar), ',' order by o_orderdate, o_orderkey) as keys from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r <= 15 group by 1
""")
def topic_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 15")
    rows = last.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("s"))
    return rows.select("o_custkey", "n", F.array_join(F.transform("s.o_orderkey", lambda x: x.cast("string")), ",").alias("keys"))


@query("""
with b as (select label, count(*) as n, 'label' as what from embeddings group by 1) select cast(label as varchar) as value, n, round(n / sum(n) over (), 6) as share from b
""")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = b.agg(F.sum("n").alias("total"))
    return b.join(F.broadcast(total)).select(F.col("label").cast("string").alias("value"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""
with f as (select item_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{4}'))) as y from benchmark), d as (select distinct unnest(regexp_extract_all(text, '[0-9]{4}')) as y from documents)
select item_id, count(f.y) as asked, count(case when f.y not in (select y from d) then 1 end) as unknown from benchmark left join f using (item_id) group by 1
""")
def unknown_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = lambda c: F.regexp_extract_all(c, F.lit("[0-9]{4}"), F.lit(0))
    known = table(spark, sf_dir, "documents").select(F.explode(years(F.col("text"))).alias("y")).distinct().withColumn("k", F.lit(1))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode_outer(F.array_distinct(years(F.col("text")))).alias("y"))
    return asked.join(known, "y", "left").groupBy("item_id").agg(F.count("y").alias("asked"), F.count(F.when(F.col("y").isNotNull() & F.col("k").isNull(), 1)).alias("unknown"))


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label at a cosine of 0.3, led by the least."""
    v = table(spark, sf_dir, "embeddings")
    pairs = written(R.similar_pairs(v, "vec_id", "embedding", "label", 0.3), "similar")
    return ranking.leader_clusters(v.withColumn("name", F.concat(F.lit("vector "), F.col("vec_id").cast("string"))), pairs, "vec_id", "name")


@query()
def linkage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record linkage over people drawn from customers, a tenth of them twice with a letter changed."""
    c = table(spark, sf_dir, "customer")
    word = lambda salt: F.translate(F.substring(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(salt))), 1, 7), "0123456789", "ghijklmnop")
    base = c.select(
        F.col("c_custkey").alias("rec"), word("g").alias("given_name"), word("s").alias("surname"), F.format_string("%04d0101", (1900 + F.col("c_custkey") % 90).cast("int")).alias("date_of_birth"), F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("soc_sec_id"),
        F.lpad((F.col("c_custkey") % 300).cast("string"), 4, "0").alias("postcode"), word("u").alias("suburb"), word("a").alias("address_1"), F.lit(None).cast("string").alias("address_2"), (F.col("c_custkey") % 99).cast("string").alias("street_number"), F.col("c_nationkey").cast("string").alias("state"),
    )
    copies = base.where("rec % 10 = 0").withColumn("rec", -F.col("rec") - 1).withColumn("surname", F.concat(F.substring("surname", 1, 6), F.lit("x")))
    return linkage.linked(written(base.union(copies), "records"), "rec")


@query("""
with s as (select user_id as episode_id, 'ValueError' as signature, list_sort(list_distinct(list(event_type))) as tools from events group by 1), p as (select x.episode_id as asked_id, y.episode_id, round(1.0 + 0.5 * len(list_intersect(x.tools, y.tools)) / len(list_distinct(list_concat(x.tools, y.tools))), 6) as score from s x, s y where x.episode_id % 50 = 0 and x.episode_id <> y.episode_id)
select asked_id, episode_id, cast(score as double) as score from (select *, row_number() over (partition by asked_id order by score desc, episode_id) as r from p) where r <= 5
""")
def similar_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode_id")).agg(F.sort_array(F.collect_set("event_type")).alias("tools")).withColumn("signature", F.lit("ValueError"))
    s = written(s, "episodes")
    return episodes.similar_failures(s, s.where("episode_id % 50 = 0"))


@query("""
with p as (select doc_id, unnest(string_split(text, chr(10))) as p from documents) select doc_id, count(*) as parts, cast(sum(length(p)) as bigint) as chars from p where trim(p) <> '' group by 1
""")
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("p")).where(F.trim("p") != "")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("p")).cast("long").alias("chars"))


@query()
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of small files made from parts."""
    name = F.regexp_replace("p_name", " ", "_")
    text = F.concat(F.lit("import os\n\nclass "), F.initcap("p_brand"), F.lit(":\n    def "), name, F.lit("(self):\n        # NOTE: kept for old callers\n        return 1\n"))
    text = F.regexp_replace(text, "#([0-9])", "$1")
    return C.symbols(table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))).select("path", "symbol", "kind", "lineno")


@query("""
with m as (select l_returnflag as city, l_linestatus as land, count(*) as n from lineitem group by 1, 2), b as (select city, max(n) / sum(n) as share from m group by 1) select round(avg(share), 6) as consistency, count(*) as cities from b
""")
def majority_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_orderkey"))
    v = vote.majority(lines, ["l_returnflag"], "l_linestatus", "pos")
    return v.agg(F.round(F.avg("share"), 6).alias("consistency"), F.count(F.lit(1)).alias("cities"))


@query("""
select l_shipmode as status, n from (select case when l_quantity > 40 then 'applied' when l_quantity > 20 then 'needs_review' else 'flagged_only' end as l_shipmode, count(*) as n from lineitem group by 1)
""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.when(q > 40, "applied").when(q > 20, "needs_review").otherwise("flagged_only").alias("status")).agg(F.count(F.lit(1)).alias("n"))
