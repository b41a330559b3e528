"""Queries of the views, gates and readers' counterparts that put answers together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.functions import text as X
from sparkmend.operators import retrieval as R
from sparkmend.operators import views as W
from sparkmend.plans.graphs import EDGES, graph
from sparkmend.plans.registry import query, table


@query("""
with c as (select doc_id, 'lang' as col, lang as v from documents union all select doc_id, 'source', source from documents)
select doc_id, col, v as before from c where v is null or lower(trim(v)) in ('', 'n/a', 'na', 'unknown', '?', 'none', 'null', '-')
""")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that say nothing, logged even where they are null already."""
    d = table(spark, sf_dir, "documents")
    cells = d.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("before")) for c in ("lang", "source")))).alias("x")).select("doc_id", "x.col", "x.before")
    return cells.where(X.is_placeholder(F.col("before")))


@query("""
select l_suppkey as grp, coalesce(list_sort(list(l_quantity) filter (where l_quantity between 17 and 100))[cast(count(case when l_quantity between 17 and 100 then 1 end) // 2 as int) + 1], 55) as typical from lineitem group by 1
""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of the plausible values of each group, 55 without any. Values are counted first, so a hot group's rows are summed before they meet."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("grp"), F.when(F.col("l_quantity").between(17, 100), F.col("l_quantity")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "n")))).alias("all"))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
    at = F.floor(F.col("total") / 2)
    step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["n"] > at), x["v"].cast("double")).otherwise(a["v"]).alias("v"))
    return ranked.withColumn("total", total).select("grp", F.coalesce(F.aggregate("all", start, step)["v"], F.lit(55.0)).alias("typical"))


COSINE = "v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), p as (select q.vec_id as query_id, q.label as own, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 6) as score from v q, v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id)"


def similar(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k most similar other vectors of every 50th, with both labels."""
    v = table(spark, sf_dir, "embeddings")
    found = R.cosine_top_k(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", k + 1).where("query_id <> vec_id")
    labels = v.select("vec_id", "label")
    return found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")


@query(f"with {COSINE} select query_id, round(max(score), 4) as best, max(score) < 0.3 as refused from p group by 1")
def uncertainty_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.refusals(similar(spark, sf_dir, 1), "query_id", "score")
    return out.select("query_id", F.round("best", 4).alias("best"), "refused")


@query(f"""
with {COSINE}, s as (select query_id, vec_id, round(score * ((vec_id % 10) + 1) / 10, 6) as score from p where vec_id % 7 <> 0 and score >= 0.05)
select query_id, vec_id, round(score, 4) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 3
""")
def recall_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as turns: similarity times confidence among the active."""
    v = table(spark, sf_dir, "embeddings")
    # the best of a product of two numbers can stand anywhere in a list by one of them: every active turn is scored by vector, three a batch are kept
    turns = v.select("vec_id", ((F.col("vec_id") % 10 + 1) / 10).alias("confidence"), (F.col("vec_id") % 7 != 0).alias("active"))
    hits = R.cosine_top_k(v.where("vec_id % 7 <> 0"), v.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", v.count()).where("query_id <> vec_id")
    out = W.recalled(turns, hits, "query_id", "vec_id", "score", "confidence", "active", 0.05)
    return out.select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query(f"with {COSINE} select query_id, label as plane, vec_id, round(score, 4) as score from (select *, row_number() over (partition by query_id, label order by score desc, vec_id) as r from p where score >= 0.05) where r <= 3")
def cross_plane_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as planes: the three best of each plane, one ranking a plane."""
    v = table(spark, sf_dir, "embeddings")
    planes = [r.label for r in v.select("label").distinct().collect()]  # planes are few by definition
    asked = v.where("vec_id % 50 = 0")
    frames = [R.cosine_top_k(v.where(F.col("label") == p), asked, "vec_id", "embedding", "vec_id", "embedding", 4).where("query_id <> vec_id").withColumn("plane", F.lit(p)) for p in planes]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    out = R.top_k(every.drop("rank").where("score >= 0.05"), ["query_id", "plane"], "score", "vec_id", 3)
    return out.select("query_id", "plane", "vec_id", F.round("score", 4).alias("score"))


@query(f"with {COSINE} select query_id, vec_id, own, label, round(score, 4) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from p) where r <= 20 and own <> label and score >= 0.05")
def inferred_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between planes that similarity suggests: of the twenty nearest those of another plane."""
    found = similar(spark, sf_dir, 20)
    return found.where("own <> label and score >= 0.05").select("query_id", "vec_id", "own", "label", F.round("score", 4).alias("score"))


@query(f"""
with {EDGES}, n as (select src as node, 'out' as direction, relation, dst as other from e union all select dst, 'in', relation, src from e)
select node, direction, relation, count(distinct other) as n, min(other) as first, max(other) as last from n where relation in ('derived_from', 'informed_by') group by 1, 2, 3
""")
def decision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = W.decision_chain(graph(spark, sf_dir), ("derived_from", "informed_by"))
    return chain.select("node", "direction", "relation", F.size("others").cast("long").alias("n"), F.col("others")[0].alias("first"), F.element_at("others", -1).alias("last"))


@query(f"""
with {EDGES}, r as (select src as node, 'callees' as what, dst as other from e where relation = 'derived_from' union all select dst, 'callers', src from e where relation = 'derived_from' union all select src, 'docs', dst from e where relation = 'grounds' union all select src, 'chats', dst from e where relation = 'informed_by')
select c_custkey as node, count(distinct case when what = 'callers' then other end) as callers, count(distinct case when what = 'callees' then other end) as callees, count(distinct case when what = 'docs' then other end) as docs, count(distinct case when what = 'chats' then other end) as chats from customer left join r on c_custkey = node group by 1
""")
def edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds each symbol: who calls it, what it calls, documents and chats."""
    e = graph(spark, sf_dir)
    kinds = F.create_map(*(F.lit(x) for x in ("derived_from", "callees", "grounds", "docs", "informed_by", "chats")))
    around = e.select(F.col("src").alias("node"), kinds[F.col("relation")].alias("what"), F.col("dst").alias("other")).union(e.where("relation = 'derived_from'").select("dst", F.lit("callers"), "src"))
    wide = around.groupBy("node", "what").agg(F.count_distinct("other").alias("n")).groupBy("node").pivot("what", ["callers", "callees", "docs", "chats"]).agg(F.first("n"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return nodes.join(wide, "node", "left").na.fill(0, ["callers", "callees", "docs", "chats"])


@query("""
with p as (select distinct event_type as tier, user_id as entity, cast(ts as date) as episode from events), c as (select tier, entity, count(*) as episodes from p group by 1, 2)
select tier, entity, episodes, count(*) over (partition by tier) as entities from c
""")
def episode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return W.episode_index(e, "day", "user_id", "event_type")


@query("""
select o_orderkey as question, case when o_orderkey % 11 = 0 then 'structural' when o_orderkey % 7 = 0 then 'refuse_year' when o_orderkey % 5 = 0 then 'clarify' when o_orderstatus = 'P' then 'dual'
 when o_totalprice > 200000 then 'answer' when o_custkey % 4 < 2 then 'rewrite' else 'refuse' end as route from orders
""")
def answer_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    route = W.answer_route(k % 11 == 0, F.when(k % 7 == 0, 1).otherwise(0), k % 5 == 0, F.col("o_orderstatus") == "P", F.col("o_totalprice") > 200000, F.col("o_custkey") % 4)
    return table(spark, sf_dir, "orders").select(k.alias("question"), route.alias("route"))


@query("""
select o_custkey as subject, string_agg('- ' || o_orderpriority || case when o_orderstatus = 'P' then ' [DISPUTED]' else '' end, chr(10) order by o_orderkey) as block from orders group by 1
""")
def evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "subject")
    return W.evidence_block(o, "subject", "o_orderkey", F.col("o_orderpriority"), F.col("o_orderstatus") == "P")


@query("""
select o_custkey as community, count(case when o_orderstatus = 'F' then 1 end) as successes, count(case when o_orderstatus = 'O' then 1 end) as failures, count(case when o_orderstatus = 'P' then 1 end) as disputed,
 count(case when o_orderstatus = 'P' and o_orderpriority in ('1-URGENT', '2-HIGH') then 1 end) as open_conflicts from orders group by 1
""")
def antipattern_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    states = {"successes": s == "F", "failures": s == "O", "disputed": s == "P", "open_conflicts": (s == "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")}
    return W.counted_states(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "community"), "community", states)


@query("""
with n as (select p_name as name, max(p_partkey) as id from part group by 1), e as (select distinct a.p_name as s, b.p_name as d, 'calls' as relation from part a join part b on b.p_partkey = a.p_partkey + a.p_size)
select distinct x.id as src, y.id as dst, relation from e join n x on x.name = s join n y on y.name = d
""")
def named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are known by name only: the later of equal names is meant."""
    p = table(spark, sf_dir, "part")
    edges = p.select(F.col("p_name").alias("src_name"), (F.col("p_partkey") + F.col("p_size")).alias("k")).join(p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("dst_name")), "k")
    return W.named_edges(p, edges.select("src_name", "dst_name", F.lit("calls").alias("relation")), "p_partkey", "p_name", "p_partkey")


@query("""
with c as (select p_partkey, p_name, p_brand, p_size, count(*) over (partition by p_name) as n, count(*) over (partition by p_name, p_brand) as nb, count(*) over (partition by p_name, p_size) as ns from part)
select p_partkey, case when n = 1 then 'name' when p_brand is not null and nb = 1 then 'p_brand' when p_size is not null and ns = 1 then 'p_size' end as qualifier from c
""")
def unique_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes a question about a record mean that record alone."""
    return W.unique_facts(table(spark, sf_dir, "part"), "p_name", ["p_brand", "p_size"]).select("p_partkey", "qualifier")


@query("""
with c as (select count(*) as claims, count(case when o_orderstatus = 'P' then 1 end) as disputed, count(case when o_orderstatus = 'F' then 1 end) as resolved, count(case when o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH') then 1 end) as to_review, count(distinct o_custkey) as agents from orders) select * from c
""")
def reviewer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("claims"), n(s == "P").alias("disputed"), n(s == "F").alias("resolved"), n((s == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("to_review"), F.count_distinct("o_custkey").alias("agents"))


@query("""
select c.conv_id, c.turn, count(v.conv_id) as conflicts from conversations c left join (select conv_id, turn from conversations where length(text) % 5 = 0) v on v.conv_id = c.conv_id and v.turn < c.turn where c.role = 'user' group by 1, 2
""")
def retrieved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with how many earlier turns of its conversation were found to conflict."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    odd = F.when(F.length("text") % 5 == 0, 1)
    return table(spark, sf_dir, "conversations").withColumn("conflicts", F.count(odd).over(before)).where("role = 'user'").select("conv_id", "turn", "conflicts")
