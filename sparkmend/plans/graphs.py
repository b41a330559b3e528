"""Queries of the graph operators, over a graph of customers drawn from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.operators import graph as G
from sparkmend.operators.components import connected_components
from sparkmend.operators.shared import written
from sparkmend.plans.registry import query, table

RELATIONS = "case o_orderstatus when 'F' then 'derived_from' when 'O' then 'informed_by' else 'grounds' end"
EDGES = f"e as (select distinct o_custkey as src, o_orderkey % (select count(*) from customer) as dst, {RELATIONS} as relation from orders where o_custkey <> o_orderkey % (select count(*) from customer))"


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges among customers: the buyer, and one picked by the order's number."""
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").join(F.broadcast(n))  # one row
    relation = F.when(F.col("o_orderstatus") == "F", "derived_from").when(F.col("o_orderstatus") == "O", "informed_by").otherwise("grounds")
    edges = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("n")).alias("dst"), relation.alias("relation")).where("src <> dst").distinct()
    return written(edges, "graph")


@query(f"""
with {EDGES}, d as (select node, count(*) as degree from (select src as node from e union all select dst from e) group by node)
select c_mktsegment as plane, node, degree from (select *, row_number() over (partition by c_mktsegment order by degree desc, node) as r from d join customer on node = c_custkey where degree > 2) where r <= 5
""")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("plane"))
    return G.hubs(graph(spark, sf_dir), nodes, "plane")


@query(f"""
with recursive {EDGES}, b as (select src, dst from e union select dst, src from e),
 r as (select c_custkey as node, 0 as depth from customer where c_acctbal < -950 union select b.dst, r.depth + 1 from r join b on b.src = r.node where r.depth < 2)
select node, min(depth) as depth from r group by node
""")
def impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").where("c_acctbal < -950").select(F.col("c_custkey").alias("node"))
    return G.reach(graph(spark, sf_dir), seeds, 2, undirected=True).select("node", "depth")


@query(f"""
with recursive {EDGES}, b as (select dst as src, src as dst, relation from e where relation in ('derived_from', 'informed_by')),
 r as (select c_custkey as node, 0 as depth from customer where c_acctbal < -950 union select b.dst, r.depth + 1 from r join b on b.src = r.node where r.depth < 6),
 m as (select node, min(depth) as depth from r group by node)
select x.node, x.depth, case when min(b.relation) = 'derived_from' then 'strong' else 'weak' end as strength from m x join b on b.dst = x.node join m y on y.node = b.src and y.depth = x.depth - 1 where x.depth > 0 group by x.node, x.depth
""")
def retraction_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").where("c_acctbal < -950").select(F.col("c_custkey").alias("node"))
    return G.retraction(graph(spark, sf_dir), seeds)


def unrolled(rounds: int, start: str, step: str, value: str, best: str) -> str:
    """CTEs x0, x1, ... in which a value spreads one step along (a, b) of `step` each time."""
    parts = [f"x0 as ({start})"]
    for k in range(rounds):
        parts.append(f"x{k + 1} as (select node, {best}({value}) as {value} from (select node, {value} from x{k} union all select a as node, {value} from {step} join x{k} on b = node) group by node)")
    return ", ".join(parts)


@query(f"with {EDGES}, s as (select distinct src as a, dst as b from e where relation in ('derived_from', 'grounds')), {unrolled(6, 'select c_custkey as node, c_nationkey % 4 as rank from customer', 's', 'rank', 'max')} select node, rank from x6")
def sensitivity_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 4).alias("rank"))
    return G.highest_upstream(graph(spark, sf_dir), ranks, ["derived_from", "grounds"])


@query(f"with {EDGES}, s as (select src as a, dst as b from e union select dst, src from e), {unrolled(16, 'select distinct a as node, a as component from s', 's', 'component', 'min')} select node, component from x16")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(graph(spark, sf_dir))


@query(f"""
with {EDGES}, n as (select src as node, 'out' as way, relation, dst as other from e union all select dst, 'in', relation, src from e),
 r as (select *, row_number() over (partition by node, way, relation order by other) as r from n)
select node, way, relation, string_agg(cast(other as varchar), ',' order by other) as others from r where r <= 10 group by node, way, relation
""")
def node_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    out = G.neighbours(graph(spark, sf_dir), seeds)
    return out.withColumn("others", F.array_join(F.transform("others", lambda x: x.cast("string")), ","))


@query(f"""
with recursive {EDGES}, b as (select src, dst from e union select dst, src from e), ends as (select min(src) as s, max(src) as t from (select src from b where src in (select src from e where relation = 'grounds'))),
 r as (select s as node, 0 as depth from ends union select b.dst, r.depth + 1 from r join b on b.src = r.node where r.depth < 12)
select cast(count(*) as bigint) as hops from (select unnest(range(0, (select min(depth) from r, ends where node = t) + 1)))
""")
def shortest_path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    start, goal = g.where("relation = 'grounds'").agg(F.min("src"), F.max("src")).first()
    return G.shortest_paths(g, start, goal).agg(F.count(F.lit(1)).alias("hops"))


@query(f"with {EDGES} select relation, count(*) as edges, count(distinct src) as sources from e group by relation")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))


@query("""
with m as (select distinct l_suppkey as item, l_partkey as grp from lineitem)
select x.item as a, y.item as b, count(*) as groups from m x join m y on x.grp = y.grp and x.item < y.item group by 1, 2
""")
def autolink_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("grp"))
    return G.shared_members(rows, "item", "grp")


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.communities(graph(spark, sf_dir))
