"""Queries of the claim and episode operators; events stand for claims and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.functions import text as X
from sparkmend.operators import episodes as E
from sparkmend.operators import governance as V
from sparkmend.operators import memory as M
from sparkmend.plans.registry import query, table

CLAIMS = "c as (select event_id as claim_id, 'main' as namespace, cast(user_id as varchar) as subject, event_type as relation, cast(cast(round(value) as bigint) % 5 as varchar) as canonical, 'agent' || (event_id % 4) as claimant, cast(day(ts) as int) as valid_from, cast(day(ts) + 1 as int) as valid_until from events)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    return e.select(
        F.col("event_id").alias("claim_id"), F.lit("main").alias("namespace"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("relation"), (F.round("value").cast("long") % 5).cast("string").alias("canonical"),
        F.concat(F.lit("agent"), (F.col("event_id") % 4).cast("string")).alias("claimant"), day.alias("valid_from"), (day + 1).alias("valid_until"), ((F.col("event_id") % 10) / 10).alias("confidence"), F.col("ts").alias("asserted_at"),
    )


@query("".join(["with ", CLAIMS, """
select x.claim_id as a, y.claim_id as b from c x join c y on x.subject = y.subject and x.relation = y.relation and x.claim_id < y.claim_id and x.canonical <> y.canonical and x.valid_from <= y.valid_until and y.valid_from <= x.valid_until
"""]))
def conflict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.conflicts(claims(spark, sf_dir))


@query()
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.admit(claims(spark, sf_dir))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as n from events")
def trailing_hour_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.trailing_count(["user_id"], "ts").alias("n"))


@query("""
with s as (select user_id, case event_type when 'purchase' then 'accepted' when 'signup' then 'confirmed' when 'error' then 'conflicted' when 'click' then 'won' else 'lost' end as kind, count(*) as n from events group by 1, 2),
 t as (select user_id, cast(least(1000, greatest(0, 500 + sum(n * case kind when 'accepted' then 2 when 'confirmed' then 6 when 'conflicted' then -3 when 'won' then 30 else -60 end))) as bigint) as score from s group by 1)
select user_id, score, case when score >= 700 then 'high' when score >= 450 then 'normal' when score >= 250 then 'low' else 'untrusted' end as band from t
""")
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "purchase", "accepted").when(t == "signup", "confirmed").when(t == "error", "conflicted").when(t == "click", "won").otherwise("lost")
    signals = table(spark, sf_dir, "events").groupBy("user_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return V.trust_scores(signals, "user_id")


@query("""
with r as (select value, event_type <> 'error' as ok, row_number() over (order by value, event_id) as r, count(*) over () as n from events)
select cast(floor((r - 1) / greatest(1, n // 8)) as bigint) as bin, max(value) as edge, round(avg(case when ok then 1.0 else 0.0 end), 6) as accuracy, count(*) as n from r group by 1
""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("value", (F.col("event_type") != "error").alias("ok"), "event_id")
    return V.calibration(e, "value", "ok", "event_id")


@query("""
with t as (select cast(user_id as varchar) as subject, event_type as relation, cast(round(value) as bigint) % 3 as canonical, 's' || (event_id % 3) as source from events)
select subject, relation, count(distinct canonical) as n_values, count(distinct source) as n_sources, string_agg(distinct cast(canonical as varchar), '|' order by cast(canonical as varchar)) as "values" from t group by 1, 2 having count(distinct canonical) >= 2 and count(distinct source) >= 2
""")
def contradiction_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = e.select(F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("relation"), (F.round("value").cast("long") % 3).cast("string").alias("canonical"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("source"))
    return V.contradictions(t)


@query("""
with s as (select o_custkey as conflict_id, o_orderkey as claim_id from orders), w as (select o_custkey as conflict_id, max(o_orderkey) as winner from orders where o_orderpriority = '1-URGENT' group by 1)
select conflict_id, claim_id, case when winner is null then 'CONFLICTED' when claim_id = winner then 'ACCEPTED' else 'RETRACTED' end as verdict, coalesce(claim_id <> winner, false) as retracted from s left join w using (conflict_id)
""")
def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conflict_id"), F.col("o_orderkey").alias("claim_id"), "o_orderpriority")
    winners = sides.where("o_orderpriority = '1-URGENT'").groupBy("conflict_id").agg(F.max("claim_id").alias("claim_id"))
    return V.adjudicate(sides.drop("o_orderpriority"), winners)


@query("select user_id, event_type, count(*) as calls, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as failures, cast(trunc(avg(value * 10)) as bigint) as mean_ms from events group by 1, 2")
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error").withColumn("ms", F.col("value") * 10)
    return E.tool_usage(e, "user_id", "event_type", "failed", "ms")


@query("""
with e as (select *, case when event_type = 'error' then 'ValueError: bad value ' || cast(value as varchar) end as err, row_number() over w as r, lag(event_type) over w = event_type as again from events window w as (partition by user_id order by event_id))
select user_id, count(*) as n_calls, cast(sum(case when again then 1 else 0 end) as bigint) as n_retries, case when count(err) > 0 then 'ValueError' end as last_error, string_agg(case when r <= 40 then event_type end, ',' order by r) as tools, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) as seconds from e group by 1
""")
def episode_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("err", F.when(F.col("event_type") == "error", F.concat(F.lit("ValueError: bad value "), F.col("value").cast("string"))))
    return E.rollup(e, "user_id", "event_id", "ts", "event_type", "err")


@query("""
with l as (select event_type, event_id, user_id, ts, lag(user_id) over w as f, lag(ts) over w as b from events window w as (partition by event_type order by ts, event_id))
select event_type, event_id, f as from_agent, user_id as to_agent, round(epoch_us(ts) / 1e6 - epoch_us(b) / 1e6, 2) as gap from l where f <> user_id
""")
def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.handoffs(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", "event_id")


@query("""
with e as (select event_id, case event_id % 3 when 0 then 'TimeoutError: after ' || event_id || ' s' when 1 then 'cannot open /tmp/x' || event_id || '/y file ' || event_id else 'core.ParseException at 5' end as err from events)
select case event_id % 3 when 0 then 'TimeoutError' when 1 then 'cannot open  file' else 'core.ParseException' end as signature, count(*) as n from e group by 1
""")
def failure_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("event_id") % 3, F.col("event_id").cast("string")
    err = F.when(k == 0, F.concat(F.lit("TimeoutError: after "), s, F.lit(" s"))).when(k == 1, F.concat(F.lit("cannot open /tmp/x"), s, F.lit("/y file "), s)).otherwise("core.ParseException at 5")
    return table(spark, sf_dir, "events").groupBy(X.failure_signature(err).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select event_id, user_id from events where ts >= (select max(ts) from events) - interval 10 day or user_id in (select user_id from events where event_type = 'error' group by 1 having count(*) > 15)
""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "episode_id")
    bad = e.where("event_type = 'error'").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n")).where("n > 15").select("episode_id", F.lit("FAILURE").alias("outcome"))
    now = e.agg(F.max("ts")).first()[0]
    return V.retained(e, bad, F.lit(now), 10).select("event_id", F.col("episode_id").alias("user_id"))


@query("""
select o_orderkey, o_custkey, o_totalprice from (select *, case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 when '3-MEDIUM' then 1 when '5-LOW' then 0 else 1 end as s from orders where o_orderstatus = 'O') order by s desc, o_orderdate, o_orderkey limit 50
""")
def conflict_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    label = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "5-LOW", "low").when(p == "3-MEDIUM", "normal").otherwise("odd")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("s", X.severity_rank(label))
    return o.orderBy(F.desc("s"), "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
select o_orderkey, round(case when date_diff('day', cast(o_orderdate as date), date '1998-06-30') > 90 then greatest(0.0, round((o_orderkey % 10) / 10.0 - 0.1, 6)) else (o_orderkey % 10) / 10.0 end, 6) as confidence,
 round(least(1.0, greatest(0.0, (o_orderkey % 10) / 10.0 + case o_orderstatus when 'F' then -0.3 when 'O' then 0.1 else 0.0 end)), 6) as after_outcome from orders
""".replace("round(case when", "cast(round(case when").replace("end, 6) as confidence", "end, 6) as double) as confidence").replace("round(least(", "cast(round(least(").replace("end)), 6) as after", "end)), 6) as double) as after"))
def decay_and_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = (F.col("o_orderkey") % 10) / 10
    outcome = F.when(F.col("o_orderstatus") == "F", "failure").when(F.col("o_orderstatus") == "O", "success")
    return o.select("o_orderkey", F.round(M.decayed(c, F.col("o_orderdate"), F.lit("1998-06-30").cast("date")), 6).alias("confidence"), F.round(M.after_outcome(c, outcome), 6).alias("after_outcome"))


@query("""
with d as (select unnest([c_nationkey, c_custkey % 7]) as community, case c_mktsegment when 'BUILDING' then 'success' when 'MACHINERY' then 'failure' when 'FURNITURE' then 'partial' else 'unknown' end as o from customer)
select cast(community as bigint) as community, count(*) as n, round(avg(case when o = 'success' then 1.0 else 0.0 end), 3) as success, round(avg(case when o = 'failure' then 1.0 else 0.0 end), 3) as failure, round(avg(case when o = 'partial' then 1.0 else 0.0 end), 3) as partial, round(avg(case when o = 'unknown' then 1.0 else 0.0 end), 3) as unknown from d group by 1
""")
def outcome_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    s = F.col("c_mktsegment")
    o = F.when(s == "BUILDING", "success").when(s == "MACHINERY", "failure").when(s == "FURNITURE", "partial")
    return M.outcome_rates(c.select(F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 7).alias("communities"), o.alias("outcome")), "communities", "outcome")


@query("""
with t as (select event_id, user_id, event_type as q, cast(value as bigint) as v from events), r as (select x.user_id, x.event_id, min(y.event_id) as later from t x join t y on x.user_id = y.user_id and x.q = y.q and y.event_id > x.event_id and x.v <> y.v group by 1, 2)
select user_id, event_id, later as superseded_by from r
""".replace("cast(value as bigint)", "cast(floor(value) as bigint)"))
def turn_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit("What is the latest value of "), "event_type", F.lit("?")).alias("q"), F.floor("value").cast("string").alias("a"))
    return M.supersede_turns(e, ["user_id"], "event_id", "q", "a")


@query("""
select n, cast(sum(hit) as bigint) as disputed from (select o_orderstatus as n, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 1 else 0 end as hit from orders) group by n
""")
def disputed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    o = table(spark, sf_dir, "orders").join(sides, F.col("o_orderkey") == F.col("k"), "left")
    return o.groupBy(F.col("o_orderstatus").alias("n")).agg(F.count("k").alias("disputed"))
