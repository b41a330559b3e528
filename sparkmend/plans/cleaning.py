"""Queries of the cleaning operators: quality, votes, dependencies, formats, vocabulary, truth discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.functions import text as X
from sparkmend.operators import quality, vote
from sparkmend.operators.shared import written
from sparkmend.plans.registry import query, table

EMPTY = "('', 'n/a', 'na', 'unknown', '?', 'none', 'null', '-')"


def _column_sql(tbl: str, col: str, pattern: str | None) -> str:
    text = f"cast({col} as varchar)"
    filled = f"({text} is not null and lower(trim({text})) not in {EMPTY})"
    valid = f"{filled} and regexp_matches({text}, '{pattern}')" if pattern else filled
    return f"select '{tbl}' as tbl, '{col}' as col, count(*) as cells, count(case when {filled} then 1 end) as filled, count(case when {valid} then 1 end) as valid from {tbl}"


REQUIRED = {
    "customer": {"c_name": "^Customer#[0-9]{9}$", "c_mktsegment": None, "c_nationkey": "^[0-9]+$"},
    "orders": {"o_orderpriority": "^[1-5]-", "o_orderstatus": "^[FOP]$", "o_orderdate": None},
    "documents": {"lang": "^[a-z]{2}$", "source": None, "text": None},
}


@query(" union all ".join(_column_sql(t, c, p) for t, cols in REQUIRED.items() for c, p in cols.items()))
def dq_completeness_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.union_all([quality.column_quality(table(spark, sf_dir, t), t, rules) for t, rules in REQUIRED.items()])


REFS = (("orders_customer", "orders", "o_custkey", "customer", "c_custkey"), ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"), ("labels_document", "labels", "doc_id", "documents", "doc_id"))


@query(" union all ".join(f"select '{n}' as ref, count({c}) as cells, count(case when {c} in (select {k} from {o}) then 1 end) as good from {t}" for n, t, c, o, k in REFS))
def dq_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.integrity([(n, table(spark, sf_dir, t), c, table(spark, sf_dir, o), k) for n, t, c, o, k in REFS])


@query("""
select cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as extra from (
  select lower(substr(c_mktsegment, 1, 1)), cast(floor(c_acctbal) as bigint), count(*) as n from customer group by 1, 2)
""")
def dq_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return quality.duplicates(c, [F.lower(F.substring("c_mktsegment", 1, 1)), F.floor("c_acctbal").cast("long")])


@query("""
select 'ship_before_order' as rule, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate
union all select 'discount_range', count(*) from lineitem where l_discount < 0 or l_discount > 0.1
union all select 'filled_without_line', count(*) from orders where o_orderstatus = 'F' and not exists (select 1 from lineitem where l_orderkey = o_orderkey)
union all select 'label_without_document', count(*) from labels where doc_id not in (select doc_id from documents)
""")
def dq_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, docs = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "documents"))
    return quality.violations({
        "ship_before_order": lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate"),
        "discount_range": lines.where("l_discount < 0 or l_discount > 0.1"),
        "filled_without_line": orders.where("o_orderstatus = 'F'").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "label_without_document": table(spark, sf_dir, "labels").join(docs, "doc_id", "left_anti"),
    })


@query("""
with c as (select count(*) as n, count(case when c_name is not null then 1 end) as f from customer),
 r as (select count(*) as n, count(case when o_custkey in (select c_custkey from customer) then 1 end) as g from orders),
 u as (select sum(n) as n, sum(n - 1) as e from (select count(*) as n from customer group by c_name))
select round(f / c.n, 4) as completeness, round(g / r.n, 4) as integrity, cast(round(1 - e / u.n, 4) as double) as uniqueness,
 round((round(f / c.n, 4) + round(g / r.n, 4) + cast(round(1 - e / u.n, 4) as double)) / 3, 4) as score from c, r, u
""")
def dq_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    done = quality.column_quality(c, "customer", {"c_name": None}).select(F.round(F.col("filled") / F.col("cells"), 4).alias("completeness"))
    refs = quality.integrity([("r", o, "o_custkey", c, "c_custkey")]).select(F.round(F.col("good") / F.col("cells"), 4).alias("integrity"))
    extra = quality.duplicates(c, [F.col("c_name")]).select(F.round(1 - F.col("extra") / F.col("rows"), 4).alias("uniqueness"))
    one = done.join(refs).join(extra)  # one row each
    return one.withColumn("score", F.round((F.col("completeness") + F.col("integrity") + F.col("uniqueness")) / 3, 4))


FD_COLUMNS = ("p_brand", "p_type", "p_size", "p_name")


@query(" union all ".join(f"""
select '{a}' as lhs, '{b}' as rhs, round(sum(case when size >= 2 then most end) / sum(case when size >= 2 then size end), 6) as confidence from (
 select a, max(n) as most, sum(n) as size from (select {a} as a, {b} as b, count(*) as n from part group by 1, 2) group by a)
having sum(case when size >= 2 then size end) >= 0.3 * sum(size) and count(*) >= 2""" for a in FD_COLUMNS for b in FD_COLUMNS if a != b))
def fd_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(a, b) for a in FD_COLUMNS for b in FD_COLUMNS if a != b]
    return vote.fd_confidence(table(spark, sf_dir, "part"), pairs).withColumn("confidence", F.round("confidence", 6))


@query("""
with n as (select l_suppkey, l_returnflag, count(*) as n, min(l_orderkey * 8 + l_linenumber) as pos from lineitem group by 1, 2),
 b as (select l_suppkey, l_returnflag, n, sum(n) over (partition by l_suppkey) as total, row_number() over (partition by l_suppkey order by n desc, pos) as r from n)
select l_suppkey, l_returnflag, n as votes, cast(total as bigint) as total, round(n / total, 6) as share from b where r = 1
""")
def majority_vote_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return vote.majority(lines, ["l_suppkey"], "l_returnflag", "pos").select("l_suppkey", "l_returnflag", "votes", "total", F.round("share", 6).alias("share"))


@query("""
with n as (select o_custkey, o_orderstatus, count(*) as n, min(o_orderkey) as pos from orders group by 1, 2),
 b as (select o_custkey, o_orderstatus as v, n / sum(n) over (partition by o_custkey) as share, row_number() over (partition by o_custkey order by n desc, pos) as r from n)
select o_orderkey, case when share >= 0.5 then v else o_orderstatus end as repaired, (case when share >= 0.5 then v else o_orderstatus end) <> o_orderstatus as changed
from orders join b using (o_custkey) where r = 1
""")
def fd_majority_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.fd_repair(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", 0.5).select("o_orderkey", "repaired", "changed")


@query(f"""
with d as (select c_custkey, case when c_custkey % 7 = 0 then ' N/A ' when c_custkey % 11 = 0 then '?' else c_mktsegment end as seg from customer)
select c_custkey, case when lower(trim(seg)) in {EMPTY} then null else seg end as cleaned, lower(trim(seg)) in {EMPTY} as logged from d
""")
def placeholder_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    seg = F.when(k % 7 == 0, " N/A ").when(k % 11 == 0, "?").otherwise(F.col("c_mktsegment"))
    d = table(spark, sf_dir, "customer").select("c_custkey", seg.alias("seg"))
    return d.select("c_custkey", X.blank_placeholder(F.col("seg")).alias("cleaned"), X.is_placeholder(F.col("seg")).alias("logged"))


SHAPE_SQL = "replace(regexp_replace(regexp_replace(regexp_replace({c}, '[0-9]+', '9', 'g'), '[a-z]+', chr(1), 'g'), '[A-Z]+', 'A', 'g'), chr(1), 'a')"


@query(" union all ".join(f"select '{c}' as attr, {SHAPE_SQL.format(c=c)} as shape, count(*) as n from {t} where {c} is not null group by 2" for t, c in (("part", "p_name"), ("part", "p_brand"), ("customer", "c_name"), ("documents", "source"))))
def shape_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [vote.profile_shapes(table(spark, sf_dir, t), cols, X.shape) for t, cols in (("part", ["p_name", "p_brand"]), ("customer", ["c_name"]), ("documents", ["source"]))]
    return vote.union_all(frames)


@query("""
with d as (select o_orderkey, case o_orderkey % 4 when 0 then printf('%d.0', o_orderkey) when 1 then 'O''''Brien' when 2 then format('{:,}', 1000 + o_orderkey) else o_orderpriority end as cell from orders)
select o_orderkey, cell, case when contains(cell, '''''') then replace(cell, '''''', '''') when regexp_full_match(cell, '[0-9]{1,3}(,[0-9]{3})+') then replace(cell, ',', '')
 when regexp_full_match(cell, '-?[0-9]+\\.0') then regexp_replace(cell, '\\.0$', '') else cell end as tidy from d
""")
def cell_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cell = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 1, "O''Brien").when(k % 4 == 2, F.format_number(k + 1000, 0)).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cell.alias("cell")).withColumn("tidy", X.tidy_cell(F.col("cell")))


@query("""
with d as (select o_orderkey, case o_orderkey % 4 when 0 then '$' || (1000 + o_orderkey) when 1 then format('{:,}', 1000 + o_orderkey) || ' USD' when 2 then 'Order  ' || o_orderkey else (o_orderkey % 100) || '.50 kg' end as v from orders)
select o_orderkey, case o_orderkey % 4 when 0 then '$' || (1000 + o_orderkey) when 1 then '$' || (1000 + o_orderkey) when 2 then 'order ' || o_orderkey else (o_orderkey % 100) || '.5' end as canonical from d
""")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("$"), (k + 1000).cast("string"))).when(k % 4 == 1, F.concat(F.format_number(k + 1000, 0), F.lit(" USD"))).when(k % 4 == 2, F.concat(F.lit("Order  "), k.cast("string"))).otherwise(F.concat((k % 100).cast("string"), F.lit(".50 kg")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.canonical_value(v).alias("canonical"))


@query("""
select c_custkey, case when c_custkey % 3 = 0 then 'robert smith' || c_custkey when c_custkey % 3 = 1 then 'mary jones' || c_custkey else 'customer#' || lpad(cast(c_custkey as varchar), 9, '0') end as name from customer
""")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" Smith"), k, F.lit(",  Bob"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Mary   JONES"), k)).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.person_name(raw).alias("name"))


TRUTH_CELLS = "select l_partkey as key, l_suppkey as src, 'flag' as attr, l_returnflag as val, l_orderkey * 8 + l_linenumber as pos from lineitem"


@query(f"""
with c as ({TRUTH_CELLS}), v as (select key, attr, val, round(count(*) * 0.8, 9) as w, min(pos) as pos from c group by all),
 t as (select key, attr, val, row_number() over (partition by key, attr order by w desc, pos) as r from v)
select src, round((sum(case when c.val = t.val then 1 else 0 end) + 1) / (count(*) + 2), 6) as weight from c join t on c.key = t.key and c.attr = t.attr and r = 1 group by src
""")
def truth_discovery_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("src"), F.lit("flag").alias("attr"), F.col("l_returnflag").alias("val"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return vote.source_weights(cells, vote.truth_round(cells, None)).select("src", F.round("w", 6).alias("weight"))


def truth_sql(rounds: int) -> str:
    """Rounds of truth discovery, written out one behind the other."""
    parts = [f"c as ({TRUTH_CELLS})", "w0 as (select distinct src, cast(0.8 as double) as w from c)"]
    for r in range(1, rounds + 1):
        parts += [
            f"v{r} as (select key, attr, val, round(sum(w), 9) as w, min(pos) as pos from c join w{r - 1} using (src) group by key, attr, val)",
            f"t{r} as (select key, attr, val, w from (select *, row_number() over (partition by key, attr order by w desc, pos) as n from v{r}) where n = 1)",
            f"w{r} as (select src, cast(sum(case when c.val = t{r}.val then 1 else 0 end) + 1 as double) / (count(*) + 2) as w from c join t{r} on c.key = t{r}.key and c.attr = t{r}.attr group by src)",
        ]
    return f"with {', '.join(parts)} select key, attr, val, w as weight from t{rounds}"


@query(truth_sql(3))
def truth_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("src"), F.lit("flag").alias("attr"), F.col("l_returnflag").alias("val"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    truth, _ = vote.truth_discovery(cells, 3)
    return truth


@query("""
with n as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2),
 g as (select l_suppkey, sum(n) as size, max(n) as top, arg_max(l_returnflag, n) as best, count(*) as kinds from n group by 1),
 t as (select l_suppkey, count(*) as tops from n join g using (l_suppkey) where n.n = g.top group by 1)
select l_orderkey * 8 + l_linenumber as row_id, case when g.size >= 3 and g.top >= 2 and g.top * 2 > g.size and g.top >= 0.6 * g.size and t.tops = 1 and n.n <= 2 then g.best else l_returnflag end as repaired
from lineitem join n using (l_suppkey, l_returnflag) join g using (l_suppkey) join t using (l_suppkey)
""")
def fd_repair_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_suppkey", "l_returnflag")
    out = vote.repair_round(lines.withColumn("l_suppkey", F.col("l_suppkey").cast("string")), [("l_suppkey", "l_returnflag")], "row_id")
    return out.select("row_id", F.col("l_returnflag").alias("repaired"))


@query("""
with d as (select p_partkey, p_brand, case when p_partkey % 17 = 0 then 'XX' else p_brand end as dirty from part)
select count(case when p_partkey % 17 = 0 then 1 end) as changed, count(case when p_partkey % 34 = 0 then 1 end) as "right", count(case when p_partkey % 17 = 0 then 1 end) as wrong,
 round(count(case when p_partkey % 34 = 0 then 1 end) / count(case when p_partkey % 17 = 0 then 1 end), 3) as precision, round(count(case when p_partkey % 34 = 0 then 1 end) / count(case when p_partkey % 17 = 0 then 1 end), 3) as recall,
 round(count(case when p_partkey % 34 = 0 then 1 end) / count(case when p_partkey % 17 = 0 then 1 end), 3) as f1 from d
""")
def repair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    dirty = part.select("p_partkey", F.when(k % 17 == 0, "XX").otherwise(F.col("p_brand")).alias("p_brand"))
    fixed = part.select("p_partkey", F.when((k % 17 == 0) & (k % 34 != 0), "YY").otherwise(F.col("p_brand")).alias("p_brand"))
    return quality.repair_score(dirty, fixed, part, "p_partkey", ["p_brand"])


@query("""
with f as (select distinct c_nationkey as a, c_mktsegment as b from customer where c_acctbal > 0), t as (select distinct c_nationkey as a, c_mktsegment as b from customer where c_acctbal < 5000),
 n as (select (select count(*) from f) as f, (select count(*) from t) as t, (select count(*) from (select * from f intersect select * from t)) as b)
select b as hits, round(b / f, 6) as precision, round(b / t, 6) as recall, round(2 * (b / f) * (b / t) / (b / f + b / t), 6) as f1 from n
""")
def set_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"), "c_acctbal")
    return quality.precision_recall(c.where("c_acctbal > 0").select("a", "b"), c.where("c_acctbal < 5000").select("a", "b"))


@query("""
with o as (select o_orderkey, o_custkey, case when o_orderkey % 13 = 0 then -1 else o_custkey end as fk from orders)
select o_orderkey, fk as before, case when fk in (select c_custkey from customer) then fk end as kept, fk not in (select c_custkey from customer) as flagged from o
""")
def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("before"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return o.join(keys, F.col("before") == F.col("k"), "left").select("o_orderkey", "before", F.col("k").alias("kept"), F.col("k").isNull().alias("flagged"))


@query("""
with e as (select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on o_orderkey = l_orderkey),
 b as (select dst as src, src as dst from e where (src + dst) % 3 <> 0), r as (select count(*) as n, count(case when (dst, src) in (select (src, dst) from b) then 1 end) as back from e)
select src, dst, round(back / n, 6) as confidence from (select dst as src, src as dst from e except select src, dst from b), r
""")
def inverse_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    links = written(o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct(), "links")
    inverse = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    there = inverse.where("(src + dst) % 3 <> 0")
    missing = inverse.join(there, ["src", "dst"], "left_anti")
    ratio = links.agg(F.count(F.lit(1)).alias("n")).join(there.agg(F.count(F.lit(1)).alias("back"))).select(F.round(F.col("back") / F.col("n"), 6).alias("confidence"))
    return missing.join(F.broadcast(ratio))  # one row


@query("""
select o_orderkey, o_custkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1
""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "o_custkey", "o_totalprice")
