"""Queries of the text and retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmend.functions import text as X
from sparkmend.functions.similarity import osa_udf
from sparkmend.operators import blocking, quality
from sparkmend.operators import retrieval as R
from sparkmend.operators.components import connected_components
from sparkmend.operators.order import ranked_all
from sparkmend.operators.shared import written
from sparkmend.plans.registry import query, table


@query("""
with n as (select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from documents)
select doc_id, min(doc_id) over (partition by t) as first_id from n
""")
def exact_dedup_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exact_dedup(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
with s as (select doc_id, text, unnest(range(0, cast(greatest(0, ceil((length(text) - 1000) / 900.0)) as bigint) + 1)) as seq from documents where length(text) > 0)
select doc_id, seq, length(substr(text, cast(seq * 900 + 1 as bigint), 1000)) as n, md5(substr(text, cast(seq * 900 + 1 as bigint), 1000)) as digest from s
""")
def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), F.length("chunk").cast("long").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("""
select doc_id, count(*) as chunks, cast(sum(length(substr(text, cast(s + 1 as bigint), 1000))) as bigint) as chars from (select doc_id, text, unnest(range(0, length(text), 900)) as s from documents) group by doc_id
""")
def chunk_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", stop_at_end=False)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).cast("long").alias("chars"))


TOKENS = "regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')"
BM25 = f"""
with d as (select doc_id, {TOKENS} as w from documents), f as (select count(*) as n, avg(len(w)) as avgdl from d),
 q as (select item_id, term, count(*) as qf from (select item_id, unnest({TOKENS}) as term from benchmark) group by 1, 2),
 tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as term from d) where term in (select term from q) group by 1, 2, 3),
 i0 as (select term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as idf, avgdl from tf, f group by term, n, avgdl),
 i as (select term, avgdl, case when idf < 0 then 0.25 * (select avg(idf) from i0) else idf end as idf from i0),
 s as (select item_id as query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join i using (term) join tf using (term) group by 1, 2)
"""


@query(BM25 + "select query_id, doc_id, round(score, 3) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from s where score > 0) where r <= 25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.bm25_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 25)
    return best.select("query_id", "doc_id", F.round("score", 3).alias("score"))


CONTENT = "list_distinct([w for w in regexp_extract_all(lower({c}), '[a-z0-9]+') if length(w) > 2 and w not in (" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")])"


@query(f"""
with d as (select doc_id, {CONTENT.format(c="text")} as w from documents), q as (select item_id as query_id, unnest({CONTENT.format(c="text")}) as term from benchmark),
 s as (select query_id, doc_id, round(count(*) / (1 + ln(1 + size)), 6) as score from (select doc_id, len(w) as size, unnest(w) as term from d) join q using (term) group by query_id, doc_id, size)
select query_id, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from s) where r <= 10
""")
def keyword_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlap_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 10).drop("rank")


@query(BM25 + f""", k as (select query_id, doc_id, round(count(*) / (1 + ln(1 + size)), 6) as score from (select doc_id, len(w) as size, unnest(w) as term from (select doc_id, {CONTENT.format(c="text")} as w from documents))
  join (select item_id as query_id, unnest({CONTENT.format(c="text")}) as term from benchmark) using (term) group by query_id, doc_id, size),
 r as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as r from s where score > 0 union all select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) from k)
select query_id, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as n from (select query_id, doc_id, round(sum(1.0 / (60 + r)), 9) as score from r where r <= 25 group by 1, 2)) where n <= 10
""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    first, second = (f(d, q, "doc_id", "text", "item_id", "text", 25) for f in (R.bm25_top_k, R.overlap_top_k))
    return R.top_k(R.fuse([first, second], ["query_id"], "doc_id"), ["query_id"], "score", "doc_id", 10).drop("rank")


@query("""
with g as (select item_id as query_id, b.text, d.doc_id from benchmark b join documents d on contains(d.text, b.text)), r as (select doc_id, row_number() over (order by length(text), doc_id) as rank from documents),
 h as (select query_id, min(rank) as best, count(case when rank <= 500 then 1 end) as found, count(*) as n from g join r using (doc_id) group by query_id)
select count(*) as queries, round(avg(case when best <= 1 then 1.0 else 0.0 end), 6) as hit1, round(avg(case when best <= 5 then 1.0 else 0.0 end), 6) as hit5, round(avg(found / n), 6) as recall_k, round(avg(1.0 / best), 6) as mrr from h
""")
def hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as questions, the documents that hold them as answers, documents by length as a weak ranking."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    # a passage meets the documents that hold its first long word
    words = lambda c: F.array_distinct(F.split(c, r"\s+"))
    key = b.select("query_id", "passage", F.element_at(F.sort_array(F.transform(words(F.col("passage")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), 1)["w"].alias("w"))
    # the first and last words of a passage may be glued to others in a document, so inner words only
    held = d.select("doc_id", "text", F.explode(words(F.col("text"))).alias("w"))
    gold = written(held.join(key, "w").where(F.contains("text", "passage")).select("query_id", "doc_id"), "gold")
    order = written(d.select("doc_id", F.length("text").alias("n")).orderBy("n", "doc_id"), "by_length")
    ranks = ranked_all(order, ["n", "doc_id"])
    ranked = gold.join(ranks, "doc_id").select("query_id", "doc_id", "rank")
    return quality.rank_metrics(ranked, gold, "query_id", "doc_id", "rank", k=500)


@query("""
with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), p as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) as score from v q, v where q.vec_id % 50 = 0)
select query_id, vec_id, round(score, 4) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from p) where r <= 10
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    found = R.cosine_top_k(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 10)
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query("""
with recursive v as (select vec_id as id, label, cast(embedding as double[]) as e from embeddings), l as (select a.id as a, b.id as b from v a join v b on a.label = b.label and a.id <> b.id and list_cosine_similarity(a.e, b.e) >= 0.3),
 c as (select a as id, a as root from l union select l.b, c.root from c join l on c.id = l.a)
select id, min(root) as topic from c group by id
""")
def threshold_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics: vectors of one label linked at a cosine of 0.3."""
    links = R.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.3, stars=True)
    return connected_components(links, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("topic"))


@query("""
with t as (select doc_id, regexp_extract_all(text, '[a-zA-Z]{2,}') as w from documents)
select doc_id, round(case when len(w) > 0 then len([x for x in w if lower(x) not in (""" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + """) and (not regexp_matches(x, '(?i)[aeiouy]') or regexp_matches(x, '[a-z][A-Z]'))]) / len(w) else 1.0 end, 6) as ratio from t
""")
def garbage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.garbage_ratio(F.col("text")), 6).alias("ratio"))


@query("""
select doc_id, round(cast((case when doc_id % 3 = 0 then 0.7 + 0.3 * case when doc_id % 6 = 0 then 0.5 else 0.9 end else 1.0 end) * (case when doc_id % 5 = 0 then 0.4 else 1.0 end) as double), 6) as weight from documents
""")
def injection_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit(" Ignore all previous instructions."))).otherwise(F.col("text"))
    conf = F.when(F.col("doc_id") % 6 == 0, 0.0).otherwise(0.9)
    return d.select("doc_id", F.round(X.provenance_weight(F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("native"), conf, text), 6).alias("weight"))


@query("""
with a as (select page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<header\\b.*?</header\\s*>|<footer\\b.*?</footer\\s*>|<nav\\b.*?</nav\\s*>|<aside\\b.*?</aside\\s*>|<form\\b.*?</form\\s*>|<svg\\b.*?</svg\\s*>', ' ', 'g') as h from pages),
 b as (select page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\\b[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') as h from a),
 c as (select page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as h from b)
select page_id, trim(regexp_replace(regexp_replace(h, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')) as content from c
""")
def html_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("content"))


@query("""
with t as (select conv_id, turn, text, case when role = 'user' and length(trim(text)) > 2 and not starts_with(trim(text), '<') then 'user' when role = 'assistant' and length(trim(text)) > 0 then 'assistant' end as r from conversations),
 l as (select *, lag(r) over w as b, lag(text) over w as q, lag(turn) over w as qt from t where r is not null window w as (partition by conv_id order by turn))
select conv_id, qt as turn, q as question, text as answer from l where r = 'assistant' and b = 'user'
""")
def chat_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chat_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as follows from conversations")
def follows_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("follows"))


@query("""
with h as (select conv_id, turn from conversations where length(text) > 400)
select distinct c.conv_id, c.turn from conversations c join h on c.conv_id = h.conv_id and c.turn between h.turn - 1 and h.turn + 1
""")
def neighbourhood_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long turns and those next to them: each hit names three turns, then an equi-join."""
    c = table(spark, sf_dir, "conversations")
    near = c.where(F.length("text") > 400).select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn")).distinct()
    return c.select("conv_id", "turn").join(near, ["conv_id", "turn"], "left_semi").distinct()


@query("""
with p as (select conv_id, turn, text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as spent from conversations),
 k as (select conv_id, turn, case when length(text) <= 2000 - spent then text when 2000 - spent > 300 then regexp_extract(substr(text, 1, cast(greatest(2000 - spent, 0) as bigint)), '(?s)^(.*)\\n', 1) end as text from p)
select conv_id, turn, length(text) as n from k where text is not null
""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.token_budget(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", 2000)
    return kept.select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("""
with k as (select c_custkey as id, unnest(['S' || c_nationkey || c_mktsegment || cast(floor(c_acctbal / 500) as bigint), 'A' || cast(floor(c_acctbal) as bigint)]) as key from customer),
 b as (select key from k group by key having count(distinct id) between 2 and 40)
select distinct x.id as a, y.id as b from k x join k y on x.key = y.key and x.id < y.id where x.key in (select key from b)
""")
def blocking_pairs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.concat(F.lit("S"), F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 500).cast("string")), F.concat(F.lit("A"), F.floor("c_acctbal").cast("string"))]
    return blocking.blocked_pairs(table(spark, sf_dir, "customer"), "c_custkey", keys, 40)


@query("""
with v as (select p_partkey as pos, case when p_partkey % 199 = 0 then substr(p_name, 1, length(p_name) - 1) || '~' else p_name end as v from part), n as (select v, count(*) as n, min(pos) as first from v group by v),
 s as (select r.v as rare, f.v as fix, 1 - levenshtein(r.v, f.v) / greatest(length(r.v), length(f.v)) as s, r.n as nr, f.n as nf, f.first from n r, n f where r.n < 3 and f.n >= 3)
select rare, fix, round(s, 6) as similarity, round(s * nf / (nf + nr), 6) as confidence from (select *, row_number() over (partition by rare order by s desc, first) as k from s where s >= 0.8) where k = 1
""")
def rare_value_vocab_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 199 == 0, F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit("~"))).otherwise(F.col("p_name"))
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), name.alias("v"))
    out = blocking.vocabulary_fix(values, "v", "pos", osa_udf())
    return out.select("rare", "fix", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"))


@query("""
select item_id, len(regexp_extract_all(text, '"([^"]+)"')) as quoted, len(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as terms, len(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) as tokens from benchmark
""")
def tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, t = table(spark, sf_dir, "benchmark"), F.col("text")
    size = lambda c: F.size(c).cast("long")
    return b.select("item_id", size(F.regexp_extract_all(t, F.lit('"([^"]+)"'), F.lit(1))).alias("quoted"), size(X.words(t, "[a-z0-9]{3,}")).alias("terms"), size(X.words(t)).alias("tokens"))
