"""The operators' queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkmend.llm import licences
from sparkmend.llm.columns import read
from sparkmend.llm.decontam import decontamination
from sparkmend.llm.langid import fit, language_id
from sparkmend.llm.line_dedup import line_classes
from sparkmend.llm.lm_scoring import cross_entropy_difference
from sparkmend.llm.matroska import media_features
from sparkmend.llm.piece_sampling import sampled_digests
from sparkmend.llm.simhash import simhash_components
from sparkmend.llm.token_counts import token_counts
from sparkmend.llm.token_output import token_output

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return cross_entropy_difference(read(spark, sf_dir, "documents"), good)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(read(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id(docs, fit(docs))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licences.licence_paragraphs(docs, licences.fit(docs))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS10 = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op2_lm_scoring": r"""
with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents),
 c as (select word, count(*) as n from (select unnest(w) as word from t) group by 1),
 s as (select word, (n + 1) / ((select sum(n) + count(*) + 1 from c)) as share from c),
 tok as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from t),
 g as (select b.*, good.doc_id is not null as chosen from (select doc_id, coalesce(lag(word) over (partition by doc_id order by pos), '') as a, word as b from tok) b
   left join (select distinct doc_id from labels where quality = 1 and toxic = 0) good using (doc_id)),
 cb as (select a, b, count(*) as n, count(case when chosen then 1 end) as m from g group by 1, 2),
 cf as (select a, count(*) as n, count(case when chosen then 1 end) as m from g group by 1),
 l as (select doc_id, avg(-ln((cb.m + 64 * share) / (cf.m + 64))) as lt, avg(-ln((cb.n + 64 * share) / (cf.n + 64))) as lb from g join cb using (a, b) join cf using (a) join s on s.word = g.b group by 1)
select doc_id, len(w) as n_tokens, coalesce(round(lt, 6), 0.0) as target_loss, coalesce(round(lb, 6), 0.0) as background_loss, coalesce(round(round(lt, 6) - round(lb, 6), 6), 0.0) as score from t left join l using (doc_id)
""",
    "op10_decontamination": f"""
with d as (select doc_id, {WORDS10} as w from documents), b as (select item_id, {WORDS10} as w from benchmark where item_id is not null),
 bw as (select item_id, least(10, len(w)) as n, array_to_string(w[i : i + 9], ' ') as win from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
 dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
 h as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
 hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
 hi as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
