"""Views that put answers together: routes, gates, evidence blocks, recall, name-grounded ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmend.functions.similarity import ratio
from sparkmend.operators.retrieval import top_k

DECISION_RELATIONS = ("caused_by", "depends_on", "led_to", "related_to", "supersedes")


def refusals(best: DataFrame, query_id: str, score: str, least: float = 0.3) -> DataFrame:
    """query_id, best, refused: whether no hit of a query comes up to `least`; scores are one row a hit."""
    top = best.groupBy(query_id).agg(F.max(score).alias("best"))
    return top.select(query_id, "best", (F.coalesce("best", F.lit(0.0)) < least).alias("refused"))


def answer_route(structural: Column, unknown_years: Column, ambiguous: Column, disputed: Column, sufficient: Column, rewrites: Column, most_rewrites: int = 2) -> Column:
    """Where a question goes, the first that holds: structural answer, refusal for years that nothing speaks of, a question back, both sides, an answer, another wording, a refusal."""
    return (
        F.when(structural, "structural").when(unknown_years > 0, "refuse_year").when(ambiguous, "clarify").when(disputed, "dual").when(sufficient, "answer")
        .when(rewrites < most_rewrites, "rewrite").otherwise("refuse")
    )


def decision_chain(edges: DataFrame, relations: tuple[str, ...] = DECISION_RELATIONS) -> DataFrame:
    """node, direction, relation, others: what each decision links to and from by the relations named, ids in order."""
    kept = edges.where(F.col("relation").isin(*relations))
    ends = kept.select(F.col("src").alias("node"), F.lit("out").alias("direction"), "relation", F.col("dst").alias("other")).union(kept.select("dst", F.lit("in"), "relation", "src"))
    return ends.groupBy("node", "direction", "relation").agg(F.sort_array(F.collect_set("other")).alias("others"))


def episode_index(rows: DataFrame, episode: str, entity: str, tier: str) -> DataFrame:
    """tier, entity, episodes, entities: for each entity of a tier the episodes that have it and how many entities its tier has."""
    pairs = rows.select(F.col(tier).alias("tier"), F.col(entity).alias("entity"), F.col(episode).alias("episode")).distinct()
    counted = pairs.groupBy("tier", "entity").agg(F.count(F.lit(1)).alias("episodes"))
    return counted.join(counted.groupBy("tier").agg(F.count(F.lit(1)).alias("entities")), "tier")


def recalled(turns: DataFrame, hits: DataFrame, query_id: str, turn_id: str, score: str, confidence: str, active: str, least: float = 0.35, k: int = 3) -> DataFrame:
    """query_id, turn_id, score: the k best active turns a query by similarity times confidence, among those of similarity `least` and more."""
    found = hits.where(F.col(score) >= least).join(turns.where(F.col(active)).select(turn_id, confidence), turn_id)
    return top_k(found.select(query_id, turn_id, F.round(F.col(score) * F.col(confidence), 6).alias("score")), [query_id], "score", turn_id, k)


def evidence_block(claims: DataFrame, key: str, order: str, text: Column, disputed: Column) -> DataFrame:
    """key, block: the claims of a key as lines, disputed ones marked."""
    line = F.concat(F.lit("- "), text, F.when(disputed, " [DISPUTED]").otherwise(""))
    return claims.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def named_edges(nodes: DataFrame, edges: DataFrame, node_id: str, name: str, order: str) -> DataFrame:
    """src, dst, relation of edges(src_name, dst_name, relation): ends found by name, of equal names the node that comes last; edges without both ends go."""
    last = nodes.groupBy(name).agg(F.max_by(node_id, F.struct(order, node_id)).alias("id"))
    ends = [last.select(F.col(name).alias(f"{side}_name"), F.col("id").alias(side)) for side in ("src", "dst")]
    return edges.join(ends[0], "src_name").join(ends[1], "dst_name").select("src", "dst", "relation").distinct()


def unique_facts(rows: DataFrame, name: str, qualifiers: list[str]) -> DataFrame:
    """The rows and `qualifier`: the first column whose value makes the row the only one of its name with it; 'name' if the name alone does, null if none does."""
    from pyspark.sql import Window

    count = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*by))
    said = F.when(count(name) == 1, F.lit("name"))
    for q in qualifiers:
        said = said.when(F.col(q).isNotNull() & (count(name, q) == 1), F.lit(q))
    return rows.withColumn("qualifier", said)


def name_grounded(questions: DataFrame, records: DataFrame, question: str, name: str, least: float = 85.0, found: float = 0.5):
    """question id, record id, share and found: what share of a record name's words the question has, within `least` of 100. Pairs come in as rows (qid, rid)."""
    words = r"[a-z0-9]+"

    def share(batches):
        import re

        for pdf in batches:
            out = []
            for q, n in zip(pdf[question], pdf[name]):
                asked, named = (re.findall(words, (x or "").lower()) for x in (q, n))
                hits = sum(any(ratio(w, a) >= least for a in asked) for w in named)
                out.append(hits / len(named) if named else 0.0)
            pdf = pdf[["qid", "rid"]].copy()
            pdf["share"] = out
            pdf["found"] = [s >= found for s in out]
            yield pdf

    return questions.join(records, "block").select("qid", "rid", question, name).mapInPandas(share, "qid long, rid long, share double, found boolean")


def counted_states(rows: DataFrame, group: str, states: dict[str, Column]) -> DataFrame:
    """group and for each state how many rows are in it."""
    return rows.groupBy(group).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in states.items()))
