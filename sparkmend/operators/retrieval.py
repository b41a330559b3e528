"""Chunking, keyword, vector and entity ranking, and their fusion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkmend.functions.text import content_words, words
from sparkmend.operators.shared import written


def chunks(docs: DataFrame, doc_id: str, text: str, size: int = 1000, overlap: int = 100, stop_at_end: bool = True) -> DataFrame:
    """doc_id, seq, chunk: windows of `size` characters that overlap; with stop_at_end none begins behind the one that reaches the end."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step) * step).cast("int") if stop_at_end else F.greatest(F.lit(0), n - 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"), F.posexplode(starts).alias("seq", "__s"))
    return out.select("doc_id", "seq", F.substr(F.col("__t"), F.col("__s") + 1, F.lit(size)).alias("chunk"))


def exact_dedup(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, first_id: documents by the SHA-1 of their text, lower case and blanks squeezed."""
    norm = F.sha1(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "h").select("doc_id", "first_id")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, question: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """query_id, doc_id, score > 0. Negative inverse frequencies become `floor` times their mean.

    Only terms that some query asks for are counted in documents; lengths and the number of documents are over all.
    """
    tokens = written(docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")), "tokens")  # read for lengths and for terms
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(words(F.col(question))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    facts = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl"))
    tf = tokens.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = written(tf, "term_frequencies")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(facts))  # one row of facts
    idf = written(df.select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    mean = idf.agg(F.avg("idf").alias("mean"))
    idf = idf.join(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("idf") < 0, floor * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = asked.join(idf, "term").join(tf, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.where("score > 0")


def overlap_score(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, question: str) -> DataFrame:
    """query_id, doc_id, score: shared content words over 1 + ln(1 + words of the document)."""
    held = docs.select(F.col(doc_id).alias("doc_id"), F.array_distinct(content_words(F.col(text))).alias("w"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(content_words(F.col(question)))).alias("term"))
    terms = held.select("doc_id", F.size("w").alias("size"), F.explode("w").alias("term"))
    return terms.join(asked, "term").groupBy("query_id", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).select("query_id", "doc_id", F.round(F.col("n") / (1 + F.log(1 + F.col("size"))), 6).alias("score"))


def term_top_k(rows: DataFrame, asked: DataFrame, k: int, value: Callable[[np.ndarray, int], np.ndarray], block: int = 2048) -> DataFrame:
    """query_id, doc_id, score > 0: the k best of rows(doc_id, w) for each query of asked(query_id, term, weight); score is the sum of value(counts, length) * weight over the terms.

    Queries go out in blocks of bounded size; each batch of rows is scored against a block's postings at once and keeps k a query,
    so no table of (query, row) pairs exists and a frequent term is no join key. The batches' best are then ranked by query.
    """
    spark = rows.sparkSession
    kinds = rows.schema["doc_id"].dataType, asked.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", kinds[1]), T.StructField("doc_id", kinds[0]), T.StructField("score", T.DoubleType())])
    best: list[DataFrame] = []

    def against(some: list[tuple[object, str, float]]) -> None:
        number: dict = {}
        postings: dict[str, tuple[list[int], list[float]]] = {}
        for q, term, weight in some:
            at = postings.setdefault(term, ([], []))
            at[0].append(number.setdefault(q, len(number)))
            at[1].append(weight)
        packed = {t: (np.array(a, np.int64), np.array(b)) for t, (a, b) in postings.items()}
        bound = spark.sparkContext.broadcast((list(number), packed))

        def run(batches):
            names, postings = bound.value
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    ids = part.column(0)
                    scores = np.zeros((part.num_rows, len(names)))
                    for i, words_ in enumerate(part.column(1).to_pylist()):
                        counts = Counter(w for w in words_ or () if w in postings)
                        if counts:
                            values = value(np.fromiter(counts.values(), float, len(counts)), len(words_))
                            found = [postings[w] for w in counts]
                            sizes = [len(f[0]) for f in found]
                            weights = np.concatenate([f[1] for f in found]) * np.repeat(values, sizes)
                            scores[i] = np.bincount(np.concatenate([f[0] for f in found]), weights, len(names))
                    scores = scores.round(6)
                    # of equal scores the least id
                    by_id = np.argsort(np.array(ids.to_pylist()), kind="stable")
                    order = by_id[np.argsort(-scores[by_id], axis=0, kind="stable")[:k]]
                    picked = np.take_along_axis(scores, order, 0)
                    q = np.broadcast_to(np.arange(len(names)), order.shape)
                    good = picked > 0
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in q[good].tolist()], to_arrow_type(kinds[1])), ids.take(pa.array(order[good])), pa.array(picked[good])], names=["query_id", "doc_id", "score"])

        best.append(rows.select("doc_id", "w").mapInArrow(run, schema))

    some, last, n = [], None, 0
    for q, term, weight in asked.select("query_id", "term", "weight").orderBy("query_id", "term").toLocalIterator():
        if q != last:
            if n == block:
                against(some)
                some, n = [], 0
            last, n = q, n + 1
        some.append((q, term, weight))
    if some:
        against(some)
    return top_k(reduce(DataFrame.unionByName, best) if best else spark.createDataFrame([], schema), ["query_id"], "score", "doc_id", k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, question: str, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """query_id, doc_id, score, rank: the k best by BM25, as bm25 scores them."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(words(F.col(question))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    n, avgdl = tokens.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("w")), F.lit(1.0))).first()
    df = tokens.select(F.explode(F.array_distinct("w")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = written(df.select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0
    weights = asked.join(idf, "term").select("query_id", "term", (F.col("qf") * F.when(F.col("idf") < 0, floor * mean).otherwise(F.col("idf"))).alias("weight"))
    return term_top_k(tokens, weights, k, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))


def overlap_top_k(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, question: str, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the k best by overlap_score."""
    held = docs.select(F.col(doc_id).alias("doc_id"), F.array_distinct(content_words(F.col(text))).alias("w"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(content_words(F.col(question)))).alias("term"), F.lit(1.0).alias("weight"))
    return term_top_k(held, asked, k, lambda tf, size: np.full(len(tf), 1 / (1 + np.log(1 + size))))


def top_k(scored: DataFrame, keys: list[str], score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best of each key with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def fuse(rankings: list[DataFrame], keys: list[str], item: str, rank: str = "rank", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank), rank from 1."""
    frames = [r.select(*keys, item, rank) for r in rankings]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return every.groupBy(*keys, item).agg(F.round(F.sum(1.0 / (constant + F.col(rank))), 9).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, vec_id: str, embedding: str, query_id: str, query_embedding: str, k: int = 10, block: int = 2048) -> DataFrame:
    """query_id, vec_id, score: the k most similar vectors of every query, exactly.

    Queries are packed into blocks of bounded size and each block meets every vector batch in a matrix product that keeps k a query,
    so no table of all pairs exists; the batches' best are then ranked by query.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    best = None
    rows = queries.select(F.col(query_id).cast("long"), F.col(query_embedding)).where(F.col(query_embedding).isNotNull())
    packed: list[tuple[int, list[float]]] = []

    def against(some: list[tuple[int, list[float]]]) -> DataFrame:
        ids = np.array([i for i, _ in some], np.int64)
        bound = spark.sparkContext.broadcast((ids, unit(np.array([v for _, v in some], float))))

        def run(batches):
            names, q = bound.value
            for pdf in batches:
                pdf = pdf[pdf["v"].notna()]
                if len(pdf):
                    s = (q @ unit(np.stack(pdf["v"].to_numpy()).astype(float)).T).round(6)
                    own = pdf["id"].to_numpy()
                    order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), "vec_id": own[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

        return vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).mapInPandas(run, schema)

    for row in rows.toLocalIterator():
        packed.append((row[0], row[1]))
        if len(packed) == block:
            best = against(packed) if best is None else best.union(against(packed))
            packed = []
    if packed or best is None:
        best = against(packed) if best is None and packed else best.union(against(packed)) if packed else spark.createDataFrame([], schema)
    return top_k(best, ["query_id"], "score", "vec_id", k)


def similar_pairs(vectors: DataFrame, item: str, embedding: str, group: str, least: float, stars: bool = False, block: int = 1024) -> DataFrame:
    """a, b (a < b): vectors of one group whose cosine is `least` or more; with stars only as many of these links as keep their classes together.

    A group is cut into blocks of some `block` vectors by a hash, and each two blocks meet once in a matrix product, so a large group is many tasks and
    no table of all its pairs exists. Null vectors and groups have no links, and neither have vectors of length zero.
    """
    rows = vectors.select(F.col(item).cast("long").alias("id"), F.col(embedding).alias("v"), F.col(group).alias("g")).where(F.col("v").isNotNull())
    blocks = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    packed = rows.join(blocks, "g").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks"))).groupBy("g", "k").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))
    packed = written(packed, "vector_blocks")
    two = packed.alias("x").join(packed.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.k") <= F.col("y.k"))).select("x.ids", "x.vs", F.col("y.ids").alias("ids2"), F.col("y.vs").alias("vs2"), (F.col("x.k") == F.col("y.k")).alias("same"))

    def links(near: np.ndarray) -> np.ndarray:
        """Pairs of positions: all that are near, or each position with the least of its class."""
        if not stars:
            return np.argwhere(np.triu(near, 1))
        label = np.arange(len(near))
        while True:
            new = np.where(near, label, len(near)).min(axis=1)
            if (new == label).all():
                return np.stack([label, np.arange(len(near))], axis=1)[label != np.arange(len(near))]
            label = new

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, m = np.array(row["ids"], np.int64), unit(np.array(row["vs"], float))
                if row["same"]:
                    near = m @ m.T >= least
                else:
                    other, size = unit(np.array(row["vs2"], float)), len(ids)
                    near = np.zeros((size + len(other), size + len(other)), bool)
                    near[:size, size:] = m @ other.T >= least
                    near[size:, :size] = near[:size, size:].T
                    ids = np.r_[ids, np.array(row["ids2"], np.int64)]
                np.fill_diagonal(near, True)
                at = ids[links(near)].reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(at.min(axis=1)), pa.array(at.max(axis=1))], names=["a", "b"])

    return two.mapInArrow(run, "a long, b long").where("a <> b")


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1.0)


def token_budget(sections: DataFrame, keys: list[str], priority: str, text: str, budget: int) -> DataFrame:
    """The sections that fit, in order of priority, up to the first that does not, which is cut at a line's end if over 300 characters remain."""
    w = Window.partitionBy(*keys).orderBy(priority).rowsBetween(Window.unboundedPreceding, -1)
    spent = sections.withColumn("__spent", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))
    room = F.lit(budget) - F.col("__spent")
    cut = F.regexp_extract(F.substr(F.col(text), F.lit(1), F.greatest(room, F.lit(0)).cast("int")), r"(?s)^(.*)\n", 1)
    fits = F.length(text) <= room
    kept = spent.withColumn(text, F.when(fits, F.col(text)).when(room > 300, cut)).where(f"{text} is not null")
    return kept.drop("__spent")


def chat_pairs(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, question, answer: each user turn that has an answer before the next user turn, with the first such answer.

    User turns of two characters or less, or that begin with `<`, are passed over, and so are empty answers.
    """
    valid = F.when((F.col(role) == "user") & (F.length(F.trim(text)) > 2) & ~F.startswith(F.trim(F.col(text)), F.lit("<")), "user").when((F.col(role) == "assistant") & (F.length(F.trim(text)) > 0), "assistant")
    w = Window.partitionBy(conv).orderBy(turn)
    kept = turns.withColumn("__r", valid).where("__r is not null")
    marked = kept.select("*", F.lag("__r").over(w).alias("__before"), F.lag(text).over(w).alias("question"), F.lag(turn).over(w).alias("__turn"))
    return marked.where("__r = 'assistant' and __before = 'user'").select(F.col(conv), F.col("__turn").alias("turn"), "question", F.col(text).alias("answer"))


def full_pass(rankings: list[DataFrame], chunks: DataFrame, questions: DataFrame, own_namespace: str, k: int = 10, fused: int = 50, rerank: Column | None = None) -> DataFrame:
    """query_id, item, score, rank of a whole retrieval: rankings(query_id, item, rank) are fused, the best `fused` are scoped by the
    question's year, seen only in the own namespace (or none), weighed by where their text comes from, and the best k kept.

    chunks(item, text, source_file, extraction, ocr_conf, namespace); questions(query_id, question). `rerank` is a score of its own over the
    joined columns, such as a model's UDF; without it the fused score stands.
    """
    from sparkmend.functions.text import provenance_weight
    from sparkmend.operators.ranking import visible
    from sparkmend.operators.scoring import scope_by_year

    best = top_k(fuse(rankings, ["query_id"], "item"), ["query_id"], "score", "item", fused).drop("rank")
    rows = best.join(chunks, "item").join(questions, "query_id").where(visible(F.col("namespace"), own_namespace))
    scoped = scope_by_year(rows, "question", "source_file", ["query_id"])
    base = F.col("score") if rerank is None else rerank
    weighed = scoped.withColumn("score", F.round(base * provenance_weight(F.col("extraction"), F.col("ocr_conf"), F.col("text")), 9))
    return top_k(weighed.select("query_id", "item", "score"), ["query_id"], "score", "item", k)


def conclusions(triples: DataFrame, found: DataFrame, canonical: Column, k: int = 3) -> DataFrame:
    """query_id, subject, relation, value: up to k distinct statements of the found chunks, in order of rank."""
    rows = triples.join(found.select("query_id", F.col("item").alias("chunk_id"), "rank"), "chunk_id").select("query_id", "subject", "relation", canonical.alias("value"), "rank")
    first = rows.groupBy("query_id", "subject", "relation", "value").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "subject", "relation", "value")
    return first.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r", "rank")
