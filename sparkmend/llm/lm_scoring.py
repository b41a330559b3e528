"""LM scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary (every word of the corpus) and one prior (the background's unigrams
with one added to each count, with weight `prior`). A document's score is the mean of its tokens' target loss minus
background loss: lower is more like the target.

Documents become chunks of word numbers with the chunk's own list of word hashes (64 bits), written once. Each chunk sends its distinct
bigrams, words and first words, as hashes with both models' counts, packed, to buckets by the hash; a bucket sums them and
sends the sums back to the chunks, packed in the same order. So every n-gram of the corpus is counted, the vocabulary has
no bound, nothing that grows with it is broadcast or reaches the driver, and no word gathers its bigrams in one task. The
number of buckets follows from the number of chunks, so that a task holds one bucket of BUCKET_BYTES or so at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmend.llm.columns import keyed_text, slices
from sparkmend.operators.shared import written

WORD = re.compile(r"\w+")
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20
BIGRAM, ONE, FIRST = 0, 1, 2  # what a key counts, in its two lowest bits
START = np.uint64(0x5851F42D4C957F2D)  # stands before a document's first word
CHUNKS = "chunk long, doc_ids array<long>, sizes array<int>, words binary, ids binary"
SENT = "bucket int, chunk long, keys binary, background binary, target binary"
BACK = "chunk long, bucket int, counts binary, n_words long, n_tokens long"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def packed(numbers: np.ndarray) -> bytes:
    """An array byte by byte, highest bytes together: most are zero and shrink away."""
    return zlib.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents: their words as numbers in the order of a chunk's first meetings, and those words' hashes."""
    part, k = TaskContext.get().partitionId() << 32, 0
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("ids", pa.binary())])
    for batch in slices(batches, CHUNK_BYTES):
        number: dict[str, int] = {}
        split = [words_of(t) for t in batch.column(1).to_pylist()]
        ids = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.uint32)
        words = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number), np.uint64, len(number))
        yield pa.RecordBatch.from_pylist([{"chunk": part + k, "doc_ids": batch.column(0).to_pylist(), "sizes": [len(ws) for ws in split], "words": words.tobytes(), "ids": packed(ids)}], schema=schema)
        k += 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


class Grams:
    """A chunk's distinct bigrams, words and first words as keys in order of bucket, and where its tokens find theirs."""

    def __init__(self, row: dict, buckets: int):
        words = np.r_[np.frombuffer(row["words"], np.uint64), START]
        self.sizes = np.array(row["sizes"], np.int64)
        ids = unpacked(row["ids"], np.uint32).astype(np.int64)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = len(words) - 1
        pairs, which = np.unique(before * len(words) + ids, return_inverse=True)
        first, second = pairs // len(words), pairs % len(words)
        firsts, which_first = np.unique(before, return_inverse=True)
        parts = (words[first] * np.uint64(0x9FB21C651E98DF25) + mixed(words[second])), words[:-1], words[firsts]
        keys = np.concatenate([mixed(x + np.uint64(kind)) & ~np.uint64(3) | np.uint64(kind) for kind, x in enumerate(parts)])
        bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.cuts = keys[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.bigram, self.one, self.first = place[which], place[len(pairs) + ids], place[len(pairs) + len(words) - 1 + which_first]

    def counts(self, tokens: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs, among all tokens or those chosen."""
        chosen = slice(None) if tokens is None else tokens
        return sum(np.bincount(x[chosen], minlength=len(self.keys)) for x in (self.bigram, self.one, self.first)).astype(np.uint32)


def sent(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, buckets)
                flags = np.array(row["flags"] or [False] * len(grams.sizes), bool)
                parts = grams.keys, grams.counts(), grams.counts(np.repeat(flags, grams.sizes))
                full = np.flatnonzero(np.diff(grams.cuts))
                columns = [[packed(x[grams.cuts[b] : grams.cuts[b + 1]]) if x is not grams.keys else x[grams.cuts[b] : grams.cuts[b + 1]].tobytes() for b in full] for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), *(pa.array(p, pa.binary()) for p in columns)], names=["bucket", "chunk", "keys", "background", "target"])

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both counts of each key over all chunks, back to the chunks; and, as chunk -1, how many words and tokens a bucket has.

    The rows of a partition come in order of bucket; one bucket is held at a time.
    """

    def totals(rows: list[dict]) -> pa.RecordBatch:
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        both = np.stack([np.bincount(which, weights=np.concatenate([unpacked(r[k], np.uint32) for r in rows]), minlength=len(distinct)) for k in ("target", "background")], axis=1).astype(np.uint64)
        one = (distinct & np.uint64(3)) == ONE
        ends = np.cumsum([len(k) for k in keys]).tolist()
        sent_back = both[which]
        parts = [packed(sent_back[a:b].ravel()) for a, b in zip([0, *ends], ends)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(r["chunk"] for r in rows), -1], pa.int64()), pa.array([rows[0]["bucket"]] * (len(rows) + 1), pa.int32()), pa.array([*parts, None], pa.binary()),
                pa.array([None] * len(rows) + [int(one.sum())], pa.int64()), pa.array([None] * len(rows) + [int(both[one, 1].sum())], pa.int64()),
            ],
            names=["chunk", "bucket", "counts", "n_words", "n_tokens"],
        )

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield totals(held)
                held = []
            held.append(row)
    if held:
        yield totals(held)


def scored(buckets: int, prior: float, all_weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, buckets)
                sizes, counts = grams.sizes, np.zeros((0, 2))
                if row["parts"]:
                    counts = np.concatenate([unpacked(x["counts"], np.uint64) for x in sorted(row["parts"], key=lambda x: x["bucket"])]).reshape(-1, 2).astype(float)
                usual = prior * (counts[grams.one, 1] + 1) / all_weight
                losses = -np.log((counts[grams.bigram] + usual[:, None]) / (counts[grams.first] + prior))
                starts, full = np.cumsum(sizes) - sizes, sizes > 0
                per = np.zeros((len(sizes), 2))
                if full.any():
                    per[full] = (np.add.reduceat(losses, starts[full], axis=0) / sizes[full][:, None]).round(6)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(per[:, 0]), pa.array(per[:, 1]), pa.array((per[:, 0] - per[:, 1]).round(6))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, prior: float = 64.0, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score (their difference), a mean each.

    `targets` names the documents of the target model by id, once or more often; the background is all documents. Null and empty texts, and
    texts without a word, have no tokens and zeros. Null ids are never targets. Repeated rows stay and all count. Without
    targets the target model is the prior alone. An empty table gives an empty result. Words and bigrams are told apart by 64-bit hashes.
    Only the id and the text are read, so names of other columns don't matter.
    """
    spark = docs.sparkSession
    chunks = written(keyed_text(docs, id_col, text_col).mapInArrow(chunked, CHUNKS), "chunks")
    # a chunk's keys take about as many bytes as its text
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count() * CHUNK_BYTES // BUCKET_BYTES)
    named = targets.select(F.col(target_id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("chosen", F.lit(True))
    places = chunks.select("chunk", F.posexplode("doc_ids").alias("at", "doc_id"))
    flags = places.join(named, "doc_id", "left").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("chosen", F.lit(False)).alias("chosen")))).alias("flags"))
    flags = written(flags.select("chunk", F.col("flags.chosen").alias("flags")), "target_flags")
    there = chunks.join(flags, "chunk", "left")
    grams = there.select("chunk", "sizes", "words", "ids", "flags").mapInArrow(sent(buckets), SENT)
    back = written(grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(summed, BACK), "gram_counts")
    facts = back.where("chunk = -1").agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    parts = back.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("parts"))
    return chunks.join(parts, "chunk", "left").mapInArrow(scored(buckets, prior, float(sum(facts) + 1)), SCORES)
