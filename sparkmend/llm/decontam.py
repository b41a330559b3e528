"""Benchmark decontamination with an FM-index for each training shard.

A shard is an Arrow batch of whole documents. Its words become numbers; words that no test phrase has cannot be
part of an occurrence, so only runs of phrase words long enough for a phrase are indexed, each ended by a
sentinel. Suffixes are sorted by prefix doubling, ranks of the Burrows-Wheeler column come from a wavelet matrix, and positions from every SAMPLE-th suffix position by LF steps. All phrases of a block
search backward together. Test sets beyond BLOCK_BYTES are dealt with in several blocks, one pass each: a block is read, sent
out, searched for, and released when its pass is written, so neither driver nor executors hold more than one or two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend.llm.columns import fresh, lowered, slices
from sparkmend.operators.shared import written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SAMPLE = 8
BLOCK_BYTES = 8 << 20
STATE = (T.LongType(), T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType())])), T.ArrayType(T.StringType()))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lowered(text)) if text else []


class Phrases:
    """Distinct windows of a block of items, as arrays of word numbers padded at the front."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        number: dict[str, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for key, text in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(tuple(ids[i : i + window]), set()).add(key)
        self.number = number
        self.items = [sorted(s) for s in of.values()]
        self.lengths = np.array([len(p) for p in of], np.int64)
        self.words = np.zeros((len(of), window), np.int64)
        for i, p in enumerate(of):
            self.words[i, window - len(p) :] = p
        self.shortest = int(self.lengths.min()) if of else 0


class WaveletMatrix:
    """rank(symbol, i): how often a symbol occurs before position i; one bit vector a level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        level = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = level >> b & 1
            ones = np.zeros(len(level) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(level) - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), at.copy()
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            up = (symbol >> b & 1).astype(bool)
            a, z = ones[low], ones[high]
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + z, high - z)
        return high - low


class FMIndex:
    """Of runs of numbers > 0, each ended by the sentinel 0. Sentinels differ by their position, so that the order
    of all suffixes is found in as many doublings as the longest run asks for."""

    def __init__(self, sequence: np.ndarray):
        n, have = len(sequence), 1
        rank = np.unique(np.where(sequence == 0, np.arange(n), n + sequence), return_inverse=True)[1].astype(np.int64)
        while True:
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - have)] = rank[have:] + 1
            key = rank * (n + 2) + behind
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
            if rank[order[-1]] == n - 1:
                break
            have *= 2
        self.n, top = n, int(sequence.max())
        self.column = sequence[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(sequence, minlength=top + 1))]
        self.tree = WaveletMatrix(self.column, top)
        self.top = top
        self.sampled = np.where((order % SAMPLE == 0) | (self.column == 0), order, -1)  # a run's first always, so no step passes a sentinel

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, at)

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of all phrases, by backward search."""
        width = words.shape[1]
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for step in range(1, width + 1):
            live = np.flatnonzero((lengths >= step) & (low < high) & (words[:, width - step] <= self.top))
            symbol = words[live, width - step]
            dead = np.flatnonzero((lengths >= step) & (words[:, width - step] > self.top))
            high[dead] = low[dead]
            low[live], high[live] = self.back(symbol, low[live]), self.back(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: LF steps to the next sampled one."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        rows, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            found = self.sampled[rows[open_]]
            done = found >= 0
            out[open_[done]] = found[done] + steps[open_[done]]
            open_ = open_[~done]
            at = rows[open_]
            rows[open_] = self.back(self.column[at], at)
            steps[open_] += 1
        return out


def shard_hits(split: list[list[str]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Merged word spans [first, past) and the items found, of each document."""
    spans: list[list[tuple[int, int]]] = [[] for _ in split]
    items: list[list[str]] = [[] for _ in split]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    total = int(sizes.sum())
    if not total or not phrases.shortest:
        return spans, items
    get = phrases.number.get
    ids = np.fromiter((get(w, 0) for ws in split for w in ws), np.int64, total)
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(split)), sizes)
    # runs of phrase words within one document
    known = ids > 0
    border = np.ones(total, bool)
    border[1:] = (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])
    starts = np.flatnonzero(border)
    lengths = np.diff(np.r_[starts, total])
    good = known[starts] & (lengths >= phrases.shortest)
    starts, lengths = starts[good], lengths[good]
    if not len(starts):
        return spans, items
    place = np.repeat(starts, lengths + 1) + (np.arange(int((lengths + 1).sum())) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1))
    sequence = ids[np.minimum(place, total - 1)]
    sequence[np.cumsum(lengths + 1) - 1] = 0
    index = FMIndex(sequence)
    low, high = index.search(phrases.words, phrases.lengths)
    many = high - low
    which = np.repeat(np.arange(len(many)), many)
    rows = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    at = place[index.locate(rows)]
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + phrases.lengths[which], -1)
    hit = np.cumsum(marks[:-1]) > 0
    edge = np.ones(total, bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (hit[1:] != hit[:-1])
    cut = np.flatnonzero(edge)
    ends = np.r_[cut[1:], total]
    for a, b in zip(cut[hit[cut]].tolist(), ends[hit[cut]].tolist()):
        d = doc[a]
        spans[d].append((a - int(begins[d]), b - int(begins[d])))
    pairs = np.unique(np.stack([doc[at], which], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    for d, p in pairs.tolist():
        items[d] += phrases.items[p]
    return spans, [sorted(set(x)) for x in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, nameless: bool = False) -> Iterator[list[tuple[str, str | None]]]:
    """The test set in blocks of bounded size; items without an id only if `nameless`, with the empty id."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    rows = rows.na.fill("", [item_col]) if nameless else rows.where(F.col(item_col).isNotNull())
    some, size = [], 0
    for key, text in rows.toLocalIterator():
        some.append((key, text))
        size += len(text or "") + 64
        if size >= BLOCK_BYTES:
            yield some
            some, size = [], 0
    yield some


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", prefix: str = "") -> DataFrame:
    """The documents, all their columns, with n_words, hits (merged word spans) and items (ids of found test items).

    Null and empty texts have no words and no hits. An item of fewer words than a window is one window; an item
    without words, or with a null id, is none. Repeated documents and items stay; repeated windows count once. An empty test
    set hits nothing. Names of new columns take `prefix`, and underscores before it should the documents have such columns themselves.
    """
    names = fresh(docs, f"{prefix}n_words", f"{prefix}hits", f"{prefix}items")
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])), pa.list_(pa.string())]
    context, width, at = docs.sparkSession.sparkContext, len(docs.columns), docs.columns.index(text_col)

    def passed(bound, later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(bound.value, window)
            for batch in slices(batches):
                split = [words_of(t) for t in batch.column(at).to_pylist()]
                spans, items = shard_hits(split, phrases)
                if later:
                    spans = [merged(s + [(h["first"], h["past"]) for h in o]) for s, o in zip(spans, batch.column(width + 1).to_pylist())]
                    items = [sorted({*i, *o}) for i, o in zip(items, batch.column(width + 2).to_pylist())]
                new = [[len(ws) for ws in split], [[{"first": a, "past": b} for a, b in s] for s in spans], items]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(x, k) for x, k in zip(new, kinds))], names=[*batch.schema.names[:width], *names])

        return run

    out, bound = docs, None
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, STATE))])
    for block in blocks(benchmark, item_col, item_text_col):
        later = bound is not None
        if later:
            out = written(out, "hits")
            bound.destroy()
        bound = context.broadcast(block)
        out = out.mapInArrow(passed(bound, later), schema)
    return out


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Edge cases as in with_hits."""
    rows = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["past"] - h["first"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    bounds = [m.span() for m in WORD.finditer(lowered(text))]
    out, at = [], 0
    for first, past in spans:
        out.append(text[at : bounds[first][0]])
        at = bounds[past - 1][1]
    return "".join([*out, text[at:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, same columns, without the passages that with_hits finds; clean texts stay as they are.

    Items with a null id are cut like any other. A cut can bring words together that again form a test phrase, so a changed
    text is searched until it is clean. With several blocks of test items their passes are repeated until no text gets shorter.
    Null texts stay null, repeated rows stay, other columns may have any names; without items or documents nothing changes.
    """
    context, at = docs.sparkSession.sparkContext, docs.columns.index(text_col)

    def passed(bound):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(bound.value, window)
            for batch in slices(batches):
                texts = batch.column(at).to_pylist()
                look = list(range(len(texts)))
                while look:
                    spans, _ = shard_hits([words_of(texts[i]) for i in look], phrases)
                    look_again = []
                    for i, s in zip(look, spans):
                        if s:
                            texts[i] = cut_spans(texts[i], s)
                            look_again.append(i)
                    look = look_again
                columns = [*batch.columns]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return run

    size, before, out, many = F.sum(F.length(text_col)), None, docs, False
    while True:
        bound = None
        for block in blocks(benchmark, item_col, item_text_col, nameless=True):
            if bound is not None:
                out, many = written(out, "cut"), True
                bound.destroy()
            bound = context.broadcast(block)
            out = out.mapInArrow(passed(bound), docs.schema)
        if not many:
            return out
        out = written(out, "cut")
        bound.destroy()
        if (now := out.agg(size).first()[0]) == before:
            return out
        before = now
