"""Token ids in a word-aligned binary form (Simple-8b).

A 64-bit word has a 4-bit selector and 60 bits of payload that hold as many equally wide ids as fit. A word with
selector 0 is an escape: the next word is one id of more than 60 bits. Blocks of BLOCK ids start at recorded word
offsets, so any block is decoded with a few array operations. The files are Parquet tables written by Spark's
committer in ascending doc_id order, one row for a run of documents; a lost task writes its part again.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmend.llm.columns import keyed_text, slices
from sparkmend.llm.units import UNIT, special_strings, split_specials
from sparkmend.operators.shared import written

# Ids a word and bits an id, by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK = 4_096
FILE_SCHEMA = "part int, run int, first long, doc_ids array<long>, sizes array<long>, block_words array<int>, words binary"
OUT_SCHEMA = "doc_id long, part int, begin long, n_tokens long, ids_crc32 long"


def windows_of(fits: np.ndarray, width: int) -> np.ndarray:
    """Whether all of fits[i : i + width] hold; what is beyond the end holds."""
    n, have = len(fits), 1
    out = fits.copy()
    while have < width:
        step = min(have, width - have)
        out[: n - step] &= out[step:].copy() if n > step else out[:0]
        have += step
    return out


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Words of all blocks, and the word offset at which each block begins.

    At every id the selector that takes the most is known from array operations; all blocks then step from word to
    word side by side. A block's last word may repeat ids of the next block, which reading passes over.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), []
    selector = np.zeros(n, np.uint8)
    top = int(ids.max())
    for s in range(14, 0, -1):
        if top < 1 << int(WIDTHS[s]):
            selector[:] = s
            continue
        fits = ids < np.uint64(1 << int(WIDTHS[s]))
        if fits.any():
            selector[windows_of(fits, int(COUNTS[s]))] = s
    step = np.r_[np.where(selector == 0, 1, COUNTS[selector]), 0]
    first = np.arange(0, n, BLOCK)
    past = np.minimum(first + BLOCK, n)
    head, at = np.zeros(n + 1, bool), first
    while True:
        head[at] = True
        new = np.minimum(at + step[at], past)
        if (new == past).all():
            break
        at = np.where(new < past, new, at)
    starts = np.flatnonzero(head[:n])
    chosen = selector[starts]
    escaped = chosen == 0
    place = np.arange(len(starts)) + np.r_[0, np.cumsum(escaped)[:-1]]
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    padded = np.r_[ids, np.zeros(60, np.uint64)]
    for s in range(1, 15):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            c, w = int(COUNTS[s]), int(WIDTHS[s])
            word = np.full(len(mine), s << 60, np.uint64)
            for k in range(c):
                word |= padded[starts[mine] + k] << np.uint64(k * w)
            words[place[mine]] = word
    words[place[escaped] + 1] = ids[starts[escaped]]
    return words, place[np.searchsorted(starts, first)].tolist()


def unpack_blocks(words: np.ndarray, offsets: list[int], n: int) -> np.ndarray:
    """The n ids of pack_blocks()'s words. Any part of the blocks, with its words and offsets, is read the same way."""
    words = np.ascontiguousarray(words, np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw, at = np.zeros(len(words), bool), -1
    for z in np.flatnonzero(selector == 0).tolist():  # a raw word may look like an escape itself
        if z != at:
            at = z + 1
            raw[at] = True
    heads = np.flatnonzero(~raw)
    selector = selector[heads]
    counts = COUNTS[selector]
    begin = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, heads, side="right") - 1
    row = BLOCK + int(COUNTS.max())
    begin += block * row - begin[np.searchsorted(heads, offsets)][block]
    out = np.zeros(len(offsets) * row, np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        if s == 0:
            out[begin[mine]] = words[heads[mine] + 1]
            continue
        w = int(WIDTHS[s])
        for k in range(int(COUNTS[s])):
            out[begin[mine] + k] = (words[heads[mine]] >> np.uint64(k * w)) & np.uint64((1 << w) - 1)
    return out.reshape(-1, row)[:, :BLOCK].ravel()[:n]


class Known(dict):
    """Numbers of the units met, in order; those met since the last learn() wait in `new`."""

    def __init__(self, lead: str):
        self.lead, self.new, self.ids, self.chars = lead, [], [], 0

    def __missing__(self, unit: str) -> int:
        self[unit] = k = len(self)
        self.new.append(unit)
        return k


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that tasks after the first find the frequent units there."""
    return Encoder(path)


class Encoder:
    """Ids of texts by the tokenizers library, each distinct unit encoded once until a bounded table is full."""

    def __init__(self, path: str, most_kept: int = 900_000, most_chars: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most_kept, self.most_chars = Tokenizer.from_file(path), most_kept, most_chars
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.kind = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32
        for token, i in vocab.items():  # in byte-level vocabularies a letter is a byte
            self.bytes_of[i] = len(token)
        self.specials = special_strings(self.tokenizer)
        self.parts = split_specials(self.specials)
        self.forget()

    def forget(self) -> None:
        # words behind a single blank, without it; and any other units as they are
        self.spaced, self.plain = Known(" "), Known("")

    def learn(self, known: Known) -> None:
        """Units that begin with one blank are encoded strung together, as none merges with its neighbours."""
        width, units, found = np.dtype(self.kind).itemsize, [known.lead + u for u in known.new], {}
        strung = [u for u in units if u[0] == " " and u[1:2] > " " and not u[1].isspace() and not u[-1].isspace()]
        alone = list(set(units).difference(strung))
        for at in range(0, len(alone), 10_000):
            part = alone[at : at + 10_000]
            found.update((u, np.array(e.ids, self.kind).tobytes()) for u, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)))
        for at in range(0, len(strung), 2_000):
            part = strung[at : at + 2_000]
            whole = "".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.kind)
            sizes = map(len, part) if whole.isascii() else [len(u.encode()) for u in part]
            reach, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(sizes, np.int64, len(part)))
            last = np.searchsorted(reach, ends)
            if not np.array_equal(reach[last], ends):
                raise ValueError("a token crosses the border of a unit")
            data, stops = ids.tobytes(), (width * (last + 1)).tolist()
            found.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops)]))
        known.ids += map(found.__getitem__, units)
        known.chars += sum(map(len, units))
        known.new = []

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id, and the number of ids of each text.

        A text without two blanks together is cut at its blanks: a blank belongs to the word behind it. Others are cut by the
        units' pattern.
        """
        if max(len(self.spaced), len(self.plain)) > self.most_kept or self.spaced.chars + self.plain.chars > self.most_chars:
            self.forget()
        spaced, plain = self.spaced, self.plain
        split = []
        for text in texts:
            if any(s in text for s in self.specials):
                split.append(([plain[u] for part, special in self.parts(text) for u in ([part] if special else UNIT.findall(part))], []))
            elif "  " in text:
                split.append((list(map(plain.__getitem__, UNIT.findall(text))), []))
            else:
                words = text.split(" ")
                first = [plain[words[0]]] if words[0] else []
                split.append((first, list(map(spaced.__getitem__, words[1:]))))
        for known in (spaced, plain):
            if known.new:
                self.learn(known)
        end, width = self.kind(end_id).tobytes(), np.dtype(self.kind).itemsize
        of_plain, of_spaced = plain.ids.__getitem__, spaced.ids.__getitem__
        rows = [b"".join(map(of_plain, a)) + b"".join(map(of_spaced, b)) + end for a, b in split]
        return np.frombuffer(b"".join(rows), self.kind), np.fromiter(map(len, rows), np.int64, len(rows)) // width


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents in ascending id order; returns the written file table (FILE_SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, k = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, 8 << 20):
            ids, sizes = encoder(tokenizer_path).encode([t or "" for t in batch.column(1).to_pylist()], end_id)
            words, offsets = pack_blocks(ids)
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "run": k, "first": first, "doc_ids": batch.column(0).to_pylist(), "sizes": sizes.tolist(), "block_words": offsets, "words": words.astype("<u8").tobytes()}],
                schema=pa.schema([("part", pa.int32()), ("run", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("block_words", pa.list_(pa.int32())), ("words", pa.binary())]),
            )
            first, k = first + len(ids), k + 1

    ordered = keyed_text(docs, id_col, text_col).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(ordered.mapInArrow(run, FILE_SCHEMA), "token_files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32.

    The parts' totals are summed up in a table of one row a part, as small as the number of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ids = unpack_blocks(np.frombuffer(row["words"], "<u8"), row["block_words"], int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                begins, data = ends - sizes, ids.tobytes()
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(sizes), pa.int32()), pa.array(begins + row["first"]), pa.array(sizes), pa.array(crcs, pa.int64())],
                    names=["doc_id", "part", "begin", "n_tokens", "ids_crc32"],
                )

    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = files.groupBy("part").agg(F.sum(total).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = files.mapInArrow(run, OUT_SCHEMA)
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents and returns doc_id, start, n_tokens, ids_crc32 as read from the files.

    A null text is empty and has the end id only. Null ids come first; repeated ids are ordered by the hash of
    their text, so equal rows may change places without effect. Other columns are not read. An empty table
    writes an empty file table and gives an empty result.
    """
    return read_token_files(write_token_files(docs, tokenizer_path, end_id, id_col, text_col))
