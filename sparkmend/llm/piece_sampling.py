"""SentencePiece encoding and decoding with sampled segmentations.

Each distinct chunk (a run of blanks and the word behind it; no piece crosses one) becomes a lattice of pieces once:
forward filtering sums the weights of all segmentations up to each node, and every node keeps the shares of
its incoming pieces. Backward sampling then walks all chunks of a batch at once, a draw for each node reached. Draws are a hash of the
row's key, the seed and the character position, so they depend neither on batches nor on partitions.

A BPE vocabulary has merge ranks instead of probabilities; a piece of rank r weighs (r + 10) ** -theta, Zipf's law for theta = 1.
Characters without a piece fall back to their bytes. Decoding the ids gives the text back byte for byte.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkmend.llm.columns import fresh, keyed_text, slices

CHUNK = re.compile(r" *[^ ]+| +")
MARK = "▁"
DIGEST = "doc_id long, n_pieces long, pieces_crc32 long, decoded_sha256 string, lossless boolean"


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Trie:
    """The pieces' trie as one open-addressed table from (state, character) to state, walked for many positions at once."""

    def __init__(self, pieces: dict[str, int]):
        child: dict[tuple[int, int], int] = {}
        self.piece_at = [0]  # by state: number of the piece that ends there + 1
        for piece, number in pieces.items():
            state = 0
            for c in piece:
                key = (state, ord(c))
                state = child.get(key, 0)
                if not state:
                    state = child[key] = len(self.piece_at)
                    self.piece_at.append(0)
            self.piece_at[state] = number + 1
        self.piece_at = np.array(self.piece_at, np.int32)
        self.bits = max(4, (4 * len(child)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([s << 21 | c for s, c in child], np.int64)
        values = np.fromiter(child.values(), np.int64, len(child))
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, winner = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[winner]
            self.keys[at[put]], self.next[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (1 << self.bits) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states, 0 for none."""
        key = state << 21 | char
        at = self.slot(key)
        out, open_ = np.zeros(len(key), np.int64), np.arange(len(key))
        while len(open_):
            found = self.keys[at]
            same = found == key[open_]
            out[open_[same]] = self.next[at[same]]
            more = ~same & (found >= 0)
            open_, at = open_[more], (at[more] + 1) & (1 << self.bits) - 1
        return out


@lru_cache(maxsize=2)
def sampler(model_path: str, theta: float, seed: int) -> PieceSampler:
    """One for each worker process."""
    return PieceSampler(model_path, theta, seed)


class PieceSampler:
    def __init__(self, model_path: str, theta: float = 1.0, seed: int = 42):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.seed, n = seed, model.get_piece_size()
        pieces: dict[str, int] = {}
        self.byte_id = np.zeros(256, np.int64)
        shown = [b""] * n
        # by piece + 1: log weights; 0 is none, and behind the pieces come characters of 1 to 4 bytes without a piece
        self.weight = np.full(n + 6, -np.inf)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                shown[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i
                self.weight[i + 1] = -theta * math.log(10 - model.get_score(i))
                shown[i] = piece.replace(MARK, " ").encode()
        self.bare = n + 1
        self.weight[self.bare + 1 :] = -theta * math.log(10 + n) * np.arange(1, 5)
        self.trie, self.longest = Trie(pieces), max(map(len, pieces))
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.fromiter(map(len, shown), np.int64, n)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size

    def lattices(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering over the chunks' lattices.

        Returns the chunks' first nodes; for every node the cumulative shares (of 2**31) and the pieces + 1 of the edges that
        come in, by the length of the piece; and the characters, by the node behind them.
        """
        wide = self.longest
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        base = wide + np.cumsum(size + 1) - size - 1  # some nodes in front, so that every node has `wide` before it
        nodes = wide + int((size + 1).sum())
        letters = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        behind = np.arange(len(letters)) + np.repeat(base + 1 - (np.cumsum(size) - size), size)
        char = np.full(nodes + 1, -1, np.int64)
        char[behind] = letters
        piece = np.zeros((nodes, wide), np.int32)
        # a blank is written as the mark; a mark in the text itself has no piece
        spelled = np.where(char == ord(" "), ord(MARK), np.where(char == ord(MARK), 0x1FFFFE, char))
        at, state = behind - 1, np.zeros(len(behind), np.int64)
        for k in range(wide):
            at_char = spelled[np.minimum(at + k + 1, nodes)]
            inside = at_char >= 0
            at, state, at_char = at[inside], state[inside], at_char[inside]
            state = self.trie.step(state, at_char)
            there = state > 0
            at, state = at[there], state[there]
            ends = self.trie.piece_at[state]
            piece[at[ends > 0] + k + 1, k] = ends[ends > 0]
            if not len(at):
                break
        lone = behind[piece[behind, 0] == 0]
        codes = char[lone]
        piece[lone, 0] = self.bare + 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        total, share = np.zeros(nodes), np.full((nodes, wide), 1 << 31, np.uint32)
        order = np.argsort(-size, kind="stable")
        by_size, begins = -size[order], base[order]
        lanes = np.arange(1, wide + 1)
        for p in range(1, int(size.max(initial=0)) + 1):
            node = begins[: np.searchsorted(by_size, -p, side="right")] + p
            here = min(p, wide)  # no longer piece fits before the node
            reach = total[node[:, None] - lanes[:here]] + self.weight[piece[node, :here]]
            top = reach.max(axis=1)
            parts = np.exp(reach - top[:, None])
            upto = np.cumsum(parts, axis=1)
            total[node] = top + np.log(upto[:, -1])
            share[node, :here] = upto / upto[:, -1:] * 2147483648.0
        return base, share, piece, char

    def encode(self, texts: list[str], keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts, and how many each has."""
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        number = {c: i for i, c in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        many = np.fromiter(map(len, split), np.int64, len(split))
        total = int(many.sum())
        if not total:
            return np.zeros(0, np.int64), many
        chunks = list(number)
        base, share, piece, char = self.lattices(chunks)
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, total)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))[which]
        doc = np.repeat(np.arange(len(split)), many)
        past = np.cumsum(size)
        before = np.r_[0, past][np.cumsum(many) - many]  # characters of all texts before
        place = past - before[doc]  # position behind the chunk, in its text
        key = mixed(np.array([(k or 0) & (1 << 64) - 1 for k in keys], np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[doc]
        first = base[which]
        node, live, rounds = first + size, np.arange(total), []
        while len(live):
            here = node[live]
            draw = (mixed(key[live] + place[live].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.uint32)
            lane = (share[here] <= draw[:, None]).sum(axis=1)
            token = piece[here, lane].astype(np.int64) - 1
            token = np.where(token >= self.bare, -1 - char[here], token)
            rounds.append((live, token))
            place[live] -= lane + 1
            node[live] = here - lane - 1
            live = live[node[live] > first[live]]
        pieces = np.zeros(total, np.int64)
        for chunk, _ in rounds:
            pieces[chunk] += 1
        ends = np.cumsum(pieces)
        ids = np.zeros(int(ends[-1]), np.int64)
        for r, (chunk, token) in enumerate(rounds):
            ids[ends[chunk] - 1 - r] = token
        counts = np.diff(np.r_[0, ends][np.r_[0, np.cumsum(many)]])
        return self.fall_back(ids, counts) if (ids < 0).any() else (ids, counts)

    def fall_back(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters (given as -1 - code point) to the ids of their bytes."""
        low = ids < 0
        codes, which = np.unique(-1 - ids[low], return_inverse=True)
        spelled = [self.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in codes.tolist()]
        lengths = np.array([len(s) for s in spelled])
        sizes = np.ones(len(ids), np.int64)
        sizes[low] = lengths[which]
        ends = np.cumsum(sizes)
        out = np.repeat(ids, sizes)
        starts = (ends - sizes)[low]
        for k in range(4):
            mine = lengths[which] > k
            out[starts[mine] + k] = np.array([s[k] if len(s) > k else 0 for s in spelled])[which[mine]]
        doc_ends = np.cumsum(counts)
        edges = np.r_[0, ends][np.r_[0, doc_ends]]
        return out, np.diff(edges)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, the leading blank of each text included."""
        size = self.shown_size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ids) else 0) + np.repeat(self.shown_at[ids] - (ends - size), size)
        return self.shown[at]

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's bytes."""
        data, size = self.decode(ids).tobytes(), np.r_[0, np.cumsum(self.shown_size[ids])]
        ends = np.cumsum(counts)
        return [data[size[e - n] + 1 : size[e]] if n else b"" for n, e in zip(counts.tolist(), ends.tolist())]


def sampled_digests(docs: DataFrame, model_path: str, theta: float = 1.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, pieces_crc32 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded text) and lossless (decoded equals the text).

    Null and empty texts have no pieces. A null id draws like id 0; rows of equal id and text are sampled alike. Other columns
    are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = sampler(model_path, theta, seed)
        for batch in slices(batches, 1 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts = draws.encode(texts, batch.column(0).to_pylist())
            back = draws.decoded(ids, counts)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            crcs = [zlib.crc32(raw[e - 4 * n : e]) for n, e in zip(counts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(crcs, pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), pa.array([t.encode() == b for t, b in zip(texts, back)], pa.bool_())],
                names=["doc_id", "n_pieces", "pieces_crc32", "decoded_sha256", "lossless"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(run, DIGEST)


def with_pieces(docs: DataFrame, model_path: str, theta: float = 1.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", name: str = "piece_ids") -> DataFrame:
    """The documents, all their columns, and their sampled ids, in a column `name` (behind as many underscores as it takes to be new); edge cases as in sampled_digests."""
    name = fresh(docs, name)[0]
    at, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = sampler(model_path, theta, seed)
        for batch in slices(batches, 1 << 20):
            ids, counts = draws.encode([t or "" for t in batch.column(at).to_pylist()], batch.column(key).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decoded_texts(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", name: str = "text") -> DataFrame:
    """The rows, without their ids, and the decoded texts; null ids give null."""
    at = rows.columns.index(ids_col)
    kept = [i for i in range(len(rows.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = sampler(model_path, 1.0, 42)
        for batch in slices(batches, 1 << 20):
            lists = batch.column(at).to_pylist()
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            texts = draws.decoded(ids, np.array([len(x or ()) for x in lists], np.int64))
            back = pa.array([None if x is None else t.decode("utf-8", "surrogatepass") for x, t in zip(lists, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), back], names=[*(batch.schema.names[i] for i in kept), name])

    fields = [f for f in rows.schema.fields if f.name != ids_col]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.StringType())]))
