"""Token counts by rank-synchronous merging.

Distinct pre-tokens of a batch become one ragged array of symbols. In each round every sequence finds its
lowest-rank adjacent pair and all sequences apply theirs at once; when no pair has a rank, the symbols that
survive are the tokens. No Encoding objects are made and nothing is shuffled: the operator is one map over
the scan, so a lost task only runs again over its own files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkmend.llm.columns import keyed_text, slices
from sparkmend.llm.units import LONGEST_KEPT, UNIT, split_specials

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes as themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Pair ranks of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_symbol = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.byte_symbol[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = max(vocab.values()) + 2
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = made  # by rank
        self.none = len(pairs)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def surviving(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each byte string, by merging in all of them together."""
        n = len(pieces)
        counts = np.fromiter(map(len, pieces), np.int64, n)
        active = np.flatnonzero(counts > 1)
        if not len(active):
            return counts
        flat = self.byte_symbol[np.frombuffer(b"".join(pieces[i] for i in active), np.uint8)]
        seq = np.repeat(np.arange(len(active)), counts[active])
        while len(flat):
            joined = seq[1:] == seq[:-1]
            rank = np.full(len(flat), self.none, np.int64)
            rank[:-1][joined] = self.ranks(flat[:-1][joined], flat[1:][joined])
            starts = np.flatnonzero(np.r_[True, ~joined])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(flat)])
            done = lowest == self.none
            counts[active[seq[starts[done]]]] = sizes[done]
            per_symbol = np.repeat(lowest, sizes)
            hit = (rank == per_symbol) & (per_symbol < self.none)
            # of overlapping occurrences of one pair (aaa), every second is left out, counted from the run's start
            run = np.flatnonzero(hit)
            if len(run):
                fresh = np.r_[True, np.diff(run) > 1]
                begin = np.repeat(run[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(run)]))
                odd = (run - begin) % 2 == 1
                same = flat[run] == flat[np.minimum(run + 1, len(flat) - 1)]
                hit[run[odd & same]] = False
            flat[hit] = self.made[per_symbol[hit]]
            keep = np.repeat(~done, sizes)
            keep[1:] &= ~hit[:-1]
            flat, seq = flat[keep], seq[keep]
        return counts


class Counter:
    """Counts tokens of texts; keeps the counts of short units it has seen, two generations of bounded size."""

    def __init__(self, path: str, most_kept: int = 300_000):
        self.table, self.most_kept = MergeTable(path), most_kept
        self.pattern, self.parts = regex.compile(PATTERN), split_specials(self.table.specials)
        self.specials = self.table.specials
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def learn(self, units: list[str]) -> dict[str, int]:
        pieces = [self.pattern.findall(u) for u in units]
        distinct = {p: None for ps in pieces for p in ps}
        of = dict(zip(distinct, self.table.surviving([p.encode() for p in distinct]).tolist()))
        return {u: sum(of[p] for p in ps) for u, ps in zip(units, pieces)}

    def count(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for text in texts:
            more = 0
            if any(s in text for s in self.specials):
                units = []
                for part, special in self.parts(text):
                    if special:
                        more += 1
                    else:
                        units += UNIT.findall(part)
            else:
                units = UNIT.findall(text)
            split.append(units)
            extra.append(more)
        known = self.known
        fresh = list({u for units in split for u in units if u not in known})
        older = self.older
        if older:
            known.update((u, older[u]) for u in fresh if u in older)
            fresh = [u for u in fresh if u not in older]
        known.update(self.learn(fresh))
        out = [m + sum(map(known.__getitem__, units)) for units, m in zip(split, extra)]
        for u in fresh:
            if len(u) > LONGEST_KEPT:
                del known[u]
        if len(known) > self.most_kept:
            self.known, self.older = {}, known
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Null or repeated ids and repeated rows stay as they
    are, a row each. Very long texts are counted whole; batches are cut by bytes, so memory stays bounded.
    Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = counter.count(texts)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
