"""SimHash near-dedup with a pigeonring filter.

Two fingerprints of 64 bits that differ in at most 3 have, among the four 16-bit segments on a ring, one from which the
cumulative differences of 1, 2, 3 and 4 consecutive segments stay within 0, 1, 2 and 3 (3/4 a segment). The join
asks for that chain: the first segment equal, and the second with at most one of its four nibbles changed, which is
one of 16 keys of 28 bits. Pairs below a key must pass the rest of the chain before the full Hamming check.

Only distinct fingerprints are joined. A key of many fingerprints is not paired: up to GATHERED of them are compared in one task, which gives a
spanning star for each class; more are dealt again below keys that also hold three of the six 6-bit pieces of the other bits; with 46 bits held, a group has at most
2**18 fingerprints, looked up in a table, and gives stars too. Where links also ask for a second fingerprint, members of one fingerprint do not
stand for each other: all members of any two fingerprints within reach are compared, in the first group only that the two share.

To keep one document of each near-duplicate group, fingerprints of three-word shingles are too coarse: a text that shares four
fifths of its five-word shingles with another differs from it in some ten bits. So texts are joined below TABLES fingerprints
of their distinct words (once each, or the words that every text has would make unrelated ones alike), by the same chains, and a link must also hold between the fingerprints of their five-word shingles,
within NEAR_BITS bits: about what a similarity of 0.8 leaves (9.7 bits are expected there, 32 for unrelated texts).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend.llm.columns import fresh, keyed_text, lowered, slices
from sparkmend.operators.components import connected_components
from sparkmend.operators.shared import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEGMENTS, WIDTH, BUDGET = 4, 16, 3
CROWDED, GATHERED = 32, 2048  # fingerprints below a key: more than the first are not paired, more than the second dealt again
TABLES, NEAR_BITS, SHINGLE = 5, 16, 5
THREES = list(combinations(range(6), 3))  # the pieces that are held when a crowded key is dealt again
TILE = 1 << 18  # pairs compared at once
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()  # a byte's bits as eight bytes


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lowered(text)) if text else []


def shingles(words: list[str], size: int) -> list[str]:
    if len(words) > size:
        return [" ".join(s) for s in zip(*(words[i:] for i in range(size)))]
    return [" ".join(words)] if words else []


def fingerprints(texts: list[str | None], size: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if more than half of the shingles' hashes have it."""
    hash_of = xxhash.xxh64_intdigest
    rows = [[hash_of(s, seed) for s in shingles(words_of(text), size)] for text in texts]
    return majority_bits(np.array([h for r in rows for h in r], "<u8"), np.fromiter(map(len, rows), np.int64, len(rows)))


def majority_bits(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text's hashes, n of them, the bits that more than half have; none without hashes.

    A byte's bits become eight lanes of a number, so 255 hashes are summed with eight additions each before a lane is full.
    """
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        size = n[full]
        pieces = -(-size // 255)
        firsts = np.cumsum(pieces) - pieces
        starts = np.repeat((np.cumsum(n) - n)[full], pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(firsts, pieces))
        lanes = np.add.reduceat(LANES[hashes.view(np.uint8)].reshape(-1, 8), starts, axis=0)
        # bytes in little-endian order, bits from the lowest
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64), firsts, axis=0, dtype=np.int32)
        set_ = (2 * sums > size[:, None]).astype(np.uint8)
        out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def near_fingerprints(texts: list[str | None], tables: int, shingle: int, seed: int = 42) -> list[np.ndarray]:
    """For each text `tables` fingerprints of its distinct words, and that of its shingles; a word's hashes beyond the first are the first one's, mixed."""
    hash_of, met, words, parts = xxhash.xxh64_intdigest, {}, [], []
    for text in texts:
        mine = words_of(text)
        own = set(mine)
        for w in own:
            if w not in met:
                met[w] = hash_of(w, seed)
        words.append([met[w] for w in own])
        parts.append([hash_of(s, seed) for s in shingles(mine, shingle)])
    n, hashes = np.fromiter(map(len, words), np.int64, len(words)), np.array([h for r in words for h in r], "<u8")
    out = []
    for k in range(tables):
        x = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) if k else hashes
        out.append(majority_bits(x ^ x >> np.uint64(32) if k else x, n))
    return [*out, majority_bits(np.array([h for r in parts for h in r], "<u8"), np.fromiter(map(len, parts), np.int64, len(parts)))]


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """The documents, all their columns, and the fingerprint as a long."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(batch.column(at).to_pylist()))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(fp: Column) -> Column:
    """The 16 keys: table number, first segment, and the second without one nibble."""
    keys = []
    for i in range(SEGMENTS):
        first, second = bits(fp, WIDTH * i, WIDTH), bits(fp, WIDTH * ((i + 1) % SEGMENTS), WIDTH)
        for j in range(4):
            kept = second.bitwiseAND(F.lit(0xFFFF ^ 0xF << 4 * j))
            keys.append(F.lit((4 * i + j) << 32).bitwiseOR(F.shiftleft(first, WIDTH)).bitwiseOR(kept))
    return F.array(*keys)


def chain_holds(a: Column, b: Column) -> Column:
    """From some segment on, the differences of 1 to 4 segments stay within their budgets."""
    diff = [F.bit_count(bits(a.bitwiseXOR(b), WIDTH * i, WIDTH)) for i in range(SEGMENTS)]
    held = F.lit(False)
    for i in range(SEGMENTS):
        total, chain = F.lit(0), F.lit(True)
        for k in range(SEGMENTS):
            total = total + diff[(i + k) % SEGMENTS]
            chain = chain & (total <= BUDGET * (k + 1) // SEGMENTS)
        held = held | chain
    return held


def sparse_links(keyed: DataFrame, near_bits: int) -> DataFrame:
    """Links below keys of at most CROWDED members."""
    groups = keyed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "fp", "own"))).alias("all"))
    mine = F.col("one")
    near = F.filter("all", lambda x: (x["node"] > mine["node"]) & chain_holds(x["fp"], mine["fp"]) & (F.bit_count(x["fp"].bitwiseXOR(mine["fp"])) <= BUDGET) & (F.bit_count(x["own"].bitwiseXOR(mine["own"])) <= near_bits))
    return groups.select(F.explode("all").alias("one"), "all").select(mine["node"].alias("src"), F.explode(F.transform(near, lambda x: x["node"])).alias("dst"))


def gathered_links(keyed: DataFrame, near_bits: int) -> DataFrame:
    """Stars of the classes below keys of up to GATHERED members, each two compared."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                fps, own, nodes = (np.array(group.values.field(k).to_numpy(), np.int64) for k in range(3))
                root = nearest_roots(fps.view(np.uint64), own.view(np.uint64), nodes, near_bits)
                mine = root != nodes
                yield pa.RecordBatch.from_arrays([pa.array(nodes[mine]), pa.array(root[mine])], names=["src", "dst"])

    groups = keyed.groupBy("key").agg(F.collect_list(F.struct("fp", "own", "node")).alias("all"))
    return groups.select("all").mapInArrow(star, "src long, dst long").distinct()


def nearest_roots(bare: np.ndarray, second: np.ndarray, nodes: np.ndarray, near_bits: int) -> np.ndarray:
    """The least node of each one's class, all pairs compared."""
    order = np.argsort(nodes)
    bare, second = bare[order], second[order]
    near = np.bitwise_count(bare[:, None] ^ bare) <= BUDGET
    if near_bits < 64:
        near &= np.bitwise_count(second[:, None] ^ second) <= near_bits
    label = np.arange(len(nodes))  # by order of nodes
    while True:
        new = np.where(near, label, len(nodes)).min(axis=1)
        new = new[new]  # a class's label is a member of it, so it can be followed
        if (new == label).all():
            break
        label = new
    out = np.empty(len(nodes), np.int64)
    out[order] = nodes[order][label]
    return out


def free_bits(table: int) -> list[int]:
    """The 36 bits that a key of this table leaves open."""
    i, j = divmod(table, 4)
    nibble = WIDTH * ((i + 1) % SEGMENTS) + 4 * j
    return [*range(nibble, nibble + 4), *(WIDTH * ((i + k) % SEGMENTS) + b for k in (2, 3) for b in range(WIDTH))]


def open_bits(table: int, three: int) -> list[int]:
    """The 18 bits that a group dealt from a key of this table leaves open."""
    free = free_bits(table)
    return [b for p in range(6) if p not in THREES[three] for b in free[6 * p : 6 * p + 6]]


def steps_of(places: list[int]) -> list[int]:
    """The differences of BUDGET bits at most, by number of bits."""
    return [sum(1 << b for b in c) for r in range(BUDGET + 1) for c in combinations(places, r)]


@cache
def own_steps(table: int, three: int) -> list[int]:
    """Of a dealt group's steps those that no earlier table or three leaves open too: two fingerprints that meet in many groups are compared in the first."""
    masks = np.array([sum(1 << b for b in open_bits(i, k)) for i in range(table + 1) for k in range(len(THREES)) if (i, k) < (table, three)], np.uint64)
    places = open_bits(table, three)
    whole = np.array(steps_of(places), np.uint64)
    met = ((whole[:, None] & ~masks) == 0).any(axis=1)
    return [step for step, m in zip(steps_of(list(range(len(places)))), met) if not m]


def crowded_links(keyed: DataFrame, near_bits: int) -> DataFrame:
    """Stars of the classes below keys of more members."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.zeros((16, len(THREES)), np.uint64)
        for table in range(16):
            free = free_bits(table)
            for t, three in enumerate(THREES):
                held = sum(1 << b for p in three for b in free[6 * p : 6 * p + 6])
                masks[table, t] = held
        for batch in slices(batches, 1 << 20):
            key, fp, own, node = (batch.column(i).to_numpy() for i in range(4))
            kept = masks[key >> 32 & 15] & fp.view(np.uint64)[:, None]
            t = np.broadcast_to(np.arange(len(THREES), dtype=np.int64), kept.shape).ravel()
            columns = [np.repeat(key, len(THREES)), t, kept.ravel().view(np.int64), *(np.repeat(x, len(THREES)) for x in (fp, own, node))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["key", "three", "held", "fp", "own", "node"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, three, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                fps, own, nodes = (np.array(group.values.field(k).to_numpy(), np.int64) for k in range(3))
                table = key >> 32 & 15
                root = classes(fps, open_bits(table, three), own, nodes, near_bits, own_steps(table, three))
                mine = root != nodes
                yield pa.RecordBatch.from_arrays([pa.array(nodes[mine]), pa.array(root[mine])], names=["src", "dst"])

    dealt = keyed.mapInArrow(deal, "key long, three long, held long, fp long, own long, node long")
    groups = dealt.groupBy("key", "three", "held").agg(F.collect_list(F.struct("fp", "own", "node")).alias("all")).where(F.size("all") > 1)
    return groups.select("key", "three", "all").mapInArrow(star, "src long, dst long").distinct()


def classes(fps: np.ndarray, open_: list[int], own: np.ndarray | None = None, nodes: np.ndarray | None = None, near_bits: int = 64, steps: list[int] | None = None) -> np.ndarray:
    """The least node (by default: fingerprint) of each one's class, where fingerprints differ in 18 open bits only.

    With near_bits, of more than 256 members those are compared whose fingerprints differ by one of `steps` (by default all of BUDGET open bits at
    most). Without, members of one fingerprint have the same links, so the least node stands for the others.
    """
    nodes, own = fps if nodes is None else nodes, np.zeros(len(fps), np.int64) if own is None else own
    if len(fps) <= 256:  # the table would cost more
        return nearest_roots(fps.view(np.uint64), own.view(np.uint64), nodes, near_bits)
    order = np.argsort(nodes)
    bare, second = fps[order].view(np.uint64), own[order].view(np.uint64)
    code = np.zeros(len(fps), np.int64)
    for k, b in enumerate(open_):
        code |= ((bare >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    if near_bits < 64:
        out = np.empty(len(fps), np.int64)
        out[order] = nodes[order][member_classes(code, second, near_bits, steps_of(list(range(len(open_)))) if steps is None else steps)]
        return out
    label = np.arange(len(fps))  # by order of nodes
    table = np.full(1 << len(open_), -1, np.int64)
    table[code[::-1]] = np.arange(len(fps))[::-1]  # the least comes last
    steps = steps_of(list(range(len(open_))))
    while True:
        before = label.copy()
        for step in steps:
            other = table[code ^ step]
            there = other >= 0
            label = np.where(there, np.minimum(label, label[other]), label)
            np.minimum.at(label, other[there], label[there])
        label = label[label]
        if (label == before).all():
            break
    out = np.empty(len(fps), np.int64)
    out[order] = nodes[order][label]
    return out


def member_classes(code: np.ndarray, second: np.ndarray, near_bits: int, steps: list[int]) -> np.ndarray:
    """The first member of each one's class: linked are all whose codes differ by a step and whose second fingerprints in near_bits at most."""
    order = np.argsort(code, kind="stable")
    second, label = second[order], np.arange(len(code))
    codes, first, n = np.unique(code[order], return_index=True, return_counts=True)
    at = np.full(1 << 18, -1, np.int64)
    at[codes] = np.arange(len(codes))
    for step in steps:
        other = at[codes ^ step]
        a = np.flatnonzero(other >= np.arange(len(codes)))  # each two once, and at step 0 each with itself
        b = other[a]
        large = n[a] * n[b] > TILE
        for x, y in zip(a[large], b[large]):
            compare_blocks(second, label, (first[x], first[x] + n[x]), (first[y], first[y] + n[y]), near_bits)
        a, b = a[~large], b[~large]
        ends = np.cumsum(n[a] * n[b])
        for part in np.split(np.arange(len(a)), np.searchsorted(ends, np.arange(TILE, ends[-1], TILE))) if len(a) else ():
            x, y = a[part], b[part]
            size = n[x] * n[y]
            k = np.repeat(np.arange(len(x)), size)
            i = np.arange(len(k)) - (np.cumsum(size) - size)[k]
            p, q = first[x][k] + i // n[y][k], first[y][k] + i % n[y][k]
            near = np.bitwise_count(second[p] ^ second[q]) <= near_bits
            join_up(label, p[near], q[near])
    least = np.full(len(code), len(code))
    np.minimum.at(least, label, order)
    out = np.empty(len(code), np.int64)
    out[order] = least[label]
    return out


def compare_blocks(second: np.ndarray, label: np.ndarray, rows: tuple[int, int], columns: tuple[int, int], near_bits: int) -> None:
    """Joins up the labels of all near members of two ranges, or of one with itself, a tile at a time; what has one label is left out."""
    step = max(1, TILE // (columns[1] - columns[0]))
    for low in range(rows[0], rows[1], step):
        high, start = min(low + step, rows[1]), max(low, columns[0])  # a range with itself: from the diagonal on
        mine, others = slice(low, high), slice(start, columns[1])
        if (label[others] == label[low]).all() and (label[mine] == label[low]).all():
            continue
        near = np.bitwise_count(second[mine, None] ^ second[others]) <= near_bits
        near &= label[mine, None] != label[others]
        p, q = np.nonzero(near)
        join_up(label, p + low, q + start)


def join_up(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Makes the labels (least members, which label themselves) of p and q one, in place."""
    while True:
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def near_classes(rows: DataFrame, tables: list[str], near_bits: int = 64) -> DataFrame:
    """node, component for the nodes that have a link to another.

    Two nodes are linked if their fingerprints in one column of `tables` differ in BUDGET bits at most, and those in `own` in
    near_bits. Nodes with equal fingerprints are linked too, so give equal rows one node.
    """

    def keys(number: int, name: str) -> Column:
        return F.transform(chain_keys(F.col(name)), lambda k: F.struct((k + F.lit(number << 36)).alias("key"), F.col(name).alias("fp")))

    each = F.concat(*(keys(n, t) for n, t in enumerate(tables)))
    keyed = rows.select(F.explode(each).alias("x"), "own", "node").select("x.key", "x.fp", "own", "node")
    many = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "chain_keys")
    shared = keyed.join(many, "key")
    sizes = (F.col("n") <= CROWDED, sparse_links), (F.col("n").between(CROWDED + 1, GATHERED), gathered_links), (F.col("n") > max(CROWDED, GATHERED), crowded_links)
    links = [find(shared.where(size).select("key", "fp", "own", "node"), near_bits) for size, find in sizes]
    return connected_components(links[0].union(links[1]).union(links[2]))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    Null texts and texts without words have fingerprint zero and are linked like any other. Texts of fewer words than a shingle are
    one shingle. Rows with a null id get a component, whose id is null only if no member has an id. Repeated rows
    stay. Other columns are not read; an empty table gives an empty result.
    """
    rows = written(with_fingerprint(keyed_text(docs, id_col, text_col)).select("doc_id", "fp"), "fingerprints")
    ids = component_ids(rows, F.min("doc_id"))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("picked").alias("component_id"))


def component_ids(rows: DataFrame, pick: Column) -> DataFrame:
    """fp, picked: for every fingerprint of the rows what `pick` gives over its whole component."""
    fps = written(rows.groupBy("fp").agg(pick.alias("picked")), "distinct_fingerprints")
    nodes = near_classes(fps.select("fp", F.lit(0).cast("long").alias("own"), F.col("fp").alias("node")), ["fp"])
    placed = written(fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "picked"), "placed")
    least = written(placed.groupBy("component").agg(F.min("picked").alias("picked")), "picked")
    return written(placed.select("fp", "component").join(least, "component").select("fp", "picked"), "component_ids")


def with_near_fingerprints(docs: DataFrame, text_col: str, names: list[str], shingle: int) -> DataFrame:
    """The documents, all their columns, and near_fingerprints under the names given, the shingles' last."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            found = near_fingerprints(batch.column(at).to_pylist(), len(names) - 1, shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: int = TABLES, near_bits: int = NEAR_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The documents, same columns, one of each near-duplicate group: that of the least id (null ids last), of equal rows any one.

    Two texts are linked if one of `tables` fingerprints of their words differs in BUDGET bits at most and that of their shingles
    in near_bits; a group is what links reach. Null texts and texts without words have zero fingerprints and are one group; texts of fewer
    words than a shingle are one shingle. Other columns may have any names. An empty table stays empty.
    """
    row, own, *names = fresh(docs, "row", "own", *(f"fp{k}" for k in range(tables)))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row))
    rows = written(with_near_fingerprints(docs, text_col, [*names, own], shingle).withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    plain = [f"f{k}" for k in range(tables)]
    keys = rows.select(*(F.col(n).alias(p) for n, p in zip(names, plain)), F.col(own).alias("own"), order.alias("o"))
    texts = written(keys.groupBy(*plain, "own").agg(F.min("o").alias("o")).withColumn("node", F.col("o")[row]), "distinct_texts")
    nodes = near_classes(texts, plain, near_bits)
    placed = texts.select("node", "o").join(nodes, "node", "left").select(F.coalesce("component", "node").alias("component"), "o")
    chosen = written(placed.groupBy("component").agg(F.min("o").alias("o")).select(F.col("o")[row].alias(row)), "chosen")
    # by sorting at every size: a broadcast that only small inputs allow would hide what the join costs
    return rows.join(chosen.hint("merge"), row, "left_semi").select(*docs.columns)
