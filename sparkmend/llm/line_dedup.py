"""Line dedup by a segment-partition edit join.

Two lines are linked if they differ in at most a tenth of the longer one: by words (MOST_WORDS edits at most), or, if both have fewer
than FEW_WORDS words, by characters (MOST_CHARS edits at most). So a line below ten characters is linked to equal ones only.

A line is a sequence of words or characters. For a threshold it is split into threshold + 1 even segments; a line within the
threshold holds one of them unchanged, at a place that the multi-match-aware rule narrows to a few: it probes the segments
of lines as long as itself or up to the threshold shorter. Keys travel packed, one row for a slice of lines and a bucket, with a
64-bit hash of the line, once a task for each distinct line; keys of characters also with the parity of 32 classes of characters, of which an
edit changes two at most. Lines that share a key are verified on their texts by banded bit-parallel edit distance,
up to connected classes.

A key of many lines is dealt again. Lines that are linked to its least line need no comparison with one another; where others are left, what its lines have in common is taken out, and what is left, which must be within the
same threshold, is split, probed and dealt below the old key, round after round. Each round gives a line a bounded number of rows, so
rows grow with the number of lines and not with its square. Only lines that are equal but for twice the threshold are compared
in tiles when more than TILE share all the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend.llm.columns import fresh, slices
from sparkmend.operators.components import connected_components
from sparkmend.operators.shared import written

CHARS, WORDS = 0, 1
MOST = (2, 4)
MOST_CHARS, MOST_WORDS = MOST
FEW_WORDS = 20
CROWDED = TILE = 4096  # lines that one task compares; all pairs of so many cost less than dealing them again
LINE_KEY_BYTES, BUCKET_BYTES, MOST_BUCKETS = 500, 16 << 20, 1 << 14
FILTER_BITS, FILTER_PART = 26, 1 << 17
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
BLANK = np.array([chr(c).isspace() for c in range(0x3002)])
KEYS = "bucket int, keys binary, lines binary, parity binary"
STATE = "grp long, line long, kind int, edits int, path array<int>"


def hash_of(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def edits_allowed(longer, kind: int):
    """Of a pair, by the length of its longer sequence (a number or an array)."""
    return np.minimum(np.asarray(longer) // 10, MOST[kind])


def within(a, b, most: int) -> bool:
    """Whether the edit distance of two sequences is at most `most`: bit-parallel (Hyyro 2003) over the band of 2 * most + 1 diagonals.

    Bit d of the words stands for row j + d - most of column j. Equal ends are cut off first.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    start, least = 0, len(b)
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m, n = len(a), len(b)
    if m <= most:
        return True
    if not most:
        return False
    masks: dict = {}
    for i, symbol in enumerate(a):
        masks[symbol] = masks.get(symbol, 0) | 1 << i + most
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << width - 1
    up, down = full & ~((1 << most) - 1), 0  # vertical differences of column 0: +1 from row 0 on
    distance = most  # of row `most`, the band's lowest
    for j, symbol in enumerate(b):
        equal = masks.get(symbol, 0) >> j & full
        zero = ((((equal & up) + up) ^ up) | equal | down) & full
        right = down | (~(zero | up) & full)
        left = zero & up
        if not zero & top:
            distance += 1  # along the lowest diagonal
        shifted = zero >> 1
        up = left | (~(shifted | right) & full)
        down = shifted & right
        if distance > 3 * most + 1:
            return False
    # distance is that of row n + most in column n; go up to row m
    for d in range(width - 1, m - n + most, -1):
        bit = 1 << d
        # after the last column the words are moved by one: bit d is the step between diagonals d and d + 1
        distance -= 1 if up & (bit >> 1) else -1 if down & (bit >> 1) else 0
    return distance <= most


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Start and size of even segments, the longer ones last."""
    size, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        length = size + (i >= parts - longer)
        out.append((at, length))
        at += length
    return out


def probes(n: int, edits: int, shorter: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) at which a sequence of n symbols may hold a segment of one that is `shorter` by so many."""
    out = []
    for i, (p, size) in enumerate(segments(n - shorter, edits + 1)):
        low = max(p - i, p + shorter - (edits - i), 0)
        high = min(p + i, p + shorter + (edits - i), n - size)
        out += [(i, start, size) for start in range(low, high + 1)]
    return out


@lru_cache(100_000)
def key_places(n: int, kind: int) -> tuple[np.ndarray, ...]:
    """Start, size, salt, threshold and whether it's a probe, for each key of a sequence of n symbols.

    Its segments are indexed once for each threshold that a sequence as long or longer may probe with; it probes with its own.
    """
    rows = []
    for edits in range(1, MOST[kind] + 1):
        if any(edits_allowed(longer, kind) == edits for longer in range(n, n + edits + 1)):
            rows += [(p, size, edits, n, i, 0) for i, (p, size) in enumerate(segments(n, edits + 1))]
    edits = int(edits_allowed(n, kind))
    if edits:
        own = {r[:5] for r in rows}
        for shorter in range(min(edits, n - 1) + 1):
            found = [(p, size, edits, n - shorter, i) for i, p, size in probes(n, edits, shorter)]
            rows += [(*r, 1) for r in found if r not in own]
    table = np.array(rows, np.int64).reshape(-1, 6).T
    salt = mixed(((table[2] * 2 + kind) << 40 | table[3] << 4 | table[4]).astype(np.uint64) * np.uint64(INVERSE))
    return table[0], table[1], salt, table[2], table[5].astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Runs:
    """Hashes of any runs of a sequence of numbers, by differences of a running polynomial sum."""

    powers = np.ones((2, 1), np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if Runs.powers.shape[1] <= n:
            size = 1 << n.bit_length()
            factors = np.array([[MULTIPLIER], [INVERSE]], np.uint64).repeat(size, axis=1)
            factors[:, 0] = 1
            Runs.powers = np.cumprod(factors, axis=1, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols + np.uint64(1)) * Runs.powers[0, :n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return mixed((self.sums[starts + sizes] - self.sums[starts]) * Runs.powers[1, starts])


def sequences(lines: list[str]) -> list[tuple[Runs, np.ndarray, np.ndarray]]:
    """For characters and for words: hashes of runs, where each line begins, and its length."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    begins = np.cumsum(size) - size
    of_chars = Runs(chars.astype(np.uint64))
    blank = BLANK[np.minimum(chars, 0x3001)]
    first = ~blank
    first[1:] &= blank[:-1]
    starts_line = begins[size > 0]
    first[starts_line] = ~blank[starts_line]
    last = ~blank
    last[:-1] &= blank[1:]
    ends_line = starts_line + size[size > 0] - 1
    last[ends_line] = ~blank[ends_line]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    word_begins = np.searchsorted(starts, begins)
    word_size = np.searchsorted(starts, begins + size) - word_begins
    return [(of_chars, begins, size), (Runs(of_chars.hashes(starts, ends - starts)), word_begins, word_size)]


def line_keys(lines: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: the kind, keys (lowest bit 1 for a probe), and the row, threshold, start and size of each."""
    both = sequences(lines)
    n_words = both[WORDS][2]
    for kind, (runs, begins, size) in enumerate(both):
        there = np.flatnonzero(n_words < FEW_WORDS) if kind == CHARS else np.arange(len(lines))
        there = there[np.argsort(size[there], kind="stable")]
        bounds = np.flatnonzero(np.diff(size[there], prepend=-1))
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for a, b in zip(bounds, [*bounds[1:], len(there)]):
            start, length, salt, edits, probe = key_places(int(size[there[a]]), kind)
            if not len(start):
                continue
            rows = there[a:b]
            spots = (begins[rows][:, None] + start).ravel()
            key = mixed(runs.hashes(spots, np.tile(length, len(rows))) ^ np.tile(salt, len(rows)))
            for o, x in zip(out, (key & ~np.uint64(1) | np.tile(probe, len(rows)), np.repeat(rows, len(start)), np.tile(edits, len(rows)), np.tile(start, len(rows)), np.tile(length, len(rows)))):
                o.append(x)
        if out[0]:
            yield (kind, *map(np.concatenate, out))


def parities(lines: list[str]) -> np.ndarray:
    """A 32-bit word a line: for each class of characters whether their number is odd."""
    return np.packbits((class_counts(lines) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u4").ravel()


def class_counts(lines: list[str]) -> np.ndarray:
    """How many characters of each of 32 classes a line has; an edit changes their sum of differences by two at most."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = (chars * np.uint32(0x9E3779B1)) >> np.uint32(27)
    cell = np.repeat(np.arange(len(lines), dtype=np.int64) << 5, np.fromiter(map(len, lines), np.int64, len(lines))) + kind
    return np.bincount(cell, minlength=len(lines) << 5).astype(np.int16).reshape(-1, 32)


def word_counts(split: list[list[str]]) -> np.ndarray:
    """The same of 64 classes of words."""
    out = np.zeros((len(split), 64), np.int16)
    for i, words in enumerate(split):
        out[i] = np.bincount([hash(w) & 63 for w in words], minlength=64)
    return out


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def cut40(keys: np.ndarray) -> bytes:
    """The five highest bytes of each key, with the flag in the lowest bit."""
    kept = keys >> np.uint64(24) & ~np.uint64(1) | keys & np.uint64(1)
    return np.ascontiguousarray(kept.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def uncut40(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(1) & np.uint64(0x7FFFFF)) % np.uint64(buckets)).astype(np.int64)


def group_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What names a key below all buckets, without its flag."""
    return (bucket_of(keys, buckets).astype(np.uint64) << np.uint64(40) | keys >> np.uint64(25) << np.uint64(1)).astype(np.int64)


def some_lines(batches: Iterator[pa.RecordBatch], at: int, most_kept: int = 1 << 18) -> Iterator[list[str]]:
    """The distinct lines with more than white space, by slices; one that a task has met is passed over (after most_kept it forgets)."""
    met: set[int] = set()
    for batch in slices(batches, 1 << 20):
        lines = []
        for line in {line: None for text in batch.column(at).to_pylist() for line in lines_of(text)}:
            if line and not line.isspace() and (h := hash_of(line)) not in met:
                met.add(h)
                lines.append(line)
        if len(met) > most_kept:
            met.clear()
        if lines:
            yield lines


def key_rows(buckets: int, at: int):
    """Packed keys of lines; those of words have no parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in some_lines(batches, at):
            hashes = np.array([hash_of(x) for x in lines], np.uint64)
            for kind, key, row, *_ in line_keys(lines):
                parity = parities(lines) if kind == CHARS else None
                bucket = bucket_of(key, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                key, row = key[order], row[order]
                parts = [(cut40(key[a:b]), hashes[row[a:b]].tobytes(), b"" if parity is None else parity[row[a:b]].tobytes()) for a, b in zip(cuts[full], cuts[full + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(list(p), pa.binary()) for p in zip(*parts))], names=["bucket", "keys", "lines", "parity"])

    return run


def near_parity(parity: np.ndarray) -> np.ndarray:
    """Whether a line has another in the group whose parity is near."""
    out = np.zeros(len(parity), bool)
    for at in range(0, len(parity), 1024):
        near = np.bitwise_count(parity[at : at + 1024, None] ^ parity) <= 2 * MOST_CHARS
        out[at : at + 1024] = near.sum(axis=1) > 1
    return out


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, line, many: lines that share a key. Groups of up to CROWDED lines are named by their lines, so equal ones fall together; larger
    ones by their key, and have `many`. The rows come in order of bucket; one bucket is held at a time."""
    held, now = [[], [], []], None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held[0] and (bucket, bool(row[2])) != now:
                yield bucket_groups(now[0], held)
                held = [[], [], []]
            now = bucket, bool(row[2])
            for h, x in zip(held, row):
                h.append(x)
    if held[0]:
        yield bucket_groups(now[0], held)


def bucket_groups(bucket: int, columns: list[list[bytes]]) -> pa.RecordBatch:
    key, line = uncut40(b"".join(columns[0])), np.frombuffer(b"".join(columns[1]), np.uint64)
    parity = np.frombuffer(b"".join(columns[2]), np.uint32)
    order = np.argsort(key)
    starts, ends = changes(key[order] >> np.uint64(1))
    shared = (ends - starts > 1) & ((key[order[starts]] & np.uint64(1)) == 0)  # index keys come before probes
    order = order[np.repeat(shared, ends - starts)]
    key, line = key[order] >> np.uint64(1), line[order]
    order_of = np.lexsort((line, key))
    key, line = key[order_of], line[order_of]
    once = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])][: len(key)]  # a line once below a key
    key, line = key[once], line[once]
    if len(parity):
        near = np.zeros(len(key), bool)
        parity = parity[order][order_of][once]
        starts, ends = changes(key)
        two = starts[ends - starts == 2]
        near[two] = near[two + 1] = np.bitwise_count(parity[two] ^ parity[two + 1]) <= 2 * MOST_CHARS
        more = ends - starts > 2
        for a, b in zip(starts[more].tolist(), ends[more].tolist()):
            near[a:b] = near_parity(parity[a:b]) if b - a <= TILE else True
        key, line = key[near], line[near]
    starts, ends = changes(key)
    sizes = ends - starts
    name = np.add.reduceat(mixed(line), starts) if len(starts) else np.zeros(0, np.uint64)
    crowd = sizes > CROWDED
    name[crowd] = np.uint64(bucket << 40) | key[starts[crowd]] << np.uint64(1)
    kept = np.repeat(sizes > 1, sizes)
    return pa.RecordBatch.from_arrays([pa.array(signed(np.repeat(name, sizes)[kept])), pa.array(signed(line[kept])), pa.array(np.repeat(crowd, sizes)[kept])], names=["grp", "line", "many"])


def changes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return starts, np.r_[starts[1:], len(x)]


def crowd_places(buckets: int):
    """Rows (line, text, grps): where each line holds the crowded keys it is below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            hashes, lines, wanted = (batch.column(k).to_pylist() for k in range(3))
            mine = {(i, g) for i, grps in enumerate(wanted) for g in grps}
            rows = []
            for kind, key, row, edits, start, size in line_keys(lines):
                for i, g, e, p, n in zip(row.tolist(), group_of(key, buckets).tolist(), edits.tolist(), start.tolist(), size.tolist()):
                    if (i, g) in mine:
                        rows.append((g, hashes[i], kind, e, [p, n]))
            yield state_batch(rows)

    return run


def state_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["grp", "line", "kind", "edits", "path"])


def dealt_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (STATE, text, linked): new keys of what is left of each line without what its group has in common, in `grp`; `probe` and `last` beside.

    What is left of at most the threshold has no segments; it meets all that is near it in length below one last key.
    """
    digest = xxhash.xxh3_64_intdigest
    for batch in slices(batches, 2 << 20):
        rows, flags = [], []
        for grp, line, kind, edits, path, text, linked in zip(*(batch.column(k).to_pylist() for k in range(7))):
            rest = text if kind == CHARS else text.split()
            for p, n in zip(path[::2], path[1::2]):
                rest = rest[:p] + rest[p + n :]
            n, join = len(rest), (lambda s: s) if kind == CHARS else "\n".join
            spots = [(n, i, p, size, False) for i, (p, size) in enumerate(segments(n, edits + 1))] if n > edits else []
            have = {s[:4] for s in spots}
            for shorter in range(edits + 1):
                if n - shorter > edits:
                    spots += [(n - shorter, i, p, size, True) for i, p, size in probes(n, edits, shorter) if (n - shorter, i, p, size) not in have]
            for length, i, p, size, probe in spots:
                seed = digest(np.array([grp, length, i], np.int64).tobytes())
                rows.append((digest(join(rest[p : p + size]).encode("utf-8", "surrogatepass"), seed) - (1 << 63), line, kind, edits, [*path, p, size]))
                flags.append((linked, probe, False))
            if n <= 2 * edits:
                rows.append((digest(np.array([grp, -1], np.int64).tobytes()) - (1 << 63), line, kind, edits, path))
                flags.append((linked, n > edits, True))
        out = state_batch(rows)
        yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array([f[k] for f in flags], pa.bool_()) for k in range(3))], names=[*out.schema.names, "linked", "probe", "last"])


def beside_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (STATE, text, pivot, its text): whether each line is linked to its group's pivot, in place of the texts."""
    for batch in slices(batches, 2 << 20):
        columns = [batch.column(k) for k in range(5)]
        lines, texts, pivots, theirs = (batch.column(k).to_pylist() for k in (1, 5, 6, 7))
        met: dict[str, tuple] = {}
        for t in theirs:
            if t not in met:
                met[t] = parted(t)
        linked = [line == pivot or near(parted(t), met[p]) for line, t, pivot, p in zip(lines, texts, pivots, theirs)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(6), pa.array(linked)], names=[*batch.schema.names[:5], "pivot", "linked"])


def crowds_dealt(crowds: DataFrame, texts: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame] | None:
    """Of crowded keys (grp, line): the groups (grp, line) of bounded size into which they come apart, and the links (src, dst) to their pivots.

    None if there are no crowds. In each round the least line of a group is its pivot. Lines linked to the pivot need not be
    compared with one another; so what is dealt again are the groups with other lines, until no crowd has such.
    """
    if crowds.isEmpty():
        return None
    wanted = crowds.groupBy("line").agg(F.collect_set("grp").alias("grps"))  # as many as a line has keys, at most
    state = written(texts.join(wanted, "line").select("line", "text", "grps").mapInArrow(crowd_places(buckets), STATE), "crowd_places")
    groups, links = [], []
    while True:
        pivots = state.groupBy("grp").agg(F.min("line").alias("pivot"))
        pivots = pivots.join(texts.select(F.col("line").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
        both = state.join(texts, "line").join(pivots, "grp").select("grp", "line", "kind", "edits", "path", "text", "pivot", "pivot_text")
        state = written(both.mapInArrow(beside_pivot, STATE + ", pivot long, linked boolean"), "beside_pivot")
        links.append(state.where("linked and line <> pivot").select(F.col("line").alias("src"), F.col("pivot").alias("dst")))
        open_ = state.groupBy("grp").agg(F.min("linked").alias("done")).where("not done").select("grp")
        there = state.join(open_, "grp", "left_semi").join(texts, "line").select("grp", "line", "kind", "edits", "path", "text", "linked")
        dealt = written(there.mapInArrow(dealt_again, STATE + ", linked boolean, probe boolean, last boolean").distinct(), "dealt_again")
        sizes = dealt.groupBy("grp").agg(F.count("*").alias("n"), F.min("probe").alias("only_probes"), F.min("linked").alias("done")).where("n > 1 and not only_probes and not done")
        shared = written(dealt.join(sizes.select("grp", "n"), "grp"), "shared_again")
        tiles = F.ceil(F.col("n") / TILE).cast("long")
        small = shared.where(F.col("last") | (F.col("n") <= CROWDED)).select("grp", "line", F.pmod("line", tiles).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"))
        groups.append(small.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "line").distinct())
        state = written(shared.where(~F.col("last") & (F.col("n") > CROWDED)).select("grp", "line", "kind", "edits", "path"), "crowds")
        if state.isEmpty():
            return reduce(DataFrame.union, groups), reduce(DataFrame.union, links).distinct()


def filter_bits(lines: int) -> int:
    """For some 16 bits a line, up to 8 MB in all however many lines there are: more only let more through."""
    return min(FILTER_BITS, max(23, (16 * lines).bit_length()))


def bits_of(bits: int):
    """A bitmap of lines for each task, in parts of FILTER_PART bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, some = np.zeros(1 << bits - 3, np.uint8), False
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            some = True
        if some:
            yield parts_of({k: field[k * FILTER_PART : (k + 1) * FILTER_PART] for k in range(len(field) // FILTER_PART)})

    return run


def parts_of(fields: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(fields), pa.int32()), pa.array([x.tobytes() for x in fields.values()], pa.binary())], names=["part", "bits"])


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            field = fields.setdefault(part, np.zeros(FILTER_PART, np.uint8))
            field |= np.frombuffer(bits, np.uint8)
    if fields:
        yield parts_of(fields)


def bitmap(lines: DataFrame) -> np.ndarray:
    """Of the lines' highest bits; parts meet in one task each, and 64 of them, 8 MB, at most reach the driver."""
    bits = filter_bits(lines.count())
    field = np.zeros(1 << bits - 3, np.uint8)
    parts = lines.mapInArrow(bits_of(bits), "part int, bits binary").repartition("part").mapInArrow(united, "part int, bits binary")
    for part, data in parts.toLocalIterator():
        field[part * FILTER_PART : (part + 1) * FILTER_PART] = np.frombuffer(data, np.uint8)
    return field


def texts_of(docs: DataFrame, text_col: str, field: np.ndarray) -> DataFrame:
    """line, text of the lines that the bitmap lets through."""
    bound, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = bound.value
        bits = (8 * len(field)).bit_length() - 1
        for lines in some_lines(batches, at):
            hashes = np.array([hash_of(x) for x in lines], np.uint64)
            bit = hashes >> np.uint64(64 - bits)
            through = np.flatnonzero(field[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[through])), pa.array([lines[i] for i in through], pa.string())], names=["line", "text"])

    return docs.mapInArrow(run, "line long, text string")


def parted(text: str) -> tuple[str, list[str], set[str]]:
    words = text.split()
    return text, words, set(words)


def near(a: tuple, b: tuple) -> bool:
    """Whether two lines are linked. A word that only one of them has is an edit."""
    longer = max(len(a[1]), len(b[1]))
    most = int(edits_allowed(longer, WORDS))
    if most and abs(len(a[1]) - len(b[1])) <= most and len(a[2] - b[2]) <= most and len(b[2] - a[2]) <= most and within(a[1], b[1], most):
        return True
    return longer < FEW_WORDS and within(a[0], b[0], min(max(len(a[0]), len(b[0])) // 10, MOST_CHARS))


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst: stars of the classes of each group; rows come sorted by group."""
    group, lines, texts = None, [], []

    def star() -> None:
        n, root = len(texts), list(range(len(texts)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        parts = [parted(t) for t in texts]
        if many := n > 16:
            few = np.array([len(p[1]) < FEW_WORDS for p in parts])
            chars, words = class_counts(texts), word_counts([p[1] for p in parts])
        left = n - 1  # links still possible
        for i in range(n - 1):
            others = range(i + 1, n)
            if many:
                close = np.abs(words[i + 1 :] - words[i]).sum(axis=1) <= 2 * MOST_WORDS
                if few[i]:
                    close |= few[i + 1 :] & (np.abs(chars[i + 1 :] - chars[i]).sum(axis=1) <= 2 * MOST_CHARS)
                others = (np.flatnonzero(close) + i + 1).tolist()
            for j in others:
                a, b = find(i), find(j)
                if a != b and near(parts[i], parts[j]):
                    root[max(a, b)] = min(a, b)
                    left -= 1
            if not left:
                break
        for i in range(n):
            if (r := find(i)) != i:
                found[0].append(lines[i])
                found[1].append(lines[r])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["src", "dst"])

    found: tuple[list[int], list[int]] = [], []
    for batch in batches:
        for g, line, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if g != group:
                star()
                group, lines, texts = g, [], []
            if not lines or lines[-1] != line:  # sorted by line within the group: a line once
                lines.append(line)
                texts.append(text)
        yield out()
        found = [], []
    star()
    yield out()


def line_links(docs: DataFrame, n_lines: int, text_col: str = "text") -> DataFrame:
    """node, component for the distinct lines (64-bit hashes) that are near another."""
    spark = docs.sparkSession
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(least, n_lines * LINE_KEY_BYTES // BUCKET_BYTES))
    packed = docs.mapInArrow(key_rows(buckets, docs.columns.index(text_col)), KEYS)
    in_order = packed.repartition("bucket").sortWithinPartitions("bucket", F.length("parity") > 0)
    found = written(in_order.mapInArrow(members, "grp long, line long, many boolean").distinct(), "line_groups")
    texts = texts_of(docs, text_col, bitmap(found.select("line").distinct())).groupBy("line").agg(F.min("text").alias("text"))
    texts = written(texts, "line_texts")
    groups = found.where("not many").select("grp", "line")
    dealt = crowds_dealt(found.where("many").select("grp", "line"), texts, buckets)
    if dealt is not None:
        groups = groups.union(dealt[0])
    rows = groups.join(texts, "line").select("grp", "line", "text").repartition("grp").sortWithinPartitions("grp", "line")
    links = rows.mapInArrow(verified, "src long, dst long")
    return connected_components(links if dealt is None else links.union(dealt[1]))


def line_table(docs: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """The key columns, line_no (from 0), n_chars and line (hash), for lines with more than white space."""
    at = docs.columns.index(text_col)
    keys = [docs.columns.index(k) for k in key_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            row, number, size, hashes = [], [], [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                for k, line in enumerate(lines_of(text)):
                    if line and not line.isspace():
                        row.append(i)
                        number.append(k)
                        size.append(len(line))
                        hashes.append(hash_of(line))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(number, pa.int32()), pa.array(size, pa.int32()), pa.array(signed(np.array(hashes, np.uint64)))], names=[*key_cols, "line_no", "n_chars", "line"])

    more = [T.StructField("line_no", T.IntegerType()), T.StructField("n_chars", T.IntegerType()), T.StructField("line", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[k] for k in key_cols), *more]))


def first_places(lines: DataFrame, nodes: DataFrame, place) -> DataFrame:
    """line, place: the least place of each line's class."""
    own = written(lines.groupBy("line").agg(F.min(place).alias("place")), "own_places")
    classes = own.join(nodes.withColumnRenamed("node", "line"), "line")
    shared = written(classes.groupBy("component").agg(F.min("place").alias("least")), "class_places")
    moved = written(classes.select("line", "component").join(shared, "component").select("line", "least"), "moved")
    return written(own.join(moved, "line", "left").select("line", F.coalesce("least", "place").alias("place")), "first_places")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a line with more than white space: doc_id, line_no, n_chars, class_doc_id, class_line_no, kept.

    A class holds equal lines, and lines that a chain of links joins, each between lines that differ in at most a tenth of the longer one's words and
    MOST_WORDS words, or, of lines of fewer than FEW_WORDS words, in at most a tenth of its characters and MOST_CHARS
    characters. All such links are found. Its first line, by id (null ids first) and line number, is the class and is
    kept. Null, empty and blank texts have no such lines. Of repeated rows of one id and text all first lines are kept here, as
    they have the same place. Lines are told apart by 64-bit hashes. Only the id and the text are read, so names of
    other columns don't matter. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = written(line_table(docs, ["doc_id"]), "lines")
    places = first_places(lines, line_links(docs, lines.count()), F.struct("doc_id", "line_no"))
    placed = lines.join(places, "line")
    kept = F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("line_no") == F.col("place.line_no"))
    return placed.select("doc_id", "line_no", "n_chars", F.col("place.doc_id").alias("class_doc_id"), F.col("place.line_no").alias("class_line_no"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, same columns, without lines whose class has an earlier line; each class keeps its first.

    Classes are those of line_classes. Blank lines stay; a text of which nothing but dropped lines is left becomes empty; null texts stay
    null. Of repeated rows one keeps its lines. Other columns may have any names. An empty table stays empty.
    """
    row, drop = fresh(docs, "row", "drop")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keyed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(row).alias("row"))
    lines = written(line_table(keyed, ["id", "row"]), "lines")
    places = first_places(lines, line_links(keyed.select("text"), lines.count()), F.struct("id", "row", "line_no"))
    later = lines.join(places, "line").where((F.col("row") != F.col("place.row")) | (F.col("line_no") != F.col("place.line_no")))
    dropped = written(later.groupBy(F.col("row").alias(row)).agg(F.collect_list("line_no").alias(drop)), "dropped_lines")
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            texts = []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist()):
                if lost:
                    gone = set(lost)
                    text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
                texts.append(text)
            columns = [*batch.columns[:width]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    # by sorting at every size: a broadcast that only small inputs allow would hide what the join costs
    return rows.join(dropped.hint("merge"), row, "left").select(*docs.columns, drop).mapInArrow(run, docs.schema)
