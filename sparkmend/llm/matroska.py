"""Media columns: Matroska.

The demuxer walks EBML elements (variable-length ids and sizes, unknown sizes, void and foreign elements),
clusters, simple blocks and block groups with all four kinds of lacing, and cues, and gives tables of packets, tracks and
cues. A frame of a lace has its own timestamp, by the track's default duration or else the group's duration; a frame of a group is a
key frame if the group refers to no other. The muxer stores a payload as 8-bit samples, so texts go through real files and come back byte for byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkmend.llm.columns import keyed_text, slices

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID, AUDIO = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1
REFERENCE_BLOCK, BLOCK_DURATION, DEFAULT_DURATION = 0xFB, 0x9B, 0x23E383
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, DOC_TYPE, MUXING_APP = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0x4282, 0x4D80
MASTERS = {SEGMENT, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, INFO, EBML}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, RATE, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 192, 8000, 8, 32
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PACKETS = "doc_id long, packet int, track int, cluster int, timestamp long, keyframe boolean, offset long, size long"
TRACKS_OF = "doc_id long, track int, type int, codec string, rate double, channels int, bits int, default_duration long"
CUES_OF = "doc_id long, cue int, track int, timestamp long, cluster_offset long, first_packet int"


class Packet(NamedTuple):
    track: int
    cluster: int
    timestamp: int
    keyframe: bool
    offset: int
    size: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]  # timestamp, track, byte offset of the cluster in the file
    scale: int
    duration: float | None
    clusters: dict[int, int]  # first packet by byte offset of the cluster

    def sought(self, timestamp: int, track: int) -> int:
        """The packet to start reading at for a time: the first of the cluster that the last cue at or before it names (0 without one)."""
        before = [c for c in self.cues if c[1] == track and c[0] <= timestamp]
        return self.clusters.get(max(before)[2], 0) if before else 0


def size_code(n: int) -> bytes:
    """The shortest code of a size; all ones would mean an unknown one."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_code(len(data)) + data


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The part of a block behind its flags."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING:
        head += size_code(len(frames[0]))
        for a, b in zip(frames[:-2], frames[1:-1]):
            diff, length = len(b) - len(a), 1
            while abs(diff) >= (1 << 7 * length - 1) - 1:
                length += 1
            head += (diff + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


def block(frames: list[bytes], track: int, relative: int, lacing: int) -> bytes:
    return size_code(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + laced(frames, lacing)


HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
TRACK = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def mux(frames: list[bytes], lacing: int = FIXED, frames_a_block: int = FRAMES_A_BLOCK) -> bytes:
    """A file of one 8-bit audio track. Frames of unequal size need another lacing than FIXED."""
    per_block = frames_a_block if lacing else 1
    ms = FRAME * 1000 // RATE
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * ms))) + element(MUXING_APP, b"sparkmend"))
    body, cues = [info, TRACK], []
    at = len(info) + len(TRACK)
    per_cluster = per_block * BLOCKS_A_CLUSTER
    for c in range(0, len(frames), per_cluster):
        data = [number(TIMESTAMP, c * ms)]
        for b in range(c, min(c + per_cluster, len(frames)), per_block):
            some = frames[b : min(b + per_block, c + per_cluster)]
            data.append(element(SIMPLE_BLOCK, block(some, 1, (b - c) * ms, lacing if len(some) > 1 else NO_LACING)))
        cluster = element(CLUSTER, b"".join(data))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * ms) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return HEAD + element(SEGMENT, b"".join(body))


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, position behind it, and whether all its bits are ones."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at {at}")
    length = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + length], "big")
    if at + length > len(data):
        raise ValueError("the file ends inside a number")
    bare = value & (1 << 7 * length) - 1
    return (value if keep_marker else bare), at + length, bare == (1 << 7 * length) - 1


def frames_of(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges (offset, size) of a block's frames."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        each, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed-size lacing doesn't divide the block")
        return [(at + i * each, each) for i in range(n)]
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at, _ = vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            raw, at, _ = vint(data, at)
            sizes.append(sizes[-1] + raw - ((1 << 7 * (at - before) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing exceeds the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> Media:
    """Packets with their byte ranges, tracks and cues. A damaged file raises ValueError."""
    packets: list[Packet] = []
    tracks: dict[int, dict] = {}
    cues: list[tuple[int, int, int]] = []
    clusters: dict[int, int] = {}
    facts = {"scale": 1_000_000, "duration": None, "clock": 0, "cluster": -1, "segment": 0}

    def add(at: int, end: int, keyframe: bool | None, duration: int | None) -> None:
        track, at, _ = vint(data, at)
        relative, flags = struct.unpack_from(">hB", data, at)
        frames = frames_of(data, at + 3, end, flags >> 1 & 3)
        each = tracks.get(track, {}).get(DEFAULT_DURATION, 0) / facts["scale"] or (duration or 0) / len(frames)
        for i, (offset, size) in enumerate(frames):
            packets.append(Packet(track, facts["cluster"], facts["clock"] + relative + int(i * each), bool(flags & 0x80) if keyframe is None else keyframe, offset, size))

    def walk(at: int, end: int, parent: int, into: dict) -> int:
        while at < end:
            kind, start, _ = vint(data, at, True)
            size, start, unknown = vint(data, start)
            if parent == CLUSTER and into.get("open") and kind in TOP_LEVEL:
                return at  # ends a cluster of unknown size
            stop = end if unknown else start + size
            if stop > end:
                raise ValueError(f"element {kind:x} exceeds its parent")
            if kind == SIMPLE_BLOCK:
                add(start, stop, None, None)
            elif kind == BLOCK:
                into["block"] = start, stop
            elif kind == CLUSTER:
                facts["cluster"] += 1
                facts["clock"] = 0
                clusters[at] = len(packets)
                stop = walk(start, stop, CLUSTER, {"open": unknown})
            elif kind in MASTERS:
                found: dict = into if kind == AUDIO else {}
                if kind == SEGMENT:
                    facts["segment"] = start
                walk(start, stop, kind, found)
                if kind == BLOCK_GROUP and "block" in found:
                    add(*found["block"], REFERENCE_BLOCK not in found, found.get(BLOCK_DURATION))
                elif kind == TRACK_ENTRY:
                    tracks[found.get(TRACK_NUMBER, len(tracks) + 1)] = found
                elif kind == CUE_POINT:
                    cues.extend((found.get(CUE_TIME, 0), t, facts["segment"] + p) for t, p in found.get("at", []))
                elif kind == CUE_TRACK_POSITIONS:
                    into.setdefault("at", []).append((found.get(CUE_TRACK, 0), found.get(CUE_CLUSTER_POSITION, 0)))
            elif kind in (SAMPLING_FREQUENCY, DURATION):
                value = struct.unpack(">d" if size == 8 else ">f", data[start:stop])[0]
                into[kind] = value
                if kind == DURATION:
                    facts["duration"] = value
            elif kind == CODEC_ID:
                into[kind] = data[start:stop].decode()
            elif kind != VOID and size <= 8:
                into[kind] = value = int.from_bytes(data[start:stop], "big")
                if kind == TIMESTAMP and parent == CLUSTER:
                    facts["clock"] = value
                elif kind == TIMESTAMP_SCALE:
                    facts["scale"] = value
            at = stop
        return at

    walk(0, len(data), 0, {})
    return Media(packets, tracks, cues, facts["scale"], facts["duration"], clusters)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


def stored(payload: bytes) -> bytes:
    return mux([payload[i : i + FRAME] for i in range(0, len(payload), FRAME)])


def feature_row(text: str | None) -> tuple:
    n, payload = padded(text)
    media = stored(payload)
    found = demux(media)
    back = b"".join(media[p.offset : p.offset + p.size] for p in found.packets)
    audio = found.tracks[1]
    last = found.packets[-1]
    rising = sum(b > a for a, b in zip(back[:-1:64], back[1::64]))
    feature = f"{audio[CODEC_ID]};rate={audio[SAMPLING_FREQUENCY]:.0f};bits={audio[BIT_DEPTH]};packets={len(found.packets)};clusters={last.cluster + 1};cues={len(found.cues)};ms={found.duration:.0f};last_ts={last.timestamp};mean={sum(back) / len(back):.4f};peak={max(back)};rising={rising}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as a Matroska file of 8-bit samples, reads it back and gives its features.

    A null or empty text is one frame of blanks. Equal texts have equal values in all columns but doc_id.
    Null and repeated ids stay, a row each; other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in slices(batches):
            columns = zip(*map(feature_row, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, FEATURES)


def table_of(media: DataFrame, ddl: str, rows_of: Callable[[Media], list[tuple]], id_col: str, media_col: str) -> DataFrame:
    """Rows of each file behind its id; a null, empty or damaged file has none. Null and repeated ids stay; other columns are not read."""
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in slices(batches):
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(key, *r) for r in rows_of(demux(data or b""))]
                except (ValueError, IndexError, struct.error):
                    continue
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(columns, kinds)], schema=kinds)

    return media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].cast("binary").alias("media")).mapInArrow(run, schema)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a packet of binary media files: track, cluster, timestamp in the file's ticks, key frame, byte range. Edge cases as in table_of."""
    return table_of(media, PACKETS, lambda m: [(i, *p) for i, p in enumerate(m.packets)], id_col, media_col)


def track_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a track: number, type, codec, and what it has of rate, channels, bits and default duration (nanoseconds). Edge cases as in table_of."""
    fields = (TRACK_TYPE, CODEC_ID, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION)
    return table_of(media, TRACKS_OF, lambda m: [(n, *(t.get(f) for f in fields)) for n, t in sorted(m.tracks.items())], id_col, media_col)


def cue_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a cue: its track and time, where in the file its cluster begins, and that cluster's first packet (null if there is no cluster). Edge cases as in table_of."""
    return table_of(media, CUES_OF, lambda m: [(i, track, at, offset, m.clusters.get(offset)) for i, (at, track, offset) in enumerate(m.cues)], id_col, media_col)
