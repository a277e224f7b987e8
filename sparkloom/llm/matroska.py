"""Matroska as columns: a byte-level EBML writer for raw 8-bit audio and a parser into packet tables.

The parser walks variable-length element ids and sizes, unknown sizes included, reads SimpleBlocks and BlockGroups with
no, Xiph, fixed-size and EBML lacing, and gives for each packet its track, timestamp, keyframe flag and byte range, and
the cue points with their cluster positions. It reads one file's bytes at a time and no other file of the batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, table

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE, CUE_BLOCK = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0, 0x5378
DEFAULT_DURATION = 0x23E383
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
DOC_TYPE, DOC_VERSION, READ_VERSION, MAX_ID, MAX_SIZE, EBML_VERSION, EBML_READ = 0x4282, 0x4287, 0x4285, 0x42F2, 0x42F3, 0x4286, 0x42F7

RATE = 8000


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _vint(n: int, width: int = 0) -> bytes:
    """A size as an EBML variable-length integer; all ones in a width mean unknown and are passed over."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, payload: bytes, width: int = 0) -> bytes:
    """An element: its id, its size (in ``width`` bytes if given) and its payload."""
    return _id(ident) + _vint(len(payload), width) + payload


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """A block's payload from its flags' lacing on: kind 0 none, 1 Xiph, 2 fixed-size, 3 EBML."""
    if kind == 0:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += _vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += _vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(samples: bytes, frame: int = 512, frames_per_block: int = 8, blocks_per_cluster: int = 16, rate: int = RATE) -> bytes:
    """8-bit unsigned PCM samples as one audio track; blocks take each lacing in turn, every cluster has a cue."""
    head = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(READ_VERSION, 2))
    scale = 1_000_000_000 // rate  # one tick a sample
    audio = element(AUDIO, element(SAMPLING, np.array(rate, ">f8").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    body = [
        element(INFO, _uint(TIMESTAMP_SCALE, scale) + element(DURATION, np.array(len(samples), ">f8").tobytes())),
        element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)),
    ]
    at, cues, number = sum(map(len, body)), [], 0
    per_block = frame * frames_per_block
    per_cluster = min(blocks_per_cluster * per_block, 32768 // per_block * per_block or per_block)
    for c in range(0, len(samples), per_cluster):
        blocks = [_uint(CLUSTER_TIME, c)]
        for b in range(c, min(c + per_cluster, len(samples)), per_block):
            part = samples[b : b + per_block]
            frames = [part[i : i + frame] for i in range(0, len(part), frame)]
            kind = (1, 2, 3)[number % 3] if len(frames) > 1 else 0
            if kind == 2 and len(frames[-1]) != frame:
                kind = 3
            number += 1
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + (b - c).to_bytes(2, "big") + bytes([0x80 | kind << 1]) + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, c) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body), 8)


class Packet(NamedTuple):
    """One frame: its track, time, flags and byte range."""
    track: int
    timestamp_ns: int
    keyframe: bool
    lacing: int
    begin: int
    length: int


class Media(NamedTuple):
    """What a file holds."""
    packets: list[Packet]
    cues: list[tuple[int, int, int, int, int]]  # time in ns, track, byte of the cluster, block's byte in it (-1: not said), block's number in it
    tracks: dict[int, dict]
    duration_ns: int
    clusters: int
    error: str  # empty, or what ended the walk early


def _read_vint(b: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, next byte, width; value -1 is an unknown size."""
    if at >= end or not b[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - b[at].bit_length()
    if at + width > end:
        raise ValueError(f"integer cut short at byte {at}")
    n = int.from_bytes(b[at : at + width], "big")
    if keep:
        return n, at + width, width
    n &= (1 << 7 * width) - 1
    return -1 if n == (1 << 7 * width) - 1 else n, at + width, width


def _block(b: bytes, at: int, end: int, cluster_time: int, scale: int, simple: bool, step_ns: int, key: bool = True, frame_ns: int = 0, block_ns: int = 0) -> list[Packet]:
    """The packets of one block. Laced frames share the block's duration where it is known, else each takes ``frame_ns`` where that
    is known, else ``step_ns`` a byte."""
    track, at, _ = _read_vint(b, at, end)
    if at + 3 > end:
        raise ValueError(f"block cut short at byte {at}")
    rel, flags = int.from_bytes(b[at : at + 2], "big", signed=True), b[at + 2]
    at, kind = at + 3, flags >> 1 & 3
    sizes = [end - at]
    if kind:
        n, at = b[at] + 1, at + 1
        if kind == 2:
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for i in range(n - 1):
                if kind == 1:
                    size = 0
                    while True:
                        size, at = size + b[at], at + 1
                        if b[at - 1] != 255:
                            break
                else:
                    v, at, width = _read_vint(b, at, end)
                    size = v if i == 0 else sizes[-1] + v - ((1 << 7 * width - 1) - 1)
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
        if min(sizes) < 0 or sum(sizes) != end - at:
            raise ValueError(f"lace sizes do not fit at byte {at}")
    key = bool(flags & 0x80) if simple else key
    out, when = [], (cluster_time + rel) * scale
    for k, size in enumerate(sizes):
        since = block_ns * k // len(sizes) if block_ns else frame_ns * k
        out.append(Packet(track, when + since, key, kind, at, size))
        at += size
        when += 0 if block_ns or frame_ns else step_ns * size
    return out


def parse(b: bytes | None) -> Media:
    """All packets and cues of one file. A damaged file gives what stood before the damage, and says so in ``error``."""
    packets: list[Packet] = []
    cues, tracks, state = [], {}, {"scale": 1_000_000, "duration": 0.0, "clusters": 0, "segment": 0, "time": 0}
    if not b:
        return Media(packets, cues, tracks, 0, 0, "empty")

    def pace(at: int) -> tuple[int, int]:
        """Nanoseconds a byte and a frame of the track of the block at ``at``."""
        t = tracks.get(_read_vint(b, at, len(b))[0], {})
        return int(8e9 / (t["bits"] * t["rate"])) if t.get("bits") and t.get("rate") and t["codec"].startswith("A_PCM") else 0, t.get("frame_ns", 0)

    def walk(at: int, end: int, parent: int, own: dict) -> int:
        while at < end:
            ident, after, _ = _read_vint(b, at, end, keep=True)
            if parent in (CLUSTER, SEGMENT) and own.get("open") and (ident in TOP and parent == CLUSTER or ident in (EBML, SEGMENT)):
                return at  # an element of unknown size ends where one of a higher level begins
            size, data, _ = _read_vint(b, after, end)
            if size < 0 and ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown size at byte {at}")
            stop = end if size < 0 else data + size
            if stop > end:
                raise ValueError(f"element at byte {at} runs past its parent")
            if ident in MASTERS:
                inner = {"open": size < 0}
                if ident == SEGMENT:
                    state["segment"] = data
                elif ident == CLUSTER:
                    state["clusters"] += 1
                at = walk(data, stop, ident, inner)
                if ident == TRACK_ENTRY:
                    tracks[inner.get(TRACK_NUMBER, 0)] = {"type": inner.get(TRACK_TYPE, 0), "codec": inner.get(CODEC_ID, b"").decode("latin-1"), "rate": inner.get("rate", 0.0), "bits": inner.get("bits", 0), "frame_ns": inner.get(DEFAULT_DURATION, 0)}
                elif ident == AUDIO:
                    own["rate"] = float(np.frombuffer(inner[SAMPLING], f">f{len(inner[SAMPLING])}")[0]) if len(inner.get(SAMPLING, b"")) in (4, 8) else 8000.0
                    own["bits"] = inner.get(BIT_DEPTH, 0) * inner.get(CHANNELS, 1)
                elif ident == BLOCK_GROUP and BLOCK in inner:
                    step, frame = pace(inner[BLOCK][0])
                    packets.extend(_block(b, *inner[BLOCK], state["time"], state["scale"], False, step, REFERENCE not in inner, frame, inner.get(BLOCK_DURATION, 0) * state["scale"]))
                elif ident == CUE_POSITIONS:
                    own.setdefault("at", []).append((inner.get(CUE_TRACK, 0), state["segment"] + inner.get(CUE_CLUSTER, 0), inner.get(CUE_RELATIVE, -1), inner.get(CUE_BLOCK, 1)))
                elif ident == CUE_POINT:
                    cues.extend((inner.get(CUE_TIME, 0) * state["scale"], *where) for where in inner.get("at", []))
                continue
            if ident == SIMPLE_BLOCK:
                step, frame = pace(data)
                packets.extend(_block(b, data, stop, state["time"], state["scale"], True, step, True, frame))
            elif ident == BLOCK:
                own[BLOCK] = (data, stop)
            elif ident in (CODEC_ID, SAMPLING, DOC_TYPE):
                own[ident] = b[data:stop]
            elif ident == DURATION:
                state["duration"] = float(np.frombuffer(b[data:stop], f">f{size}")[0]) if size in (4, 8) else 0.0
            elif size <= 8:
                own[ident] = n = int.from_bytes(b[data:stop], "big")
                if ident == TIMESTAMP_SCALE:
                    state["scale"] = n
                elif ident == CLUSTER_TIME:
                    state["time"] = n
            at = stop
        return at

    error = ""
    try:
        walk(0, len(b), 0, {})
    except (ValueError, IndexError) as e:
        error = str(e) or "cut short"
    return Media(packets, cues, tracks, int(state["duration"] * state["scale"]), state["clusters"], error)


PACKETS = "id long, packet int, track int, timestamp_ns long, keyframe boolean, lacing int, begin long, length long, error string"


def packet_table(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Rows (id, packet, track, timestamp_ns, keyframe, lacing, begin, length, error) of every file in a binary column.

    A null, empty or foreign file gives one row with a null packet and its error; a damaged one gives its packets
    before the damage, then such a row. Repeated rows are parsed as often as they come; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows: list[tuple] = []
            for i, content in zip(f["id"], f["content"], strict=True):
                m = parse(content)
                rows += [(i, k, p.track, p.timestamp_ns, p.keyframe, p.lacing, p.begin, p.length, None) for k, p in enumerate(m.packets)]
                if m.error or not m.packets:
                    rows.append((i, None, None, None, None, None, None, None, m.error or "no packets"))
            yield pd.DataFrame(rows, columns=["id", "packet", "track", "timestamp_ns", "keyframe", "lacing", "begin", "length", "error"]).astype({c: "Int64" for c in ("packet", "track", "timestamp_ns", "lacing", "begin", "length")} | {"keyframe": "boolean"})

    rows = files.select(as_text(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"))
    return as_long(rows.mapInPandas(run, PACKETS.replace("id long", "id string", 1)), "id")


def features(m: Media, payload: bytes) -> str:
    """Counts of the file's parts, its length in milliseconds, and the samples' mean, root mean square and zero crossings."""
    a = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    crossings = int(np.count_nonzero((a[1:] >= 0) != (a[:-1] >= 0)))
    laced = sum(p.lacing > 0 for p in m.packets)
    return f"packets={len(m.packets)};laced={laced};clusters={m.clusters};cues={len(m.cues)};ms={m.duration_ns // 1_000_000};mean={a.mean(dtype=np.float64):.4f};rms={np.sqrt(np.mean(a * a, dtype=np.float64)):.4f};crossings={crossings}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of digests and features, one for each row of ``docs``.

    The text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are stored as the samples of a Matroska
    file; everything but n_bytes is computed from that file's bytes, parsed back. Null and empty texts are 64 zero
    bytes. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows = []
            for i, t in zip(f["id"], f["text"], strict=True):
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                stored = mux(raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)))
                m = parse(stored)
                back = b"".join([stored[p.begin : p.begin + p.length] for p in m.packets])
                rows.append((i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(m, back)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    rows = docs.select(as_text(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return as_long(rows.mapInPandas(run, COLUMNS.replace("doc_id long", "doc_id string")), "doc_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of all documents, stored as media."""
    return media_columns(table(spark, sf_dir, "documents"))
