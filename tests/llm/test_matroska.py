import hashlib
import random
import zlib

import pytest

from sparkloom.llm import matroska as m


@pytest.mark.parametrize("n", [64, 128, 511 * 64, 512 * 8 * 16 + 64, 200_000 // 64 * 64])
def test_round_trip(n):
    data = bytes(random.Random(n).randrange(256) for _ in range(n))
    f = m.mux(data)
    got = m.parse(f)
    assert got.error == "" and b"".join(f[p.begin : p.begin + p.length] for p in got.packets) == data
    at = 0
    for p in got.packets:
        assert p.track == 1 and p.timestamp_ns == at * 125_000
        at += p.length
    assert len(got.cues) == got.clusters == sum(f[c[2] : c[2] + 4] == m._id(m.CLUSTER) for c in got.cues)
    assert got.duration_ns == n * 125_000
    if n > 4096:
        assert {p.lacing for p in got.packets} >= {1, 2, 3}


@pytest.mark.parametrize("kind", [1, 3])
def test_lacing_of_uneven_frames(kind):
    frames = [b"a" * n for n in (0, 1, 254, 255, 256, 700, 20_000, 3, 510, 9)]
    block = b"\x81\x00\x05" + bytes([kind << 1]) + m.lace(frames, kind)
    got = m._block(block, 0, len(block), 10, 1_000_000, True, 0)
    assert [p.length for p in got] == [len(x) for x in frames] and {p.timestamp_ns for p in got} == {15_000_000} and not got[0].keyframe


def test_block_groups_and_unknown_sizes():
    entry = m.element(m.TRACK_ENTRY, m._uint(m.TRACK_NUMBER, 3) + m._uint(m.TRACK_TYPE, 1) + m.element(m.CODEC_ID, b"V_X"))
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x83\xff\xff\x00frame") + m.element(m.REFERENCE, b"\x01"))
    open_cluster = lambda t, body: m._id(m.CLUSTER) + b"\x01" + b"\xff" * 7 + m._uint(m.CLUSTER_TIME, t) + body
    f = m.element(m.EBML, b"") + m._id(m.SEGMENT) + b"\xff" + m.element(m.TRACKS, entry) + open_cluster(7, group) + open_cluster(9, m.element(m.SIMPLE_BLOCK, b"\x83\x00\x00\x80key")) + m.element(0xEC, b"void")
    got = m.parse(f)
    assert got.error == "" and got.clusters == 2 and got.tracks[3]["codec"] == "V_X"
    assert [(p.track, p.timestamp_ns, p.keyframe, f[p.begin : p.begin + p.length]) for p in got.packets] == [(3, 6_000_000, False, b"frame"), (3, 9_000_000, True, b"key")]


def test_damage_never_raises():
    f = m.mux(b"x" * 64 * 300)
    rnd = random.Random(0)
    for cut in [0, 1, 5, 60, 200, len(f) // 2, len(f) - 1]:
        assert m.parse(f[:cut]).error
    for _ in range(300):
        b = bytearray(f)
        for _ in range(5):
            b[rnd.randrange(len(b))] = rnd.randrange(256)
        m.parse(bytes(b))


def test_queries_and_packet_table(spark):
    rows = [(1, "héllo", "x"), (2, None, None), (3, "", "x"), (4, "y" * 300_000, "x"), (1, "héllo", None), (None, "z", None)]
    out = m.media_columns(spark.createDataFrame(rows, "doc_id long, text string, feature string")).collect()
    for r, (i, t, _) in zip(out, rows, strict=True):
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(m.mux(padded)).hexdigest() and r.media_bytes == len(m.mux(padded))
    files = spark.createDataFrame([(1, bytearray(m.mux(b"q" * 640)), "c"), (2, None, "c"), (3, bytearray(b"GIF89a"), "c")], "id long, content binary, packet string")
    got = m.packet_table(files, "id", "content").collect()
    assert sum(r.length or 0 for r in got if r.id == 1) == 640
    assert {r.id for r in got if r.error} == {2, 3}
    assert m.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_features_against_plain_loops_and_large_ids(spark):
    import math

    far = (1 << 62) + 1
    texts = {far: "héllo wörld " * 40, None: "x", far + 2: "", far + 4: "\x00\xff" * 700}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in m.media_columns(df).collect()}
    assert out.keys() == texts.keys()
    for i, t in texts.items():
        raw = t.encode()
        samples = [b - 128 for b in raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))]
        f = dict(p.split("=") for p in out[i].feature.split(";"))
        assert f["mean"] == f"{sum(samples) / len(samples):.4f}" and f["rms"] == f"{math.sqrt(sum(s * s for s in samples) / len(samples)):.4f}"
        assert int(f["crossings"]) == sum((a >= 0) != (b >= 0) for a, b in zip(samples, samples[1:]))


def test_durations_time_laced_frames_and_cues_point_into_clusters():
    entry = m.element(m.TRACK_ENTRY, m._uint(m.TRACK_NUMBER, 2) + m._uint(m.TRACK_TYPE, 1) + m._uint(m.DEFAULT_DURATION, 40_000_000) + m.element(m.CODEC_ID, b"V_X"))
    laced = b"\x82\x00\x01\x04" + m.lace([b"ab", b"cd", b"ef"], 2)
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, laced) + m._uint(m.BLOCK_DURATION, 30))
    plain = m.element(m.SIMPLE_BLOCK, laced)
    cluster = m.element(m.CLUSTER, m._uint(m.CLUSTER_TIME, 100) + group + plain)
    cue = m.element(m.CUES, m.element(m.CUE_POINT, m._uint(m.CUE_TIME, 101) + m.element(m.CUE_POSITIONS, m._uint(m.CUE_TRACK, 2) + m._uint(m.CUE_CLUSTER, len(entry) + 7) + m._uint(m.CUE_RELATIVE, 4) + m._uint(m.CUE_BLOCK, 2))))
    f = m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.TRACKS, entry) + cluster + cue)
    got = m.parse(f)
    assert got.error == "" and [p.timestamp_ns for p in got.packets] == [101_000_000 + k * 10_000_000 for k in range(3)] + [101_000_000 + k * 40_000_000 for k in range(3)]
    assert got.cues[0][0] == 101_000_000 and got.cues[0][1] == 2 and got.cues[0][3:] == (4, 2)
