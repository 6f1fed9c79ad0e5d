"""The Matroska reader on synthetic bytes."""

import struct

import pytest

from framelode.sources import mkv
from framelode.sources.mp4 import Malformed


def number(n):
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def el(kind, *parts):
    body = b"".join(parts)
    return number(kind) + struct.pack(">Q", len(body) | 1 << 56) + body


def entry(track, kind, codec, *more):
    return el(0xAE, el(0xD7, number(track)), el(0x83, number(kind)), el(0x86, codec.encode()), *more)


def block(track, relative, flags, body):
    return bytes([0x80 | track]) + struct.pack(">hB", relative, flags) + body


def movie(*clusters, scale=1_000_000):
    info = el(mkv.INFO, el(0x2AD7B1, number(scale)), el(0x4489, struct.pack(">d", 2000.0)))
    strip = el(0x6D80, el(0x6240, el(0x5034, el(0x4254, b"\3"), el(0x4255, b"ab"))))
    entries = el(
        mkv.TRACKS_ID,
        entry(1, 1, "V_MPEG4/ISO/AVC", el(0x23E383, number(40_000_000)), el(0xE0, el(0xB0, number(640)), el(0xBA, number(360)))),
        entry(2, 2, "A_AAC/MPEG4", el(0x22B59C, b"ger"), el(0x22B59D, b"de"), el(0xE1, el(0xB5, struct.pack(">f", 44100.0)), el(0x9F, b"\2")), strip),
        entry(3, 17, "S_TEXT/UTF8", el(0x88, b"\0"), el(0x6D80, el(0x6240, el(0x5034)))),
        entry(4, 1, "V_VP9"),
        entry(5, 2, "A_FLAC", el(0x6D80, el(0x6240, el(0x5034, el(0x4254, b"\1"))))),
    )
    seek = lambda at: el(mkv.SEEK_HEAD, el(0x4DBB, el(0x53AB, number(mkv.CUES)), el(0x53AC, at.to_bytes(4, "big"))))
    at = len(seek(0)) + len(info) + len(entries) + sum(map(len, clusters))
    first = len(seek(0)) + len(info) + len(entries)
    place = lambda track, to: el(0xB7, el(0xF7, number(track)), el(0xF1, number(to)))
    cues = el(mkv.CUES, el(0xBB, el(0xB3, number(90)), place(2, 1), place(1, 7)), el(0xBB, el(0xB3, number(40)), place(1, first), place(1, 9)), el(0xBB, el(0xB3, b"\1"), place(2, 3)))
    return el(mkv.EBML) + el(mkv.SEGMENT, seek(at), info, entries, *clusters, cues)


CLUSTER = el(
    mkv.CLUSTER,
    el(0xE7, number(1000)),
    el(0xA3, block(1, -10, 0x80, b"VVVV")),
    el(0xA3, block(1, 30, 0, b"vv")),
    el(0xA0, el(0xA1, block(2, 0, 2, bytes([2, 255, 3, 1]) + b"x" * 258 + b"y" + b"z" * 5)), el(0x9B, number(60))),
    el(0xA0, el(0xA1, block(1, 70, 0, b"v")), el(0xFB, b"\1")),
    el(0xA3, block(9, 0, 6, b"")),
)


def test_tracks(spark):
    files = spark.createDataFrame([("a.mkv", bytearray(movie(CLUSTER))), ("b.mkv", bytearray(b"none")), ("c.mkv", None)], "path string, content binary")
    got = {(r.path, r.track_id): r for r in mkv.tracks(files).collect()}
    assert sorted(k for k in got if k[1]) == [("a.mkv", 1), ("a.mkv", 2), ("a.mkv", 3)]
    video, sound, text = (got["a.mkv", i] for i in (1, 2, 3))
    assert (video.codec, video.width, video.height, video.duration_us, video.default) == ("h264", 640, 360, 2_000_000, True)
    assert (sound.codec, sound.language, sound.sample_rate, sound.channels, sound.encoding, bytes(sound.stripped)) == ("aac", "de", 44100, 2, "strip", b"ab")
    assert (text.codec, text.default, text.encoding) == ("subrip", False, "zlib")
    assert got["b.mkv", None].error and got["c.mkv", None].error


def test_frames_and_cues(spark):
    data = movie(CLUSTER)
    files = spark.createDataFrame([("a.mkv", bytearray(data)), ("b.mkv", bytearray(b"none"))], "path string, content binary")
    rows = sorted(mkv.frames(files).collect(), key=lambda r: (r.track_id, r.idx))
    assert [(r.track_id, r.idx, r.size, r.pts, r.duration, r.sync) for r in rows] == [
        (1, 0, 4, 990_000, 40_000, True),
        (1, 1, 2, 1_030_000, 40_000, False),
        (1, 2, 1, 1_070_000, 40_000, False),
        (2, 0, 258, 1_000_000, 20_000, True),
        (2, 1, 1, 1_020_000, 20_000, True),
        (2, 2, 5, 1_040_000, 20_000, True),
    ]
    assert [data[r.offset : r.offset + r.size] for r in rows if r.track_id == 1] == [b"VVVV", b"vv", b"v"]
    cues = mkv.cue_points(files).collect()
    assert [r.time_us for r in cues] == [40_000, 90_000]
    assert data[cues[0].offset :].startswith(number(mkv.CLUSTER))


def test_laces():
    assert mkv.laces(b"abc", 0, 3, 0) == [(0, 3)]
    assert mkv.laces(bytes([1]) + b"aabb", 0, 5, 2) == [(1, 2), (3, 2)]
    # 3, then 3 + (61 - 63) = 1, then the rest
    assert mkv.laces(bytes([2, 0x83, 0x80 | 61]) + b"aaabcc", 0, 9, 3) == [(3, 3), (6, 1), (7, 2)]
    for damaged, mode in ((b"", 1), (bytes([1, 255]), 1), (bytes([1]) + b"abc", 2), (bytes([1, 0x89]) + b"a", 3), (bytes([2, 0x81, 0x80]) + b"a", 3)):
        with pytest.raises(Malformed):
            mkv.laces(damaged, 0, len(damaged), mode)


def test_damage():
    whole = movie(CLUSTER)
    assert len(list(mkv.parse(whole)[2])) == 6
    cut = whole[: whole.index(b"vv") + 2]  # the segment and its cluster are cut off by the file's end
    assert [r["size"] for r in mkv.parse(cut)[2]] == [4, 2]
    with pytest.raises(Malformed):
        mkv.parse(movie())
    with pytest.raises(Malformed):
        mkv.parse(movie(CLUSTER, scale=0))
    assert mkv.vint(b"\xff", 0, 1) == (127, 1, True) and mkv.vint(b"\x40\x02", 0, 2) == (2, 2, False)
    odd = movie(el(mkv.CLUSTER, el(0xE7, b"\0"), el(0xA3, block(1, 1, 0x80, b"v")), el(0xA3, block(1, -1, 0, b"v"))), scale=2_500)
    assert [r["pts"] for r in mkv.parse(odd)[2]] == [3, -3]
