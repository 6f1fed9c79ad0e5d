"""The AVI reader on synthetic bytes."""

import struct

import pytest

from framelode.sources import avi
from framelode.sources.mp4 import Malformed


def chunk(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def stream(kind, handler, scale, rate, start, size, form):
    head = kind + handler + bytes(12) + struct.pack("<4I", scale, rate, start, 9) + bytes(8) + struct.pack("<I", size)
    return chunk(b"LIST", b"strl" + chunk(b"strh", head + bytes(8)) + chunk(b"strf", form))


VIDEO = struct.pack("<IiiHH4s", 40, 640, -360, 1, 24, b"XVID") + bytes(20)
AUDIO = struct.pack("<HHIIHH", 0x55, 2, 44100, 16000, 1, 0)
BODY = [(b"00dc", b"\0\0\1\xb6\x10abc"), (b"01wb", b"m" * 10), (b"00dc", b"\0\0\1\xb6\x50"), (b"01wb", b"n")]


def movie(base=4, index=True, junk=b"", sizes=None):
    """base: what the first chunk's offset in the index is counted as, 4 from the movi type's place."""
    streams = stream(b"vids", bytes(4), 1, 25, 2, 0, VIDEO) + stream(b"auds", bytes(4), 1, 100, 0, 4, AUDIO)
    rows, data = b"", b""
    for i, (kind, body) in enumerate(BODY):
        rows += kind + struct.pack("<3I", 0x10 if i == 0 else 0, base + len(data), (sizes or {}).get(i, len(body)))
        data += chunk(kind, body)
    body = chunk(b"LIST", b"hdrl" + streams) + chunk(b"LIST", b"movi" + data) + junk + (chunk(b"idx1", rows) if index else b"")
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def test_tracks_and_samples(spark):
    data = movie()
    files = spark.createDataFrame([("a.avi", bytearray(data)), ("b.avi", bytearray(b"none")), ("c.avi", None)], "path string, content binary")
    got = {(r.path, r.track_id): r for r in avi.tracks(files).collect()}
    video, sound = got["a.avi", 1], got["a.avi", 2]
    assert (video.codec, video.sample_entry, video.width, video.height, video.time_scale, video.duration_ticks, video.sample_count) == ("mpeg4", "XVID", 640, 360, 25, 9, 2)
    assert (sound.codec, sound.channels, sound.sample_rate, sound.sample_count) == ("mp3", 2, 44100, 2)
    assert got["b.avi", None].error and got["c.avi", None].error
    rows = sorted(avi.samples(files).collect(), key=lambda r: (r.track_id, r.idx))
    assert [(r.track_id, r.idx, r.size, r.pts, r.duration, r.sync) for r in rows] == [(1, 0, 8, 2, 1, True), (1, 1, 5, 3, 1, False), (2, 0, 10, 0, 2, True), (2, 1, 1, 2, 1, True)]
    assert [data[r.offset : r.offset + r.size] for r in rows] == [BODY[0][1], BODY[2][1], BODY[1][1], BODY[3][1]]


def places(data):
    return [(r["track_id"], c["offset"].tolist(), c["sync"].tolist()) for r, c in avi.parse(data)]


def test_ways_to_the_index():
    plain = places(movie())
    start = movie().index(b"00dc")
    assert places(movie(base=0)) == plain and places(movie(base=start)) == plain
    assert places(movie(index=False)) == plain  # by a walk through movi
    assert places(movie(junk=b"\xff" * 10)) == plain  # found from the end
    with pytest.raises(Malformed):
        avi.parse(movie(base=7))


def test_empty_rows_take_no_time():
    _, columns = avi.parse(movie(sizes={0: 0}))[0]
    assert columns["pts"].tolist() == [2] and columns["sync"].tolist() == [False]


def test_damage():
    whole = movie(index=False)
    _, columns = avi.parse(whole[:-1])[1]  # only the padding is cut off
    assert columns["size"].tolist() == [10, 1]
    _, columns = avi.parse(whole[:-2])[1]  # the last chunk is cut off
    assert columns["size"].tolist() == [10]
    with pytest.raises(Malformed):
        avi.parse(movie(sizes={3: 1 << 20}))
