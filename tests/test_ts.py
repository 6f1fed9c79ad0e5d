"""Transport streams, ranges of files, status files."""

import pytest

from framelode.plans import media
from framelode.sources import mp4, ranged, status, ts


def bits(*parts):
    """Bits of (value, width) and of exp-Golomb codes (a value alone), filled up to bytes."""
    out = ""
    for p in parts:
        out += format(p[0], f"0{p[1]}b") if isinstance(p, tuple) else "0" * ((p + 1).bit_length() - 1) + format(p + 1, "b")
    out += "1"
    out += "0" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8))


@pytest.mark.parametrize("stride", [188, 192, 204])
def test_layouts_and_wrap(stride):
    parts = [((ts.WRAP - 3000 + i * 2880) % ts.WRAP, bytes([i]) * (1 + 200 * i)) for i in range(6)]
    data = media.transport_stream(parts, stride)
    assert ts.layout(data) == (stride, 4 if stride == 192 else 0) and mp4.container(data[:616]) == "ts"
    duration, [(row, samples)] = ts.parse(data)
    assert duration == 5 * 2880 / 90_000 and row["codec"] == "ac3" and row["pid"] == 0x101
    assert samples == [(i * 2880, 2880, True, payload) for i, (_, payload) in enumerate(parts)]


def test_damaged_packets_and_no_stream(spark):
    data = bytearray(media.transport_stream([(0, b"a" * 400), (2880, b"b" * 10)]))
    data[188 * 3 + 1] |= 0x80  # a packet in error is passed over
    (_, [(_, samples)]) = ts.parse(bytes(data))
    assert [len(s[3]) for s in samples] == [400 - 184, 10]
    rows = ts.tracks(spark.createDataFrame([("x.ts", bytearray(b"no stream")), ("y.ts", bytearray(data))], "path string, content binary")).collect()
    assert "stride" in rows[0].error and rows[1].error is None and rows[1].codec == "ac3"


def test_adts():
    def frame(payload, rate=4, channels=2):
        n = len(payload) + 7
        return bytes([0xFF, 0xF1, 1 << 6 | rate << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC]) + payload

    data = b"junk\xff" + frame(b"one") + b"\0" + frame(b"three") + b"\xff\xf1\x50"
    found = list(ts.adts_frames(data))
    assert [raw for _, raw in found] == [b"one", b"three"]
    assert found[0][0] | {"size": 0} == {"head": 7, "size": 0, "sample_rate": 44_100, "channels": 2, "config": bytes([2 << 3 | 2, 2 << 3])}


def test_sequence_parameters():
    plain = b"\x67" + bits((66, 8), (0, 16), 0, 0, 0, 0, 0, (0, 1), 119, 67, (1, 1), (0, 1), (1, 1), 0, 0, 0, 4)
    assert ts.h264_size(plain) == (1920, 1080)
    high = b"\x67" + bits((100, 8), (0, 16), 0, 1, 0, 0, (0, 1), (0, 1), 0, 2, 0, (0, 1), 39, 14, (0, 1), (0, 1), (0, 1), (0, 1))
    assert ts.h264_size(high) == (640, 480)
    assert ts.h264_size(b"\x67\x42") is None
    size, rate, sync = ts._video("mpeg2", b"\0\0\1\xb3" + bytes([720 >> 4, (720 & 15) << 4 | 576 >> 8, 576 & 255, 0x13]) + b"\0\0\1\0\0\x08")
    assert size == (720, 576) and rate == (25, 1) and sync


def test_ranges(spark, tmp_path):
    path = tmp_path / "big.bin"
    path.write_bytes(bytes(range(256)) * 100)
    wanted = [(str(path), 10, 5), (str(path), 25_590, 20), (f"file://{path}", 25_590, 10), (str(tmp_path / "none"), 0, 1), (str(path), 0, 0)]
    got = ranged.parts(spark.createDataFrame(wanted, "path string, offset long, size long").coalesce(1)).collect()
    assert [bytes(r.data) if r.data is not None else None for r in got] == [bytes(range(10, 15)), None, bytes(range(246, 256)), None, b""]
    assert "outside" in got[1].error and got[3].error
    split = ranged.split(spark.createDataFrame([("a", 1000), ("b", 0)], "path string, length long"), 188, 2).collect()
    assert [(r.path, r.offset, r["size"]) for r in split] == [("a", 0, 376), ("a", 376, 376), ("a", 752, 248), ("b", 0, 0)]


def test_atomic_write_and_tail(spark, tmp_path):
    path = str(tmp_path / "x.srt")
    for body in (b"one", b"two"):
        status.write_atomically(path, body)
    assert open(path, "rb").read() == b"two" and len(list(tmp_path.iterdir())) == 1
    rows = spark.createDataFrame([(bytearray("aé한글".encode()),)], "c binary")
    assert [rows.select(status.log_tail(rows.c, n)).first()[0] for n in (3, 4, 5, 6, 99)] == ["글", "글", "글", "한글", "aé한글"]
    assert bytes(spark.createDataFrame([([0.5, -1.0],)], "x array<double>").select(status.float_bytes("x")).first()[0]) == b"\0\0\0?\0\0\x80\xbf"
