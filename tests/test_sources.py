"""Readers on synthetic bytes."""

import struct
import zlib

import pytest

from framelode.functions import bitstream, matching
from framelode.sources import mp4, subtitles


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind.encode() + body


def full(kind, fmt, *values, version=0):
    return box(kind, bytes([version, 0, 0, 0]), struct.pack(">" + fmt, *values))


def movie(**more):
    video = box("avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50))
    tables = {
        "stsd": box("stsd", bytes(4), struct.pack(">I", 1), video),
        "stts": full("stts", "I4I", 2, 3, 100, 2, 50),
        "ctts": full("ctts", "I4I", 2, 2, 10, 9, 20),
        "stsz": full("stsz", "7I", 0, 5, 11, 12, 13, 14, 15),
        "stsc": full("stsc", "I6I", 2, 1, 2, 1, 2, 1, 1),
        "stco": full("stco", "5I", 4, 1000, 2000, 3000, 4000),
        "stss": full("stss", "3I", 2, 1, 4),
    } | more
    stbl = box("stbl", *tables.values())
    mdia = box("mdia", full("mdhd", "4IHH", 0, 0, 1000, 400, 0x15C7, 0), box("hdlr", bytes(8), b"vide", bytes(12)), box("minf", stbl))
    edts = box("edts", full("elst", "IIiHHIiHH", 2, 60, -1, 1, 0, 100, 30, 1, 0))
    trak = box("trak", full("tkhd", "5I", 0, 0, 7, 0, 400), edts, mdia)
    return box("ftyp", b"isom") + box("moov", full("mvhd", "4I", 0, 0, 600, 240), trak)


def test_mp4(spark):
    files = spark.createDataFrame([("a.mp4", bytearray(movie())), ("b.mp4", bytearray(b"none"))], "path string, content binary")
    t = {r.path: r for r in mp4.tracks(files).collect()}
    assert (t["a.mp4"].track_id, t["a.mp4"].codec, t["a.mp4"].language, t["a.mp4"].width, t["a.mp4"].sample_count) == (7, "h264", "eng", 640, 5)
    assert t["b.mp4"].error
    s = sorted(mp4.samples(files).collect(), key=lambda r: r.idx)
    assert [r.offset for r in s] == [1000, 1011, 2000, 3000, 4000]
    assert [r.dts for r in s] == [70, 170, 270, 370, 420]
    assert [r.pts - r.dts for r in s] == [10, 10, 20, 20, 20]
    assert [r.sync for r in s] == [True, False, False, True, False]


def test_mp4_errors():
    with pytest.raises(mp4.Malformed):
        mp4.parse(movie(stsz=full("stsz", "2I", 9, 4)))
    with pytest.raises(mp4.Malformed):
        mp4.parse(box("ftyp") + box("moof") + movie()[12:])
    assert mp4.container(b"\x1a\x45\xdf\xa3") == "mkv" and mp4.container(b"", "x.AVI") == "avi" and mp4.container(b"\x47" * 616) == "ts"


def test_subtitles(spark):
    srt = "1\r\n00:00:01,5 --> 00:00:02,250\r\n<i>a</i>&amp;lt;b\r\nc\r\n\r\n00:01.000 --> 00:02.000\nno hours\n\n2\n1:00:00.000 --> 1:00:01.000\tx\ntab<br >\n<BR>\n  \n"
    ass = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\b1}hi\\Nthere, you\n"
    smi = "<SYNC Start=1000><P>one<SYNC Start=2000><P>&nbsp;<sync start=3000>two"
    rows = [("a.srt", srt.encode()), ("b.ass", b"\xff\xfe" + ass.encode("utf-16-le")), ("c.smi", smi.encode()), ("d.srt", "00:00:01,0 --> 00:00:02,0\n한글".encode("cp949")), ("e.txt", ass.encode())]
    got = {}
    for r in subtitles.cues(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect():
        got.setdefault(r.path, []).append((r.start, r.end, r.text))
    assert got["a.srt"] == [(1.5, 2.25, "a<b\nc"), (3600.0, 3601.0, "tab")]
    assert got["b.ass"] == got["e.txt"] == [(1.0, 2.0, "hi\nthere, you")]
    assert got["c.smi"] == [(1.0, 2.0, "one"), (3.0, 8.0, "two")]
    assert got["d.srt"] == [(1.0, 2.0, "한글")]


def test_round_trip(spark):
    cues = [("x.srt", i, i * 3.5, i * 3.5 + 2.125, f"line {i}\nsecond") for i in range(12)]
    text = subtitles.srt_text(spark.createDataFrame(cues, subtitles.CUES)).first()
    again = subtitles.parse("x.srt", text.content.encode())
    assert again == [c[2:] for c in cues]


def test_catalog(spark):
    rows = [("en", 0, "# c"), ("en", 1, "a=1"), ("en", 2, "a = 2=3"), ("en", 3, "; x"), ("en", 4, "no value")]
    lines = spark.createDataFrame(rows, "path string, line_no int, value string")
    assert [(r.key, r.text) for r in subtitles.catalog(lines).collect()] == [("a", " 2=3")]
    assert [r.key for r in subtitles.catalog(lines, strict=True).collect()] == ["a"]
    assert subtitles.unescape(r"a\\n\n\q") == "a\\n\n\\q"


def test_next_episode(spark):
    names = ["d/Show.Title.E03.240101.1080p.mkv", "d/Show.Title.E04.240108.1080p.mkv", "d/Other.E04.mkv", "e/Show.Title.E04.mkv"]
    got = {r.path: r.next_path for r in matching.next_episodes(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {names[0]: names[1]}


def test_bits():
    b = bitstream.Bits(bytes([0b10100110, 0b01000000]))
    assert [b.ue(), b.ue(), b.ue(), b.ue()] == [0, 1, 2, 3]
    assert bitstream.unescaped(b"\0\0\3\1\0\0\3") == b"\0\0\1\0\0"
    assert bitstream.annex_b(b"\0\0\0\2ab\0\0\0\1c\0\0\0\x09x", 4) == b"\0\0\0\1ab\0\0\0\1c"
    assert bitstream.nal_types(b"\0\0\0\1\x65x\0\0\1\x67") == [5, 7]
    assert bitstream.inflate(zlib.compress(b"x" * 100)) == b"x" * 100 and bitstream.inflate(b"bad") is None
    assert bitstream.crc(b"123456789", 8, 0x07) == 0xF4 and bitstream.crc(b"123456789", 16, 0x8005) == 0xFEE8


def test_flac_constant_and_verbatim():
    def frame(body):
        head = bytes([0xFF, 0xF8, 0x69, 0x18, 0x00, 0x03])  # 4 samples, stereo, 16 bits
        head += bytes([bitstream.crc(head, 8, 0x07)])
        return (head + body) + bitstream.crc(head + body, 16, 0x8005).to_bytes(2, "big")

    data = frame(bytes([0x00, 0x00, 0x07]) + bytes([0x02]) + struct.pack(">4h", 1, -2, 3, -4))
    assert bitstream.flac_frame(data) == [[7] * 4, [1, -2, 3, -4]]
    with pytest.raises(ValueError):
        bitstream.flac_frame(data[:-1] + b"\0")
