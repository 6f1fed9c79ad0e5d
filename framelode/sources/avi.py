"""AVI metadata as tables: tracks and sample indexes from the bytes of whole files.

`tracks` and `samples` take a DataFrame of (path, content) and give the columns of the MP4 reader. The index is the classic one where the
file holds it, else one found from the end, else a walk through the movi list. Rows of no size are passed over and take no time. A file
that cannot be read, null and empty ones among them, gives one row with its error in `tracks` and none in `samples`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .mp4 import SAMPLES, TRACKS, Malformed, _schema

MOST_SEARCHED = 64 << 20
MOST_PROBED = 64 << 10
MOST_DEPTH = 4
KEY_FLAG = 0x10

# Codecs by four letters and by sound format.
VIDEO = {"h264": ["H264", "X264", "AVC1", "DAVC"], "wmv3": ["WMV3"], "msmpeg4v3": ["DIV3", "MP43", "MPG3", "DIV5", "DIV6", "AP41", "COL1"], "mpeg4": ["XVID", "DX50", "DIVX", "MP4V", "FMP4"]}
AUDIO = {0x0055: ("mp3", "MP3 "), 0x2000: ("ac3", "AC-3")}
CODECS = {letters: codec for codec, every in VIDEO.items() for letters in every}


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, end) of the bodies in a range, padded to even sizes; an end past the range means that the chunk is cut off."""
    at = start
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield kind, at + 8, at + 8 + size
        at += 8 + size + size % 2


def _whole(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    for kind, a, b in chunks(data, start, end):
        if b > end:
            raise Malformed("a list of headers is cut off")
        yield kind, a, b


def _stream(data: bytes, start: int, end: int, number: int) -> dict | None:
    """A stream's row and how its time goes; null for one that is not supported."""
    parts = {kind: data[a:b] for kind, a, b in _whole(data, start, end)}
    head, form = parts.get(b"strh", b""), parts.get(b"strf", b"")
    if len(head) < 48 or not form:
        return None
    scale, rate, first, length = struct.unpack_from("<4I", head, 20)
    if not scale or not rate:
        return None
    row = {"track_id": number + 1, "language": None, "time_scale": rate, "duration_ticks": length * scale}
    row |= {"_scale": scale, "_first": first * scale, "_unit": struct.unpack_from("<I", head, 44)[0]}
    if head[:4] == b"vids" and len(form) >= 40:
        handler, compression = head[4:8], form[16:20]
        named = [x.decode("latin-1") for x in ([handler] if any(handler) else []) + [compression]]
        entry = next((x for x in named if x.upper() in CODECS), None)
        if entry is None:
            return None
        width, height = struct.unpack_from("<ii", form, 4)
        return row | {"type": "video", "codec": CODECS[entry.upper()], "sample_entry": entry, "width": abs(width), "height": abs(height)}
    if head[:4] == b"auds" and len(form) >= 16:
        tag, channels, rate = struct.unpack_from("<HHI", form)
        if tag not in AUDIO:
            return None
        return row | {"type": "audio", "codec": AUDIO[tag][0], "sample_entry": AUDIO[tag][1], "channels": channels, "sample_rate": rate}
    return None


def _number(kind: bytes) -> int:
    return int(kind[:2]) if kind[:2].isdigit() else -1


def _index_from_end(data: bytes) -> tuple[int, int] | None:
    """The last thing in the file that looks like a whole index."""
    low, at = max(0, len(data) - MOST_SEARCHED), len(data) - 4
    while (at := data.rfind(b"idx1", low + 1, at)) >= 0:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if size >= 16 and size % 16 == 0 and at + 8 + size <= len(data):
            return at + 8, at + 8 + size
        at += 3  # earlier ones end before this one's last letter
    return None


def _by_index(data: bytes, body: tuple[int, int], movi: int, known: dict[int, dict]) -> Iterator[tuple[int, int, int, bool]]:
    """(stream, offset, size, sync) by the index; its first row tells where its offsets count from."""
    if body[1] - body[0] < 16 or (body[1] - body[0]) % 16:
        raise Malformed("no usable index")
    base = None
    for kind, flags, offset, size in struct.iter_unpack("<4s3I", data[slice(*body)]):
        if _number(kind) not in known or not size:
            continue
        if base is None:
            base = next((x for x in (movi, 0, movi + 4) if x + offset + 8 <= len(data) and data[x + offset : x + offset + 4] == kind), None)
            if base is None:
                raise Malformed("the index does not point into movi")
        at = base + offset + 8
        if at + size > len(data):
            raise Malformed("a sample lies outside the file")
        yield _number(kind), at, size, bool(flags & KEY_FLAG)
    if base is None:
        raise Malformed("the index is empty")


def _is_key(codec: str, head: bytes) -> bool:
    """Whether a packet holds an H.264 unit of type 5, or its first MPEG-4 picture is coded on its own; other codecs: true."""
    if codec == "h264":
        at = head.find(b"\0\0\1")
        while 0 <= at < len(head) - 4:
            if head[at + 3] & 31 == 5:
                return True
            at = head.find(b"\0\0\1", at + 1)
        return False
    if codec == "mpeg4":
        at = head.find(b"\0\0\1\xb6")
        return 0 <= at < len(head) - 5 and head[at + 4] >> 6 == 0
    return True


def _by_walk(data: bytes, start: int, end: int, known: dict[int, dict], depth: int = 0) -> Iterator[tuple[int, int, int, bool]]:
    """The same without an index; a last chunk that is cut off is left out."""
    if depth > MOST_DEPTH:
        raise Malformed("lists lie too deep")
    for kind, a, b in chunks(data, start, end):
        if b > end:
            return
        if kind == b"LIST" and b - a >= 4:
            if data[a : a + 4] == b"rec ":
                yield from _by_walk(data, a + 4, b, known, depth + 1)
        elif _number(kind) in known and b > a:
            yield _number(kind), a, b - a, _is_key(known[_number(kind)]["codec"], data[a : min(b, a + MOST_PROBED)])


def _columns(track: dict, found: list[tuple[int, int, bool]]) -> dict[str, np.ndarray]:
    offset, size = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    units = np.maximum(1, size // track["_unit"]) if track["_unit"] else np.ones(len(found), np.int64)
    duration = np.minimum(units * track["_scale"], (1 << 32) - 1)
    pts = np.cumsum(duration) - duration + track["_first"]
    sync = np.array([track["type"] == "audio" or x[2] for x in found], bool)
    return {"idx": np.arange(len(found)), "offset": offset, "size": size, "dts": pts, "pts": pts, "duration": duration, "sync": sync}


def parse(data: bytes) -> list[tuple[dict, dict[str, np.ndarray]]]:
    """(track row, sample columns) of each supported stream."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Malformed("no AVI file")
    end = min(len(data), struct.unpack_from("<I", data, 4)[0] + 8)
    known: dict[int, dict] = {}
    movi = index = None
    for kind, a, b in chunks(data, 12, end):
        listed = data[a : a + 4] if kind == b"LIST" and b - a >= 4 else b""
        if b > end:
            if listed == b"movi":
                movi = (a, len(data))
            elif movi is None:
                raise Malformed("a chunk is cut off")
            break
        if listed == b"hdrl":
            streams = [(x, y) for k, x, y in _whole(data, a + 4, b) if k == b"LIST" and data[x : x + 4] == b"strl"]
            known |= {i: row for i, (x, y) in enumerate(streams) if (row := _stream(data, x + 4, y, i))}
        elif listed == b"movi":
            movi = (a, b)
        elif kind == b"idx1":
            index = (a, b)
    if not known or movi is None:
        raise Malformed("no supported stream")
    index = index or _index_from_end(data)
    found: dict[int, list] = {i: [] for i in known}
    for stream, *sample in _by_index(data, index, movi[0], known) if index else _by_walk(data, movi[0] + 4, movi[1], known):
        found[stream].append(sample)
    return [({k: v for k, v in row.items() if k[0] != "_"} | {"sample_count": len(found[i])}, _columns(row, found[i])) for i, row in known.items()]


def _files(batches) -> Iterator[tuple[str, list | Exception]]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                yield path, parse(content.as_py() or b"")
            except (Malformed, struct.error) as e:
                yield path, e


def tracks(files: DataFrame) -> DataFrame:
    """One row per supported stream of each file; a file that cannot be read has one row with its error."""

    def read(batches):
        for path, found in _files(batches):
            rows = [{"path": path, "error": str(found) or "cut off"}] if isinstance(found, Exception) else [{"path": path} | r for r, _ in found]
            yield pa.RecordBatch.from_pylist(rows, _schema(TRACKS))

    return files.select("path", "content").mapInArrow(read, TRACKS)


def samples(files: DataFrame) -> DataFrame:
    """The sample index of every supported stream of the files that can be read."""

    def read(batches):
        schema = _schema(SAMPLES)
        for path, found in _files(batches):
            for row, columns in [] if isinstance(found, Exception) else found:
                n = len(columns["idx"])
                every = {"path": [path] * n, "track_id": np.full(n, row["track_id"]), "time_scale": np.full(n, row["time_scale"])} | columns
                yield pa.RecordBatch.from_arrays([pa.array(every[f.name], f.type) for f in schema], schema=schema)

    return files.select("path", "content").mapInArrow(read, SAMPLES)
