"""MP4 metadata as tables: boxes, tracks and sample indexes from the bytes of whole files.

`tracks` and `samples` take a DataFrame of (path, content), such as spark.read.format("binaryFile") gives. Payloads are never read: a
sample is its offset and size. A file that cannot be read gives one row with its error, so that one bad file stops nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_SAMPLES = 20_000_000
MOST_SAMPLE_BYTES = 128 << 20

# Codecs of sample entries.
CODECS = {"avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "mp4v": "mpeg4", "mp4a": "aac", "ac-3": "ac3"}
KINDS = {"vide": "video", "soun": "audio"}

TRACKS = "path string, track_id long, type string, codec string, sample_entry string, language string, time_scale long, duration_ticks long, sample_count long, width int, height int, channels int, sample_rate int, error string"
SAMPLES = "path string, track_id long, idx long, offset long, size long, dts long, pts long, duration long, time_scale long, sync boolean"


class Malformed(ValueError):
    """What is wrong with a file."""


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(type, body start, end) of the boxes in a range; raises at one that does not fit."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Malformed("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} does not fit")
        yield kind.decode("latin-1"), at + head, at + size
        at += size


def children(data: bytes, body: tuple[int, int], skip: int = 0) -> dict[str, tuple[int, int]]:
    """The first child of each type; none at all if one is malformed."""
    out: dict[str, tuple[int, int]] = {}
    try:
        for kind, a, b in boxes(data, body[0] + skip, body[1]):
            out.setdefault(kind, (a, b))
    except Malformed:
        return {}
    return out


def _need(found: dict[str, tuple[int, int]], kind: str) -> tuple[int, int]:
    if kind not in found:
        raise Malformed(f"no {kind}")
    return found[kind]


def _array(data: bytes, body: tuple[int, int], kind: str, skip: int = 4) -> np.ndarray:
    """The counted table of a full box; skip: bytes before the count."""
    item = np.dtype(kind)
    count = struct.unpack_from(">I", data, body[0] + skip)[0]
    if body[0] + skip + 4 + count * item.itemsize > body[1]:
        raise Malformed("a table is cut off")
    return np.frombuffer(data, item, count, body[0] + skip + 4)


def language(packed: int) -> str:
    """Three letters of five bits; 0 stands for u."""
    return "".join(chr(0x60 + c) if c else "u" for c in ((packed >> 10) & 31, (packed >> 5) & 31, packed & 31))


def _times(data: bytes, body: tuple[int, int]) -> tuple[int, int, int]:
    """Time scale, duration and what follows them, of mvhd and mdhd."""
    long = data[body[0]] == 1
    at = body[0] + 4 + (16 if long else 8)
    scale = struct.unpack_from(">I", data, at)[0]
    if not scale:
        raise Malformed("time scale 0")
    duration = struct.unpack_from(">Q" if long else ">I", data, at + 4)[0]
    return scale, duration, at + 4 + (8 if long else 4)


def runs(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    if counts.sum() > MOST_SAMPLES:
        raise Malformed("too many samples")
    return np.repeat(values.astype(np.int64), counts)


def sample_table(data: bytes, stbl: dict[str, tuple[int, int]], shift: int = 0) -> dict[str, np.ndarray]:
    """Columns of a track's samples. The chunk of a sample and its place in the chunk give the offset."""
    stts = _array(data, _need(stbl, "stts"), ">u4,>u4")
    if (stts["f0"] == 0).any():
        raise Malformed("an empty run of durations")
    duration = runs(stts["f0"], stts["f1"])
    n = len(duration)
    stsz = _need(stbl, "stsz")
    fixed, count = struct.unpack_from(">II", data, stsz[0] + 4)
    size = np.full(count, fixed, np.int64) if fixed else _array(data, stsz, ">u4", skip=8).astype(np.int64)
    if len(size) != n:
        raise Malformed("sizes and durations differ in number")
    if n and size.max() > MOST_SAMPLE_BYTES:
        raise Malformed("a sample is too large")
    shown = np.zeros(n, np.int64)
    if "ctts" in stbl:
        body = stbl["ctts"]
        ctts = _array(data, body, ">u4,>i4" if data[body[0]] == 1 else ">u4,>u4")
        if (ctts["f0"] == 0).any():
            raise Malformed("an empty run of offsets")
        own = runs(ctts["f0"], ctts["f1"])[:n]  # what a last run has too much is cut
        shown[: len(own)] = own
    wide = "co64" in stbl
    chunk = _array(data, _need(stbl, "co64" if wide else "stco"), ">u8" if wide else ">u4").astype(np.int64)
    stsc = _array(data, _need(stbl, "stsc"), ">u4,>u4,>u4")
    first = stsc["f0"].astype(np.int64)
    if not len(first) and n or (np.diff(first) <= 0).any() or (stsc["f1"] == 0).any() or len(first) and first[0] != 1:
        raise Malformed("chunk runs out of order")
    row = np.searchsorted(first, np.arange(1, len(chunk) + 1), "right") - 1  # the last run that begins at or before the chunk
    per = stsc["f1"].astype(np.int64)[row] if len(first) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(chunk)), per)[:n]
    if len(of) < n:
        raise Malformed("chunks hold too few samples")
    before = np.concatenate([[0], np.cumsum(size)])[:-1]
    head = np.concatenate([[0], np.cumsum(per)])[of] if n else np.zeros(0, np.int64)
    offset = chunk[of] + before - before[head] if n else before
    sync = np.ones(n, bool)
    if "stss" in stbl:
        sync[:] = False
        marked = _array(data, stbl["stss"], ">u4").astype(np.int64)
        sync[marked[(marked > 0) & (marked <= n)] - 1] = True
    dts = np.concatenate([[0], np.cumsum(duration)])[:-1] + shift
    return {"idx": np.arange(n), "offset": offset, "size": size, "dts": dts, "pts": dts + shown, "duration": duration, "sync": sync}


def _edit_shift(data: bytes, trak: dict[str, tuple[int, int]], movie_scale: int, scale: int) -> int:
    """Ticks by which an edit list of empty edits and then one plain media edit moves a track; other lists are ignored."""
    edts = children(data, trak["edts"]) if "edts" in trak else {}
    if "elst" not in edts:
        return 0
    body = edts["elst"]
    rows = _array(data, body, ">u8,>i8,>i2,>i2" if data[body[0]] == 1 else ">u4,>i4,>i2,>i2")
    media = [r for r in rows if r["f1"] != -1]
    if len(media) != 1 or rows[-1]["f1"] == -1 or (media[0]["f2"], media[0]["f3"]) != (1, 0):
        return 0
    empty = sum(int(r["f0"]) for r in rows[:-1])
    return (empty * scale * 2 + movie_scale) // (2 * movie_scale) - int(media[0]["f1"])


def parse(data: bytes) -> list[tuple[dict, dict[str, np.ndarray]]]:
    """(track row, sample columns) of each video and audio track."""
    top = {}
    for kind, a, b in boxes(data, 0, len(data)):
        top.setdefault(kind, (a, b))
    _need(top, "ftyp")
    if "moof" in top:
        raise Malformed("fragmented files are not read")
    moov = _need(top, "moov")
    movie_scale, _, _ = _times(data, _need(children(data, moov), "mvhd"))
    out = []
    for kind, a, b in boxes(data, *moov):
        if kind != "trak":
            continue
        trak = children(data, (a, b))
        mdia = children(data, _need(trak, "mdia"))
        hdlr = _need(mdia, "hdlr")
        kind = KINDS.get(data[hdlr[0] + 8 : hdlr[0] + 12].decode("latin-1"))
        if kind is None:
            continue
        tkhd = _need(trak, "tkhd")
        track_id = struct.unpack_from(">I", data, tkhd[0] + (20 if data[tkhd[0]] == 1 else 12))[0]
        scale, duration, after = _times(data, _need(mdia, "mdhd"))
        stbl = children(data, _need(children(data, _need(mdia, "minf")), "stbl"))
        entry, body, _ = next(boxes(data, _need(stbl, "stsd")[0] + 8, stbl["stsd"][1]))
        if entry not in CODECS:
            raise Malformed(f"sample entry {entry}")
        row = {"track_id": track_id, "type": kind, "codec": CODECS[entry], "sample_entry": entry, "language": language(struct.unpack_from(">H", data, after)[0]), "time_scale": scale, "duration_ticks": duration}
        if kind == "video":
            row["width"], row["height"] = struct.unpack_from(">HH", data, body + 24)
        else:
            row["channels"], row["sample_rate"] = struct.unpack_from(">H", data, body + 16)[0], struct.unpack_from(">I", data, body + 24)[0] >> 16
        columns = sample_table(data, stbl, _edit_shift(data, trak, movie_scale, scale))
        out.append((row | {"sample_count": len(columns["idx"])}, columns))
    if not any(r["type"] == "video" for r, _ in out):
        raise Malformed("no video track")
    return out


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _files(batches) -> Iterator[tuple[str, list | Exception]]:
    """Each file's path and tracks, or what is wrong with it."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                yield path, parse(content.as_py() or b"")
            except (Malformed, struct.error, StopIteration) as e:
                yield path, e


def tracks(files: DataFrame) -> DataFrame:
    """One row per track of each file; a file that cannot be read has one row with its error."""

    def read(batches):
        for path, found in _files(batches):
            rows = [{"path": path, "error": str(found) or "cut off"}] if isinstance(found, Exception) else [{"path": path} | r for r, _ in found]
            yield pa.RecordBatch.from_pylist(rows, _schema(TRACKS))

    return files.select("path", "content").mapInArrow(read, TRACKS)


def samples(files: DataFrame) -> DataFrame:
    """The sample index of every track of the files that can be read."""

    def read(batches):
        schema = _schema(SAMPLES)
        for path, found in _files(batches):
            for row, columns in [] if isinstance(found, Exception) else found:
                n = len(columns["idx"])
                every = {"path": [path] * n, "track_id": np.full(n, row["track_id"]), "time_scale": np.full(n, row["time_scale"])} | columns
                yield pa.RecordBatch.from_arrays([pa.array(every[f.name], f.type) for f in schema], schema=schema)

    return files.select("path", "content").mapInArrow(read, SAMPLES)


def container(head: bytes, path: str = "") -> str:
    """What a file is by its first 616 bytes, else by its name, else mp4."""
    if head[:4] == b"\x1a\x45\xdf\xa3":
        return "mkv"
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return "avi"
    for stride, lead in ((188, 0), (192, 4), (204, 0)):
        if len(head) > lead + 2 * stride and all(head[lead + i * stride] == 0x47 for i in range(3)):
            return "ts"
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
        return "mp4"
    return {"mkv": "mkv", "webm": "mkv", "avi": "avi", "ts": "ts", "m2ts": "ts", "mts": "ts"}.get(path.lower().rpartition(".")[2], "mp4")
