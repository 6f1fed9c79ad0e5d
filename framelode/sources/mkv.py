"""Matroska metadata as tables: tracks, cue points and frames from the bytes of whole files.

`tracks`, `cue_points` and `frames` take a DataFrame of (path, content). Payloads are never decoded: a frame is its place in the file and
its stored size; a track's `encoding` says what its frames went through (zlib, strip with the stripped bytes in `stripped`). Times are
microseconds. Within an element, reading stops at the first malformed child; a file that cannot be read gives one row with its error in
`tracks` and no rows elsewhere. Null or empty content is such a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .mp4 import Malformed, _schema

TIME_SCALE = 1_000_000

# Element ids.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS_ID, CUES, CLUSTER = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x1F43B675
# Codecs by id, whole or by prefix.
CODECS = {"V_MPEGH/ISO/HEVC": "hevc", "V_MPEG4/ISO/AVC": "h264", "A_OPUS": "opus", "A_FLAC": "flac", "A_AC3": "ac3", "A_EAC3": "eac3", "S_TEXT/UTF8": "subrip", "S_TEXT/ASCII": "subrip", "S_TEXT/ASS": "ass", "S_TEXT/SSA": "ass", "S_VOBSUB": "vobsub"}
PREFIXES = {"A_AAC": "aac", "A_DTS": "dts"}
KINDS = {1: ("video", "V"), 2: ("audio", "A"), 17: ("subtitle", "S")}

TRACKS = "path string, track_id long, type string, codec string, codec_id string, language string, name string, default boolean, forced boolean, duration_us long, default_duration_ns long, width int, height int, channels int, sample_rate int, encoding string, stripped binary, error string"
CUE_POINTS = "path string, time_us long, offset long"
FRAMES = "path string, track_id long, idx long, offset long, size long, pts long, duration long, sync boolean"


def vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, where it ends, and whether it means an unknown size (all ones)."""
    if at >= end or not data[at]:
        raise Malformed("a number is cut off or too long")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise Malformed("a number is cut off")
    value, ones = int.from_bytes(data[at : at + length], "big"), (1 << 7 * length) - 1
    if keep_marker:
        return value, at + length, False
    return value & ones, at + length, value & ones == ones


def elements(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the bodies in a range, up to the first that does not fit."""
    at = start
    while at < end:
        try:
            kind, at, _ = vint(data, at, end, True)
            size, at, unknown = vint(data, at, end)
        except Malformed:
            return
        if unknown or at + size > end:
            return
        yield kind, at, at + size
        at += size


def _top(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start, end, of unknown size) in the file or its segment; only a segment or cluster may be cut off by the file's end."""
    at = start
    while at < end:
        kind, at, _ = vint(data, at, len(data), True)
        size, at, unknown = vint(data, at, len(data))
        if not unknown and at + size > len(data) and kind not in (SEGMENT, CLUSTER):
            raise Malformed("an element passes the end of the file")
        stop = len(data) if unknown else min(at + size, len(data))
        yield kind, at, stop, unknown
        at = stop


def _last(data: bytes, body: tuple[int, int]) -> dict[int, bytes]:
    """The bytes of each child; the last one counts."""
    return {kind: data[a:b] for kind, a, b in elements(data, *body)}


def _number(value: bytes) -> int:
    return int.from_bytes(value, "big")


def _us(ticks: int, scale: int) -> int:
    """Microseconds of ticks of `scale` nanoseconds, halves away from zero."""
    us = (2 * abs(ticks) * scale + 1000) // 2000
    return us if ticks >= 0 else -us


def _real(value: bytes) -> float:
    return struct.unpack(">f" if len(value) == 4 else ">d", value)[0] if len(value) in (4, 8) else 0.0


def _encoding(data: bytes, body: tuple[int, int]) -> tuple[str | None, bytes | None]:
    """zlib, strip (with the bytes) or unsupported, of the compressions that apply to frames."""
    found, stripped = set(), b""
    for kind, a, b in elements(data, *body):
        if kind != 0x6240:
            continue
        own = _last(data, (a, b))
        if 0x5034 not in own or _number(own.get(0x5033, b"\0")) or not _number(own.get(0x5032, b"\1")) & 1:
            continue
        inner = _last(own[0x5034], (0, len(own[0x5034])))
        algorithm = {0: "zlib", 3: "strip"}.get(_number(inner.get(0x4254, b"\0")), "unsupported")
        found.add(algorithm)
        if algorithm == "strip":
            stripped = inner.get(0x4255, b"")
    name = next((x for x in ("unsupported", "zlib", "strip") if x in found), None)
    return name, stripped if name == "strip" else None


def _track(data: bytes, body: tuple[int, int], duration_us: int) -> dict | None:
    """A track's row; null for one of another kind, codec or compression."""
    own = _last(data, body)
    number, kind, codec_id = _number(own.get(0xD7, b"")), KINDS.get(_number(own.get(0x83, b""))), own.get(0x86, b"").decode("utf-8", "replace")
    codec = CODECS.get(codec_id) or next((c for p, c in PREFIXES.items() if codec_id.startswith(p)), None)
    if not 0 < number < 1 << 32 or kind is None or codec is None or codec_id[0] != kind[1]:
        return None
    encoded = next(((a, b) for k, a, b in elements(data, *body) if k == 0x6D80), None)
    encoding, stripped = _encoding(data, encoded) if encoded else (None, None)
    if encoding == "unsupported":
        return None
    words = lambda *ids: next((own[i].decode("utf-8", "replace") for i in ids if own.get(i)), None)
    row = {"track_id": number, "type": kind[0], "codec": codec, "codec_id": codec_id, "language": words(0x22B59D, 0x22B59C), "name": words(0x536E), "default": _number(own.get(0x88, b"\1")) != 0, "forced": _number(own.get(0x55AA, b"\0")) != 0}
    row |= {"duration_us": duration_us, "default_duration_ns": _number(own.get(0x23E383, b"")), "encoding": encoding, "stripped": stripped}
    if 0xE0 in own:
        picture = _last(own[0xE0], (0, len(own[0xE0])))
        row |= {"width": _number(picture.get(0xB0, b"")), "height": _number(picture.get(0xBA, b""))}
    if 0xE1 in own:
        sound = _last(own[0xE1], (0, len(own[0xE1])))
        row |= {"channels": _number(sound.get(0x9F, b"\1")), "sample_rate": 48_000 if codec == "opus" else round(_real(sound.get(0xB5, b"")))}
    return row


def laces(data: bytes, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block; mode: 0 none, 1 Xiph, 2 equal sizes, 3 differences. They fill the block exactly."""
    if mode == 0:
        return [(at, end - at)]
    if at >= end:
        raise Malformed("a laced block is empty")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == 2:
        if (end - at) % n:
            raise Malformed("frames of equal size do not fit")
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if mode == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Malformed("frame sizes are cut off")
                    size, at = size + data[at], at + 1
                    if data[at - 1] != 255:
                        break
            else:
                before = at
                size, at, unknown = vint(data, at, end)
                if unknown:
                    raise Malformed("a frame size is unknown")
                if i:
                    size += sizes[-1] - ((1 << (7 * (at - before) - 1)) - 1)
            if size < 0:
                raise Malformed("a frame size is negative")
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
        if sizes[-1] < 0:
            raise Malformed("frame sizes pass the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(data: bytes, body: tuple[int, int], clock: int, known: dict[int, dict], scale: int, simple: bool, key: bool, lasts: int) -> list[dict]:
    """The frames of a block; blocks of other tracks are passed over before their laces are read."""
    at, end = body
    number, at, unknown = vint(data, at, end)
    if unknown or at + 3 > end:
        raise Malformed("a block header is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    track = known.get(number)
    if track is None:
        return []
    found = laces(data, at + 3, end, (flags >> 1) & 3)
    if lasts:
        each = max(1, _us(lasts, scale)) // len(found)
    else:
        each = max(1, track["default_duration_ns"] // 1000) if track["default_duration_ns"] else 0
    start = _us(clock + relative, scale)
    sync = track["type"] != "video" or (bool(flags & 0x80) if simple else key)
    return [{"track_id": number, "offset": o, "size": s, "pts": start + i * each, "duration": min(each, (1 << 32) - 1), "sync": sync} for i, (o, s) in enumerate(found)]


def _cluster(data: bytes, body: tuple[int, int], known: dict[int, dict], scale: int) -> Iterator[dict]:
    inside = list(elements(data, *body))
    clock = next((_number(data[a:b]) for kind, a, b in inside if kind == 0xE7), 0)
    for kind, a, b in inside:
        if kind == 0xA3:
            yield from _block(data, (a, b), clock, known, scale, True, False, 0)
        elif kind == 0xA0:
            group = {k: (x, y) for k, x, y in elements(data, a, b)}
            if 0xA1 in group:
                lasts = _number(data[slice(*group[0x9B])]) if 0x9B in group else 0
                yield from _block(data, group[0xA1], clock, known, scale, False, 0xFB not in group, lasts)


def parse(data: bytes) -> tuple[list[dict], list[dict], Iterator[dict]]:
    """Track rows, cue points of the first video track by time, and the frames, read as they are asked for."""
    top = _top(data, 0, len(data))
    if not data or next(top)[0] != EBML:
        raise Malformed("no EBML header")
    segment = next(((a, b) for kind, a, b, _ in top if kind == SEGMENT), None)
    if segment is None:
        raise Malformed("no segment")
    info = cue_at = first = None
    entries: list[tuple[int, int]] = []
    has_tracks = False
    for kind, a, b, unknown in _top(data, *segment):
        if kind == CLUSTER:
            first = True
            break
        if unknown:
            raise Malformed("metadata of unknown size")
        if kind == INFO:
            info = _last(data, (a, b))
        elif kind == TRACKS_ID:
            has_tracks = True
            entries += [(x, y) for k, x, y in elements(data, a, b) if k == 0xAE]
        elif kind == SEEK_HEAD:
            for k, x, y in elements(data, a, b):
                seek = _last(data, (x, y)) if k == 0x4DBB else {}
                if _number(seek.get(0x53AB, b"")) == CUES:
                    cue_at = segment[0] + _number(seek.get(0x53AC, b""))
    if info is None or not has_tracks or first is None:
        raise Malformed("no info, tracks or cluster")
    scale, length = _number(info.get(0x2AD7B1, TIME_SCALE.to_bytes(4, "big"))), _real(info.get(0x4489, b""))
    if not scale or not 0 <= length < float("inf"):
        raise Malformed("times")
    rows = [r for body in entries if (r := _track(data, body, int(length * scale / 1000)))]
    video = next((r["track_id"] for r in rows if r["type"] == "video"), None)
    cues = _cues(data, cue_at, segment[0], scale, video) if cue_at is not None and cue_at < len(data) else []
    known: dict[int, dict] = {}
    for r in rows:
        known.setdefault(r["track_id"], r)

    def frames() -> Iterator[dict]:
        for kind, a, b, unknown in _top(data, *segment):
            if unknown:
                raise Malformed("a cluster of unknown size")
            if kind == CLUSTER:
                yield from _cluster(data, (a, b), known, scale)

    return rows, cues, frames()


def _cues(data: bytes, at: int, base: int, scale: int, video: int | None) -> list[dict]:
    """The first place of each cue point that names the video track."""
    kind, a, b, unknown = next(_top(data, at, len(data)))
    if kind != CUES or unknown:
        raise Malformed("the seek head names no cues")
    out = []
    for k, x, y in elements(data, a, b):
        if k != 0xBB:
            continue
        places = [_last(data, (p, q)) for c, p, q in elements(data, x, y) if c == 0xB7]
        found = next((_number(p.get(0xF1, b"")) for p in places if _number(p.get(0xF7, b"")) == video), None)
        if found is not None and base + found <= len(data):
            out.append({"time_us": _us(_number(_last(data, (x, y)).get(0xB3, b"")), scale), "offset": base + found})
    return sorted(out, key=lambda r: r["time_us"])


_BROKEN = (Malformed, struct.error, StopIteration)
_ROWS = 1 << 16


def _read(files: DataFrame, ddl: str, take) -> DataFrame:
    """Rows of each file by `take(path, content)`, in batches of _ROWS at most."""

    def read(batches):
        schema = _schema(ddl)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[dict] = []
                for row in take(content.as_py() or b""):
                    rows.append({"path": path} | row)
                    if len(rows) == _ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(read, ddl)


def tracks(files: DataFrame) -> DataFrame:
    """One row per supported track of each file; a file that cannot be read has one row with its error."""

    def take(data: bytes) -> list[dict]:
        try:
            return parse(data)[0]
        except _BROKEN as e:
            return [{"error": str(e) or "cut off"}]

    return _read(files, TRACKS, take)


def cue_points(files: DataFrame) -> DataFrame:
    """The seek index of each file's first video track."""

    def take(data: bytes) -> list[dict]:
        try:
            return parse(data)[1]
        except _BROKEN:
            return []

    return _read(files, CUE_POINTS, take)


def frames(files: DataFrame) -> DataFrame:
    """The frames of each file's supported tracks, numbered within their track; those before a damaged block stay."""

    def take(data: bytes) -> Iterator[dict]:
        seen: dict[int, int] = {}
        try:
            for row in parse(data)[2]:
                idx = seen[row["track_id"]] = seen.get(row["track_id"], -1) + 1
                yield row | {"idx": idx}
        except _BROKEN:
            return

    return _read(files, FRAMES, take)
