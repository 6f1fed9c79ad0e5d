"""MPEG transport streams as tables: packets by stride, programs, elementary streams, and their samples.

A file's packets are one matrix, so headers are read for all packets at once; packets of one PID fall into elementary packets (PES) at
their start flags. `tracks` and `samples` take (path, content).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.functions.bitstream import Bits, unescaped

from .mp4 import Malformed, _schema

TICKS = 90_000
WRAP = 1 << 33
MOST_PES = 16 << 20
#: Ticks of an audio sample that no header tells, and of a video frame without a rate.
AUDIO_TICKS, VIDEO_TICKS = 2880, 3754
TRACKS = "path string, track_id long, pid long, kind string, codec string, width long, height long, sample_rate long, channels long, config binary, duration double, error string"
SAMPLES = "path string, track_id long, idx long, time_scale long, pts long, duration long, sync boolean, size long, data binary"

# Packet strides with the bytes before the sync byte, stream types, rates of ADTS, names in registration descriptors.
LAYOUTS = [(188, 0), (192, 4), (204, 0)]
TYPES = {0x1B: "h264", 0x02: "mpeg2", 0x0F: "aac", 0x81: "ac3", 0x87: "eac3", 0x82: "dts", 0x85: "dts", 0x86: "dts", 0x8A: "dts"}
DESCRIPTORS = {0x6A: "ac3", 0x7A: "eac3"}
NAMES = {b"AC-": "ac3", b"EAC": "eac3", b"DTS": "dts", b"BSS": "dts"}
ADTS_RATES = [96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8_000, 7_350]
HIGH_PROFILES = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135}
MPEG2_RATES = {1: (24_000, 1001), 2: (24, 1), 3: (25, 1), 4: (30_000, 1001), 5: (30, 1), 6: (50, 1), 7: (60_000, 1001), 8: (60, 1)}


def layout(head: bytes) -> tuple[int, int]:
    """Stride and lead of the packets: the first with three sync bytes in a row."""
    for stride, lead in LAYOUTS:
        if len(head) > lead + 2 * stride and head[lead] == head[lead + stride] == head[lead + 2 * stride] == 0x47:
            return stride, lead
    raise Malformed("no stride of 188, 192 or 204 bytes")


def packets(data: bytes) -> dict[str, np.ndarray]:
    """pid, start flag, and where the payload begins and ends, of each packet that has one and no error."""
    stride, lead = layout(data)
    number = (len(data) - lead - 188) // stride + 1
    raw = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8)[lead:], (number, 188), (stride, 1), writeable=False)
    head = raw[:, :5].astype(np.int64)
    field = head[:, 3] >> 4 & 3
    skip = np.where(field == 3, 5 + head[:, 4], 4)
    good = (head[:, 0] == 0x47) & (head[:, 1] & 0x80 == 0) & (field & 1 == 1) & (skip < 188)
    at = np.arange(number) * stride + lead
    return {"pid": ((head[:, 1] & 0x1F) << 8 | head[:, 2])[good], "start": (head[:, 1] & 0x40 != 0)[good], "begin": (at + skip)[good], "end": (at + 188)[good]}


def _section(payload: bytes, table: int) -> bytes | None:
    """A section of one packet without its checksum, if it is of this table and whole."""
    body = payload[1 + payload[0] :] if payload else b""
    size = (body[1] & 15) << 8 | body[2] if len(body) > 2 else 0
    return body[: size - 1] if size >= 9 and body[0] == table and size + 3 <= len(body) else None


def program_pid(payload: bytes) -> int | None:
    """PAT: the map PID of the first program that is not 0."""
    body = _section(payload, 0) or b""
    for at in range(8, len(body) - 3, 4):
        if body[at] or body[at + 1]:
            return (body[at + 2] & 0x1F) << 8 | body[at + 3]
    return None


def _descriptors(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 2 <= len(data) and at + 2 + data[at + 1] <= len(data):
        yield data[at], data[at + 2 : at + 2 + data[at + 1]]
        at += 2 + data[at + 1]


def streams(payload: bytes) -> dict[int, str]:
    """PMT: the codec of each PID that can be read; private streams by their descriptors."""
    body, out = _section(payload, 2) or b"", {}
    at = 12 + ((body[10] & 15) << 8 | body[11]) if len(body) >= 12 else 0
    while at and at + 5 <= len(body):
        size = (body[at + 3] & 15) << 8 | body[at + 4]
        if at + 5 + size > len(body):
            break
        codec = TYPES.get(body[at])
        if body[at] == 0x06:
            for tag, value in _descriptors(body[at + 5 : at + 5 + size]):
                codec = DESCRIPTORS.get(tag) or (NAMES.get(value[:3]) if tag == 0x05 else None) or codec
        if codec:
            out.setdefault((body[at + 1] & 0x1F) << 8 | body[at + 2], codec)
        at += 5 + size
    return out


def pes(data: bytes) -> tuple[int | None, bytes] | None:
    """PTS (null: none) and payload of an elementary packet; null if it is none."""
    if len(data) < 9 or data[:3] != b"\0\0\1" or 9 + data[8] >= len(data):
        return None
    pts = None
    if data[7] & 0x80 and data[8] >= 5:
        a, b, c, d, e = data[9:14]
        pts = (a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1
    return pts, data[9 + data[8] :]


def adts(data: bytes, at: int = 0) -> dict | None:
    """Header and length of the AAC frame that begins at a place."""
    h = data[at : at + 7]
    if len(h) < 7 or h[0] != 0xFF or h[1] & 0xF6 != 0xF0:
        return None
    rate, channels, size = h[2] >> 2 & 15, (h[2] & 1) << 2 | h[3] >> 6, (h[3] & 3) << 11 | h[4] << 3 | h[5] >> 5
    head = 7 if h[1] & 1 else 9
    if rate >= len(ADTS_RATES) or not channels or h[6] & 3 or not head <= size <= len(data) - at:
        return None
    kind = (h[2] >> 6) + 1
    return {"head": head, "size": size, "sample_rate": ADTS_RATES[rate], "channels": channels, "config": bytes([kind << 3 | rate >> 1, (rate & 1) << 7 | channels << 3])}


def adts_frames(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """The AAC frames of a payload; bytes that begin none are passed over."""
    at = data.find(b"\xff")
    while at >= 0 and at + 7 <= len(data):
        if frame := adts(data, at):
            yield frame, data[at + frame["head"] : at + frame["size"]]
            at += frame["size"] - 1
        at = data.find(b"\xff", at + 1)


def h264_size(sps: bytes) -> tuple[int, int] | None:
    """Width and height of a sequence parameter set, its cropping taken off."""
    try:
        bits = Bits(unescaped(sps[1:]))
        profile = bits.read(8)
        bits.read(16)
        bits.ue()
        chroma = 1
        if profile in HIGH_PROFILES:
            chroma = bits.ue()
            if chroma == 3 and bits.read(1):
                chroma = 0
            bits.ue(), bits.ue(), bits.read(1)
            if bits.read(1):
                for i in range(12 if chroma == 3 else 8):
                    last = scale = 8
                    for _ in range((16 if i < 6 else 64) * bits.read(1)):
                        if scale:
                            scale = (last + bits.se()) % 256
                        last = scale or last
        bits.ue()
        order = bits.ue()
        if order == 0:
            bits.ue()
        elif order == 1:
            bits.read(1), bits.se(), bits.se()
            for _ in range(min(257, bits.ue())):
                bits.se()
        bits.ue(), bits.read(1)
        wide, high = bits.ue() + 1, bits.ue() + 1
        fields = 2 - bits.read(1)
        bits.read(2 if fields == 2 else 1)
        left, right, top, bottom = [bits.ue() for _ in range(4)] if bits.read(1) else (0, 0, 0, 0)
    except (ValueError, IndexError, EOFError):
        return None
    size = wide * 16 - (left + right) * (1 if chroma in (0, 3) else 2), high * 16 * fields - (top + bottom) * (2 if chroma == 1 else 1) * fields
    return size if min(size) > 0 else None


def units(data: bytes) -> Iterator[bytes]:
    """What lies between the start codes of a payload."""
    for part in data.split(b"\0\0\1")[1:]:
        if part:
            yield part.rstrip(b"\0") or part[:1]


def _video(codec: str, payload: bytes) -> tuple[tuple[int, int] | None, tuple[int, int] | None, bool]:
    """Size and frame rate where a payload tells them, and whether it is a point to start from."""
    size = rate = None
    sync = False
    for unit in units(payload):
        if codec == "h264":
            sync |= unit[0] & 0x1F == 5
            size = size or (h264_size(unit) if unit[0] & 0x1F == 7 else None)
        elif unit[0] == 0xB3 and len(unit) >= 5:
            size, rate = (unit[1] << 4 | unit[2] >> 4, (unit[2] & 15) << 8 | unit[3]), MPEG2_RATES.get(unit[4] & 15)
        elif unit[0] == 0 and len(unit) >= 3:
            sync |= unit[2] >> 3 & 7 == 1
    return size, rate, sync


def _elementary(data: bytes, own: dict[str, np.ndarray], pid: int) -> Iterator[tuple[int, int | None, bytes]]:
    """(place where it is closed, pts, payload) of each elementary packet of a PID; packets that would make one too large start it anew."""
    mine = np.flatnonzero(own["pid"] == pid)
    heads = np.flatnonzero(own["start"][mine])
    for a, b in zip(heads, [*heads[1:], len(mine)], strict=True):
        parts, size = [], 0
        for i in mine[a:b].tolist():
            part = data[own["begin"][i] : own["end"][i]]
            if size + len(part) > MOST_PES:
                parts, size = [], 0
                continue
            parts.append(part)
            size += len(part)
        if found := pes(b"".join(parts)):
            yield int(mine[b]) if b < len(mine) else len(own["pid"]) + pid, *found


def parse(data: bytes) -> tuple[float, list[tuple[dict, list[tuple]]]]:
    """Duration, and of each track its row and its samples (pts, duration, sync, bytes)."""
    own = packets(data)
    body = lambda i: data[own["begin"][i] : own["end"][i]]
    chosen = next((p for i in np.flatnonzero((own["pid"] == 0) & own["start"]).tolist() if (p := program_pid(body(i))) is not None), None)
    codecs: dict[int, str] = {}
    if chosen is not None:
        for i in np.flatnonzero((own["pid"] == chosen) & own["start"]).tolist():
            codecs = streams(body(i)) | codecs
    found = {pid: list(_elementary(data, own, pid)) for pid in codecs}
    told = sorted((place, pts) for parts in found.values() for place, pts, _ in parts if pts is not None)
    origin = told[0][1] if told else 0
    duration = (told[-1][1] - origin) % WRAP / TICKS if told else 0.0
    out = []
    for number, (pid, codec) in enumerate(codecs.items(), 1):
        video = codec in ("h264", "mpeg2")
        row = {"track_id": number, "pid": pid, "kind": "video" if video else "audio", "codec": codec, "width": None, "height": None, "config": None, "sample_rate": None if video else 48_000, "channels": None if video else 6 if codec == "dts" else 2}
        samples, after, rate, heard = [], 0, (24_000, 1001), False
        for _, pts, payload in found[pid]:
            at = after if pts is None else (pts - origin) % WRAP
            if codec == "aac":
                for frame, raw in adts_frames(payload):
                    if not heard:
                        row |= {k: frame[k] for k in ("sample_rate", "channels", "config")}
                        heard = True
                    ticks = round(1024 * TICKS / frame["sample_rate"])
                    samples.append((at, ticks, True, raw))
                    at += ticks
            elif video:
                size, told_rate, sync = _video(codec, payload)
                if size and row["width"] is None:
                    row["width"], row["height"] = size
                rate = told_rate or rate
                samples.append((at, max(1, round(TICKS * rate[1] / rate[0])) if rate else VIDEO_TICKS, sync, payload))
            else:
                samples.append((at, AUDIO_TICKS, True, payload))
            after = samples[-1][0] + samples[-1][1] if samples else after
        out.append((row, samples))
    return duration if duration > 0 else 1.0, out


def _files(batches) -> Iterator[tuple[str, tuple | Exception]]:
    for batch in batches:
        for path, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            try:
                yield path, parse(content or b"")
            except (Malformed, ValueError, IndexError) as error:
                yield path, error


def tracks(files: DataFrame) -> DataFrame:
    """A row per track; for a file that cannot be read one row with its error."""

    def read(batches):
        schema = _schema(TRACKS)
        for path, found in _files(batches):
            if isinstance(found, Exception):
                yield pa.RecordBatch.from_pylist([{"path": path, "error": str(found)}], schema)
            else:
                yield pa.RecordBatch.from_pylist([row | {"path": path, "duration": found[0], "error": None} for row, _ in found[1]], schema)

    return files.select("path", "content").mapInArrow(read, TRACKS)


def samples(files: DataFrame, track_ids: list[int] | None = None) -> DataFrame:
    """A row per sample of the enabled tracks (null: all), in order of their track. A file that cannot be read has none."""

    def read(batches):
        schema = _schema(SAMPLES)
        for path, found in _files(batches):
            for row, own in [] if isinstance(found, Exception) else found[1]:
                if track_ids is None or row["track_id"] in track_ids:
                    rows = [{"path": path, "track_id": row["track_id"], "idx": i, "time_scale": TICKS, "pts": p, "duration": d, "sync": s, "size": len(b), "data": b} for i, (p, d, s, b) in enumerate(own)]
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(read, SAMPLES)


def seek(found: DataFrame, target: float, video_track: int) -> DataFrame:
    """Where to read on for a target time: of each file the last sync sample of its video track at or before it, else the first one."""
    keys = found.filter((F.col("track_id") == video_track) & F.col("sync")).select("path", "idx", "pts", (F.col("pts") <= int(target * TICKS)).alias("before"))
    best = F.max_by(F.struct("idx", "pts"), F.when(F.col("before"), F.col("pts")).otherwise(-F.col("pts") - 1))
    return keys.groupBy("path").agg(best.alias("k")).select("path", "k.idx", "k.pts")
