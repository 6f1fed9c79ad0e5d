"""Bits and bytes: readers, checksums, NAL units, FLAC frames."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_INFLATED = 64 << 20


class Bits:
    """Reads bits, high ones first; raises EOFError past the end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise EOFError("bits")
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.read(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n

    def ue(self) -> int:
        """Exp-Golomb, 31 zeros at most."""
        zeros = self.unary()
        if zeros > 31:
            raise ValueError("exp-golomb")
        return (1 << zeros) - 1 + self.read(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def crc(data: bytes, width: int, poly: int) -> int:
    """A plain remainder: no reflection, 0 at the start."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, 0
    for b in data:
        out ^= b << (width - 8)
        for _ in range(8):
            out = ((out << 1) ^ poly if out & top else out << 1) & mask
    return out


def unescaped(nal: bytes) -> bytes:
    """Without the 3 of each 00 00 03."""
    out, zeros = bytearray(), 0
    for b in nal:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def annex_b(sample: bytes, length_size: int) -> bytes:
    """Length-prefixed units with start codes; a damaged tail is left out."""
    out, at = bytearray(), 0
    while at + length_size <= len(sample):
        size = int.from_bytes(sample[at : at + length_size], "big")
        at += length_size
        if not size or at + size > len(sample):
            break
        out += b"\0\0\0\1" + sample[at : at + size]
        at += size
    return bytes(out)


def nal_types(stream: bytes, hevc: bool = False) -> list[int]:
    out, at = [], stream.find(b"\0\0\1")
    while 0 <= at < len(stream) - 3:
        head = stream[at + 3]
        out.append((head >> 1) & 63 if hevc else head & 31)
        at = stream.find(b"\0\0\1", at + 3)
    return out


def inflate(data: bytes) -> bytes | None:
    """zlib data with its checksum, MOST_INFLATED bytes at most; null for anything else."""
    try:
        d = zlib.decompressobj()
        out = d.decompress(data, MOST_INFLATED)
        return out if d.eof else None
    except zlib.error:
        return None


@F.pandas_udf(T.BinaryType())
def inflate_zlib(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else inflate(bytes(x)))


# Fixed values of the FLAC frame header.
_BLOCKS = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _residual(bits: Bits, block: int, order: int) -> list[int]:
    method = bits.read(2)
    if method > 1:
        raise ValueError("residual method")
    parts = 1 << bits.read(4)
    out: list[int] = []
    for p in range(parts):
        rice = bits.read(4 + method)
        n = block // parts - (order if p == 0 else 0)
        if rice == (15, 31)[method]:
            width = bits.read(5)
            out += [bits.signed(width) for _ in range(n)]
        else:
            for _ in range(n):
                u = (bits.unary() << rice) | bits.read(rice)
                out.append(u >> 1 if u % 2 == 0 else -(u >> 1) - 1)
    return out


def _subframe(bits: Bits, block: int, depth: int) -> list[int]:
    if bits.read(1):
        raise ValueError("subframe padding")
    kind = bits.read(6)
    wasted = bits.unary() + 1 if bits.read(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * block
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        taps, shift = _FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            precision, shift = bits.read(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("predictor")
            taps = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, block, order):
            out.append(r + (sum(t * out[-1 - i] for i, t in enumerate(taps)) >> shift))
    else:
        raise ValueError("subframe kind")
    return [x << wasted for x in out]


def flac_frame(data: bytes, depth: int = 16) -> list[list[int]]:
    """The channels of one frame; raises on a bad checksum or syntax. depth: the stream's own, where the frame names none."""
    if crc(data, 16, 0x8005):
        raise ValueError("frame checksum")
    bits = Bits(data)
    if bits.read(14) != 0x3FFE or bits.read(1):
        raise ValueError("sync")
    bits.read(1)
    block_code, rate_code, layout, depth_code = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    bits.read(1)
    lead = bits.read(8)
    for _ in range(0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()):
        bits.read(8)
    block = bits.read(8) + 1 if block_code == 6 else bits.read(16) + 1 if block_code == 7 else _BLOCKS[block_code]
    if rate_code in (12, 13, 14):
        bits.read(8 if rate_code == 12 else 16)
    used = len(data) - bits.left // 8
    if crc(data[: used + 1], 8, 0x07):
        raise ValueError("header checksum")
    bits.read(8)
    depth = _DEPTHS.get(depth_code, depth)
    channels = layout + 1 if layout < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(layout)
    out = [_subframe(bits, block, depth + (c == side)) for c in range(channels)]
    a, b = (out[0], out[1]) if channels > 1 else (out[0], [])
    if layout == 8:
        out = [a, [x - y for x, y in zip(a, b, strict=True)]]
    elif layout == 9:
        out = [[x + y for x, y in zip(a, b, strict=True)], b]
    elif layout == 10:
        middle = [(x << 1) | (y & 1) for x, y in zip(a, b, strict=True)]
        out = [[(m + y) >> 1 for m, y in zip(middle, b, strict=True)], [(m - y) >> 1 for m, y in zip(middle, b, strict=True)]]
    return out
