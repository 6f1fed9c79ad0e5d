"""Shared pieces: where intermediate tables go, Arrow text as bytes, and words with their hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that outlive an executor: spark.checkpoint.dir, or in local mode one made here."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="framelode-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Cut:
    """A table written to the shared folder and read back; its lineage is one scan. It belongs to the innermost open Scope, if any."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/framelode/{tag}-{uuid.uuid4().hex}"
        self.dropped = False
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _SCOPES:
            _SCOPES[-1].tables.append(self)

    def drop(self) -> None:
        """Removes the files, once nothing reads them any more."""
        if not self.dropped:
            self.dropped = True
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


class Scope:
    """The tables cut while it is open; they are deleted when it closes, but for those kept, which pass to the scope around it."""

    def __init__(self):
        self.tables: list[Cut] = []
        self.stays: list[Cut] = []

    def kept(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes df, which may read the scope's tables, as one that outlives the scope."""
        self.stays.append(Cut(df, tag))
        return self.stays[-1].df

    def __enter__(self) -> Scope:
        _SCOPES.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        _SCOPES.remove(self)
        for table in self.tables:
            if table not in self.stays:
                table.drop()
        if _SCOPES:
            _SCOPES[-1].tables += self.stays


_SCOPES: list[Scope] = []


def cut(df: DataFrame, tag: str) -> DataFrame:
    return Cut(df, tag).df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """All columns as one struct `row`, with copies of the needed ones: names of other columns cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(c) for c in needed])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def lower_ascii(column):
    """A-Z to a-z, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- Arrow text as bytes -------------------------------------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and the len + 1 offsets into them; null counts as empty. No copy without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte boundary of one text, the code points before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Word bytes of the two word contracts, after folding A-Z.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_MULTIPLIER, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLES: dict[int, np.ndarray] = {}
PIECE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _TABLES or len(_TABLES[base]) < n:
        table = np.full(max(n, 2 * PIECE), np.uint64(base))
        table[0] = 1
        _TABLES[base] = np.cumprod(table)
    return _TABLES[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of texts, A-Z folded: byte starts, ends, 64-bit hashes, and for each text where its words begin.

    Works through the bytes in pieces that end where a word ends, so its own memory is bounded by the piece or the longest word.
    """
    n = len(data)
    opens = offsets[:-1][offsets[:-1] < n]
    starts, ends, hashes = [], [], []
    at = 0
    while at < n:
        to = min(n, at + PIECE)
        while to < n:  # on to the end of a word
            ahead = kind[_FOLD[data[to : to + 4096]]]
            stop = int(np.argmin(ahead))
            if not ahead[stop]:
                to += stop
                break
            to += len(ahead)
        b = _FOLD[data[at:to]]
        w = kind[b]
        own = opens[np.searchsorted(opens, at) : np.searchsorted(opens, to)] - at
        before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        before[own] = False
        after[own[own > 0] - 1] = False
        s, e = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        sums = np.empty(len(b) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_CODE[b] * _powers(_MULTIPLIER, len(b))[: len(b)], out=sums[1:])
        hashes.append(mixed((sums[e] - sums[s]) * _powers(_INVERSE, len(b))[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not starts:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offsets)


def word_hashes(text: str, kind: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), kind)[2]


def runs_of(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Splits rows into consecutive groups whose totals stay under `most`, one row at least; total: running sums, 0 first."""
    at, n = 0, len(total) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, to
        at = to


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows whose texts in a column stay under `most` bytes, one row at least: bounds what is at work at once."""
    for batch in batches:
        own = batch.column(column)
        if not len(own):
            yield batch
            continue
        size = np.frombuffer(own.buffers()[1], np.int64 if pa.types.is_large_string(own.type) else np.int32)[own.offset : own.offset + len(own) + 1]
        for a, b in runs_of(size.astype(np.int64), most):
            yield batch.slice(a, b - a)
