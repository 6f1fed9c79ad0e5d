"""Parts of large files: positional reads by byte range, so that metadata costs its own bytes and not the file's.

Paths may have any scheme that pyarrow knows; a path without one is local. A read that cannot be made gives an error, never an exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "path string, offset long, size long, data binary, error string"


class RandomAccess:
    """A file that is read at any place; ranges past its end are an error."""

    def __init__(self, path: str):
        system, inner = (fs.FileSystem.from_uri(path)) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def read(self, offset: int, size: int) -> bytes:
        if offset < 0 or size < 0 or offset + size > self.size:
            raise ValueError(f"{size} bytes at {offset} lie outside of {self.size}")
        self.file.seek(offset)
        out = b""
        while len(out) < size:
            more = self.file.read(size - len(out))
            if not more:
                raise ValueError(f"only {len(out)} of {size} bytes at {offset}")
            out += more
        return out

    def close(self) -> None:
        self.file.close()


def parts(wanted: DataFrame) -> DataFrame:
    """Each range with its data or error. wanted: path, offset, size."""

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            open_: tuple[str, RandomAccess] | None = None
            for path, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, error = None, None
                try:
                    if open_ is None or open_[0] != path:
                        if open_:
                            open_[1].close()
                        open_ = (path, RandomAccess(path))
                    data = open_[1].read(offset, size)
                except (OSError, ValueError, pa.ArrowException) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((path, pa.string()), (offset, pa.int64()), (size, pa.int64()), (data, pa.binary()), (error, pa.string()))], names=["path", "offset", "size", "data", "error"])
            if open_:
                open_[1].close()

    return wanted.select("path", "offset", "size").mapInArrow(read, PART)


def split(files: DataFrame, stride: int, each: int) -> DataFrame:
    """(path, offset, size): ranges of whole strides, `each` strides at most. files: path, length."""
    step = stride * each
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("long"))).alias("offset"))
    return starts.select("path", "offset", F.least(F.lit(step).cast("long"), F.col("length") - F.col("offset")).alias("size"))
