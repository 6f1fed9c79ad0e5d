"""Worker status files, log tails, diagnostic logs, raw sample files."""

from __future__ import annotations

import os
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelode.functions.text import status_flag, status_progress, trim_ascii

# The keys of a status file, each with its other name.
KEYS = {"progress": ["progress"], "message": ["message"], "output": ["output", "output_path"], "error": ["error", "error_message"], "finished": ["finished", "done"]}
TRIES, PAUSE = 20, 0.05


def read_status(files: DataFrame) -> DataFrame:
    """Each snapshot merged onto those before it: what it does not tell stays. files: job, seq, content. A row per snapshot that tells anything."""
    lines = files.select("job", "seq", F.posexplode(F.split("content", "\n", -1)).alias("line", "body")).filter(F.contains("body", F.lit("=")))
    body = F.regexp_replace("body", "\r$", "")
    pair = lines.select("job", "seq", "line", F.lower(trim_ascii(F.substring_index(body, "=", 1))).alias("key"), F.expr("substring(regexp_replace(body, '\\r$', ''), instr(body, '=') + 1)").alias("value"))
    # a progress that is no number tells nothing
    pair = pair.filter((F.col("key") != "progress") | status_progress(F.col("value")).isNotNull())
    told = pair.groupBy("job", "seq").agg(*[F.max_by("value", F.when(F.col("key").isin(names), F.col("line"))).alias(k) for k, names in KEYS.items()], F.count_if(F.col("key").isin([n for names in KEYS.values() for n in names])).alias("n")).filter("n > 0")
    so_far = W.partitionBy("job").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    last = lambda k: F.last(k, ignorenulls=True).over(so_far)
    return told.select("job", "seq", F.coalesce(status_progress(last("progress")), F.lit(0.0)).alias("progress"), *[F.coalesce(last(k), F.lit("")).alias(k) for k in ("message", "output", "error")], F.coalesce(status_flag(last("finished")), F.lit(False)).alias("finished"))


def status_text(progress: Column, message: Column, output: Column, error: Column, finished: Column) -> Column:
    """A status file's content: progress from 0 to 100 with one place, values on one line each."""
    clean = lambda c: F.regexp_replace(c, "[\r\n]", " ")
    line = lambda key, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{key}="), clean(c), F.lit("\n"))).otherwise("")
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), progress))
    return F.concat(F.lit("progress="), F.format_string("%.1f", bounded), F.lit("\nmessage="), clean(message), F.lit("\n"), line("output", output), line("error", error), F.when(finished, "finished=1\n").otherwise(""))


def write_atomically(path: str, content: bytes) -> None:
    """Beside the file first, then in its place; tried again while something holds it."""
    part = f"{path}.part.{os.getpid()}"
    with open(part, "wb") as out:
        out.write(content)
    for left in reversed(range(TRIES)):
        try:
            os.replace(part, path)
            return
        except PermissionError:
            if not left:
                os.unlink(part)
                raise
            time.sleep(PAUSE)


def log_tail(content: Column, most: int) -> Column:
    """The last bytes of a log as text, from the first whole character on."""
    tail = F.substring(content, F.greatest(F.lit(1), F.octet_length(content) - most + 1), F.lit(most))
    hexed = F.hex(tail)
    # continuation bytes at the start belong to a character that was cut
    return F.when(F.octet_length(content) > most, F.decode(F.unhex(F.regexp_replace(hexed, "^(?:[89AB][0-9A-F]){1,3}", "")), "UTF-8")).otherwise(F.decode(content, "UTF-8"))


def thinned(rows: DataFrame, session: str, at: str, least: float) -> DataFrame:
    """Of each session's rows those that come `least` or more after the last one that stayed; the first stays. Groups stream through sorted."""
    wanted = rows.schema

    def thin(batches):
        own, last = None, 0.0
        for batch in batches:
            keep = []
            for key, t in zip(batch.column(session).to_pylist(), batch.column(at).to_pylist(), strict=True):
                stays = own != (key,) or t - last >= least
                if stays:
                    own, last = (key,), t
                keep.append(stays)
            yield pc.filter(batch, pa.array(keep))

    return rows.repartition(session).sortWithinPartitions(session, at).mapInArrow(thin, wanted)


def write_video_sync(rows: DataFrame, path: str, session: str = "session") -> None:
    """The A/V log as CSV: rows of a session 100 ms apart or more."""
    thinned(rows, session, "wall_ms", 100.0).write.option("header", True).csv(path)


def write_audio_clock(rows: DataFrame, path: str, session: str = "session") -> None:
    """The audio clock's log as CSV: rows of a session one second apart or more."""
    thinned(rows, session, "wall_ms", 1000.0).write.option("header", True).csv(path)


@F.pandas_udf(T.BinaryType())
def float_bytes(samples: pd.Series) -> pd.Series:
    """Interleaved samples as little-endian 32-bit floats."""
    return samples.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())
