"""Queries of relational steps and of readers over files that are made from the driver's tables, each beside its SQL."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelode.plans.catalog import _query, _table
from framelode.sources import status, subtitles, ts


@_query("""
WITH l AS (SELECT event_id, user_id, event_id % 3 AS k, event_type, event_id % 130 AS p FROM events),
v AS (SELECT *, CASE WHEN k <> 1 THEN least(100, p)::DOUBLE END AS progress, CASE WHEN k <> 2 THEN event_type END AS message, CASE WHEN p % 10 = 0 THEN event_type = 'purchase' END AS fin FROM l)
SELECT user_id AS job, event_id AS seq, coalesce(last_value(progress IGNORE NULLS) OVER w, 0) AS progress, coalesce(last_value(message IGNORE NULLS) OVER w, '') AS message, '' AS output, '' AS error, coalesce(last_value(fin IGNORE NULLS) OVER w, false) AS finished
FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def worker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of worker status files, merged onto those before."""
    k, p = F.col("event_id") % 3, F.col("event_id") % 130
    progress = F.when(k != 1, F.concat(F.lit("Progress = "), p.cast("string"), F.lit(" %\r\n"))).otherwise("progress=soon\n")
    message = F.when(k != 2, F.concat(F.lit("message="), "event_type", F.lit("\r\n"))).otherwise("no pair\n")
    done = F.when(p % 10 == 0, F.concat(F.lit("done="), F.when(F.col("event_type") == "purchase", " Yes").otherwise("0"), F.lit("\n"))).otherwise("other=1")
    return status.read_status(_table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.concat(progress, message, done).alias("content")))


@_query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000.0::DOUBLE AS wall_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
k AS (
  SELECT user_id, n, event_id, wall_ms AS last, true AS kept FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.n, e.event_id, CASE WHEN e.wall_ms - k.last >= 7200000 THEN e.wall_ms ELSE k.last END, e.wall_ms - k.last >= 7200000 FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1
)
SELECT user_id, event_id FROM k WHERE kept""")
def thinned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a diagnostic log that come late enough after the last one written."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("wall_ms"))
    return status.thinned(e, "user_id", "wall_ms", 7_200_000.0).select("user_id", "event_id")


@_query("SELECT conv_id, turn, CASE WHEN octet_length(encode(text)) > 40 THEN decode(unhex(regexp_replace(right(hex(encode(text)), 80), '^(?:[89AB][0-9A-F]){1,3}', ''))) ELSE text END AS tail, 'progress=' || printf('%.1f', least(100, turn * 30.0::DOUBLE)) || chr(10) || 'message=' || replace(text, chr(10), ' ') || chr(10) || CASE WHEN role = 'user' THEN 'finished=1' || chr(10) ELSE '' END AS status FROM conversations")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bytes of a log; a worker's status as text."""
    none = F.lit(None).cast("string")
    text = status.status_text(F.col("turn") * 30.0, F.col("text"), none, none, F.col("role") == "user")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", status.log_tail(F.encode("text", "UTF-8"), 40).alias("tail"), text.alias("status"))


@_query("""
WITH h AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM events)
SELECT event_id, coalesce(h::VARCHAR || '+', '') || event_id::VARCHAR AS sample FROM h WHERE event_type = 'purchase'""")
def header_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sequence header before each picture to start from."""
    before = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    h = _table(spark, sf_dir, "events").withColumn("h", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(before))
    return h.filter("event_type = 'purchase'").select("event_id", F.concat(F.coalesce(F.concat(F.col("h").cast("string"), F.lit("+")), F.lit("")), F.col("event_id").cast("string")).alias("sample"))


@_query("SELECT conv_id, max(turn) AS duration, md5(string_agg(text, chr(10) ORDER BY turn)) AS joined, bool_or(role = 'system') AS any_system, bool_and(length(text) > 10) AS all_long, count(*) FILTER (length(text) % 7 <> 0) AS visible FROM conversations GROUP BY conv_id")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest track, elements that show, parts in order, any and all."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    shows = F.count_if(F.length("text") % 7 != 0)
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("duration"), F.md5(joined).alias("joined"), F.bool_or(F.col("role") == "system").alias("any_system"), F.bool_and(F.length("text") > 10).alias("all_long"), shows.alias("visible"))


@_query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events)
SELECT a.user_id, a.event_id, a.n AS place, b.us AS pts FROM e a JOIN e b ON a.user_id = b.user_id AND a.r = b.n WHERE a.n <= 20""")
def probe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index order, the first 20 of a track, the smallest waiting time for each picture that comes out."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    n, r = F.row_number().over(W.partitionBy("user_id").orderBy("us")), F.row_number().over(W.partitionBy("user_id").orderBy("value", "event_id"))
    a = e.select("user_id", "event_id", n.cast("long").alias("place"), r.alias("n"))
    b = e.select("user_id", n.alias("n"), F.col("us").alias("pts"))
    return a.join(b, ["user_id", "n"]).filter("place <= 20").select("user_id", "event_id", "place", "pts")


@_query("""
WITH f AS (SELECT DISTINCT lower(split_part(url, '?', 1)) AS path FROM pages), c AS (SELECT page_id, lower(url) AS path FROM pages)
SELECT page_id, path, path IN (SELECT path FROM f) AS same FROM c""")
def same_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an output is an input, membership in a retained set."""
    p = _table(spark, sf_dir, "pages")
    f = p.select(F.lower(F.split_part("url", F.lit("?"), F.lit(1))).alias("path")).distinct().withColumn("found", F.lit(True))
    return p.select("page_id", F.lower("url").alias("path")).join(f, "path", "left").select("page_id", "path", F.coalesce("found", F.lit(False)).alias("same"))


# --- readers over files made here ----------------------------------------------------------------------------------


def _packets(pid: int, body: bytes, section: bool) -> bytes:
    """TS packets of one section or elementary packet; the last one is filled up by its adaptation field."""
    body, out, at = (b"\0" if section else b"") + body, b"", 0
    while at < len(body):
        part = body[at : at + 184]
        gap = 184 - len(part)
        fill = b"" if not gap else bytes([gap - 1]) + (b"\0" + b"\xff" * (gap - 2) if gap > 1 else b"")
        out += bytes([0x47, (0x40 if at == 0 else 0) | pid >> 8, pid & 255, (0x30 if gap else 0x10)]) + fill + part
        at += 184
    return out


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, 1 | (pts >> 15 & 127) << 1, pts >> 7 & 255, 1 | (pts & 127) << 1])


def transport_stream(parts: list[tuple[int, bytes]], stride: int = 188) -> bytes:
    """A small stream of one AC-3 track: (pts, payload) of each elementary packet."""
    pat = b"\0\xb0\x0d\0\1\xc1\0\0" + struct.pack(">HH", 1, 0xE100) + b"\0\0\0\0"
    pmt = b"\2\xb0\x12\0\1\xc1\0\0\xe1\1\xf0\0" + b"\x81\xe1\1\xf0\0" + b"\0\0\0\0"
    out = _packets(0, pat, True) + _packets(0x100, pmt, True)
    for pts, payload in parts:
        out += _packets(0x101, b"\0\0\1\xbd\0\0\x80\x80\5" + _timestamp(pts) + payload, False)
    lead = b"\0" * 4 if stride == 192 else b""
    return b"".join(lead + out[i : i + 188] + b"\xff" * (stride - 188 - len(lead)) for i in range(0, len(out), 188))


def _stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transport stream per conversation, a sample per turn, whose clock wraps on the way."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))

    def mux(batches):
        for batch in batches:
            for conv, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [((ts.WRAP - 5000 + x["turn"] * 2880) % ts.WRAP, x["text"].encode()) for x in t]
                yield pa.RecordBatch.from_arrays([pa.array([str(conv)]), pa.array([transport_stream(parts, (188, 192, 204)[conv % 3])], pa.binary())], names=["path", "content"])

    return turns.mapInArrow(mux, "path string, content binary")


@_query("""
SELECT conv_id::VARCHAR AS path, 1::BIGINT AS track_id, row_number() OVER w - 1 AS idx, (turn - min(turn) OVER (PARTITION BY conv_id)) * 2880 AS pts, 2880::BIGINT AS duration, octet_length(encode(text))::BIGINT AS size, md5(text) AS digest
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def transport_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of three strides written and read again, over a wrap of their clock."""
    return ts.samples(_stream_files(spark, sf_dir), [1]).select("path", "track_id", "idx", "pts", "duration", "size", F.md5("data").alias("digest"))


@_query("""
SELECT conv_id::VARCHAR AS path, 257::BIGINT AS pid, 'ac3' AS codec, 48000::BIGINT AS sample_rate, CASE WHEN max(turn) = min(turn) THEN 1 ELSE (max(turn) - min(turn)) * 2880 / 90000.0::DOUBLE END AS duration
FROM conversations GROUP BY conv_id""")
def transport_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs, tracks and durations of the same streams."""
    return ts.tracks(_stream_files(spark, sf_dir)).select("path", "pid", "codec", "sample_rate", "duration")


@_query("""
WITH k AS (SELECT conv_id, turn, (turn - min(turn) OVER (PARTITION BY conv_id)) * 2880 AS pts, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations)
SELECT conv_id::VARCHAR AS path, max(idx) AS idx, max(pts) AS pts FROM k WHERE pts <= 9000 GROUP BY conv_id""")
def transport_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last point to start from before a tenth of a second."""
    return ts.seek(ts.samples(_stream_files(spark, sf_dir)), 0.1, 1)


@_query(r"""
WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
d AS (SELECT conv_id, n, n * 3.5::DOUBLE AS s, n * 3.5::DOUBLE + 2.125 AS e, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS t FROM c)
SELECT conv_id::VARCHAR || '.srt' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1)::BIGINT AS seq, s AS "start", e AS "end", md5(t) AS digest FROM d WHERE t <> ''""")
def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as SubRip files and read again; the turns hold no tags."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    c = _table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(".srt")).alias("path"), n.cast("long").alias("seq"), (n * 3.5).alias("start"), (n * 3.5 + 2.125).alias("end"), "text")
    files = subtitles.srt_text(c).select("path", F.encode("content", "UTF-8").alias("content"))
    return subtitles.cues(files).select("path", "seq", "start", "end", F.md5("text").alias("digest"))
