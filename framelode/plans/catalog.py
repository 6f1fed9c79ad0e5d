"""The registered queries over the driver's tables, each beside its SQL.

The tables are no media files: a query runs an operator's relational core on a table that has its shape, as its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelode.functions import audio, matching, text
from framelode.operators import cues, timeline

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds."""
    return _table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def _hours(events: DataFrame) -> DataFrame:
    """Every hour mark from the first event's hour to the last one's, in microseconds."""
    hour = 3_600_000_000
    return events.agg(F.floor(F.min("us") / hour).alias("a"), F.floor(F.max("us") / hour).alias("b")).select(F.explode(F.sequence("a", "b")).alias("h")).select((F.col("h") * hour).alias("target"))


_EV = "ev AS (SELECT *, epoch_us(ts) AS us FROM events)"
_HOURS = "hours AS (SELECT unnest(range((SELECT min(us) // 3600000000 FROM ev), (SELECT max(us) // 3600000000 + 1 FROM ev))) * 3600000000 AS target)"


@_query("""
SELECT conv_id AS track_id, turn AS idx,
       coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       octet_length(encode(text))::BIGINT AS size, role = 'user' AS sync
FROM conversations""")
def sample_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as samples; byte offset, size, sync flag."""
    size = F.octet_length("text").cast("long")
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track_id"), F.col("turn").alias("idx"), timeline.exclusive_sum(size, ["conv_id"], ["turn"]).alias("offset"), size.alias("size"), (F.col("role") == "user").alias("sync"))


@_query("""
SELECT l_orderkey, count(*) AS samples, sum(v)::BIGINT AS total, max(pos)::BIGINT AS last_pos
FROM (SELECT l_orderkey, l_linenumber AS v, unnest(range(l_quantity::INT)) AS pos FROM lineitem) GROUP BY l_orderkey""")
def sample_rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as runs of l_quantity durations."""
    runs = timeline.expand_runs(_table(spark, sf_dir, "lineitem"), "l_quantity", ["l_orderkey", "l_linenumber"])
    return runs.groupBy("l_orderkey").agg(F.count("*").alias("samples"), F.sum("l_linenumber").cast("long").alias("total"), F.max("pos").cast("long").alias("last_pos"))


@_query(f"""
WITH {_EV}, first AS (SELECT user_id, us // 86400000000 AS day, min(us) AS first_us FROM ev GROUP BY ALL)
SELECT event_id, ev.user_id, f.day AS chunk FROM ev ASOF JOIN first f ON ev.user_id = f.user_id AND ev.us >= f.first_us""")
def chunk_map_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's chunk, the last one of its user that began at or before it."""
    ev = _events(spark, sf_dir).select("event_id", "user_id", "us")
    first = ev.groupBy("user_id", F.expr("us div 86400000000").alias("chunk")).agg(F.min("us").alias("first_us"))
    return timeline.asof(ev, first, ["user_id"], "us", "first_us", "chunk").select("event_id", "user_id", "chunk")


@_query("""
SELECT conv_id, count(*) AS samples, count(*) FILTER (role = 'user') AS sync_samples, min(turn) FILTER (role = 'user') AS first_sync FROM conversations GROUP BY conv_id""")
def sync_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as the sync set, probed by a join."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    sync = turns.filter("role = 'user'").select("conv_id", "turn", F.lit(True).alias("sync"))
    flagged = turns.join(sync, ["conv_id", "turn"], "left").withColumn("sync", F.coalesce("sync", F.lit(False)))
    return flagged.groupBy("conv_id").agg(F.count("*").alias("samples"), F.count_if("sync").alias("sync_samples"), F.min(F.when(F.col("sync"), F.col("turn"))).alias("first_sync"))


@_query(f"WITH {_EV} SELECT user_id, round(count(*) * 1000000.0 / nullif(max(us) - min(us), 0), 9) AS rate FROM ev GROUP BY user_id")
def avg_frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per second of each user."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.round(F.try_divide(F.count("*") * 1_000_000.0, F.max("us") - F.min("us")), 9).alias("rate"))


@_query("""
SELECT user_id, count(*) AS samples, count(value) - count(DISTINCT value) AS duplicate_pts, count(*) FILTER (value < before) AS backwards_pts, min(value) AS min_pts, max(value) AS max_pts
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id""")
def timeline_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as timestamps."""
    return timeline.summary(_table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value")


@_query(f"""
WITH {_EV}, g AS (SELECT user_id, us - lag(us + 1000000) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM ev)
SELECT user_id, greatest(max(gap), 0)::BIGINT AS max_gap_us, greatest(-min(gap), 0)::BIGINT AS max_overlap_us, count(*) FILTER (gap > 100) AS failures FROM g GROUP BY user_id""")
def gap_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one second each; gaps and overlaps."""
    ev = _events(spark, sf_dir).select("user_id", "event_id", "us", (F.col("us") + 1_000_000).alias("end"))
    g = timeline.gaps(ev, ["user_id"], ["us", "event_id"], "us", "end")
    return g.groupBy("user_id").agg(F.greatest(F.max("gap"), F.lit(0)).alias("max_gap_us"), F.greatest(-F.min("gap"), F.lit(0)).alias("max_overlap_us"), F.count_if(F.col("gap") > 100).alias("failures"))


@_query("""
SELECT user_id, count(DISTINCT event_type) AS signatures, count(*) FILTER (event_type = a) AS adjacent, count(*) FILTER (event_type = b AND event_type <> a) AS two_back
FROM (SELECT *, lag(event_type) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id""")
def dup_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as frame signatures."""
    one, two = timeline.repeats("event_type", ["user_id"], ["event_id"])
    ev = _table(spark, sf_dir, "events").select("user_id", "event_type", one.alias("one"), two.alias("two"))
    return ev.groupBy("user_id").agg(F.count_distinct("event_type").alias("signatures"), F.count_if("one").alias("adjacent"), F.count_if("two").alias("two_back"))


@_query(f"""
WITH {_EV}, {_HOURS}, k AS (SELECT us, event_id FROM ev WHERE event_type = 'purchase')
SELECT target, coalesce(k.event_id, (SELECT event_id FROM k ORDER BY us LIMIT 1)) AS event_id FROM hours ASOF LEFT JOIN k ON hours.target >= k.us""")
def seek_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase at or before each hour mark, else the first."""
    ev = _events(spark, sf_dir)
    key = ev.filter("event_type = 'purchase'").select("us", "event_id")
    one = lambda df: df.withColumn("file", F.lit(0))
    found = timeline.asof(one(_hours(ev)), one(key), ["file"], "target", "us", "event_id")
    first = key.agg(F.min_by("event_id", "us").alias("first"))
    return found.crossJoin(F.broadcast(first)).select("target", F.coalesce("event_id", "first").alias("event_id"))


@_query(f"""
WITH {_EV}, {_HOURS}, u AS (SELECT DISTINCT user_id FROM ev), t AS (SELECT user_id, target FROM u, hours WHERE target % 86400000000 = 0)
SELECT t.user_id, target, e.event_id FROM t ASOF LEFT JOIN ev e ON t.user_id = e.user_id AND t.target <= e.us""")
def align_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event at or after each day mark."""
    ev = _events(spark, sf_dir).select("user_id", "event_id", "us")
    marks = _hours(ev).filter("target % 86400000000 = 0")
    return timeline.asof(ev.select("user_id").distinct().join(F.broadcast(marks)), ev, ["user_id"], "target", "us", "event_id", forward=True)


@_query(f"WITH {_EV} SELECT (us + 59999999) // 60000000 AS tick, arg_max(event_id, us) AS event_id, count(*) - 1 AS skipped FROM ev GROUP BY 1")
def acquire_at_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event since the last minute tick, and those skipped."""
    return _events(spark, sf_dir).groupBy(F.expr("(us + 59999999) div 60000000").alias("tick")).agg(F.max_by("event_id", "us").alias("event_id"), (F.count("*") - 1).alias("skipped"))


@_query(f"WITH {_EV}, f AS (SELECT (min(us) + max(us)) // 2 AS floor FROM ev) SELECT event_id, us FROM ev, f WHERE us + 1000000 > floor")
def seek_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one second that end after the middle of the timeline."""
    ev = _events(spark, sf_dir).select("event_id", "us")
    return ev.join(F.broadcast(ev.agg(F.expr("(min(us) + max(us)) div 2").alias("floor"))), F.col("us") + 1_000_000 > F.col("floor")).select("event_id", "us")


@_query(f"WITH {_EV} SELECT event_id, user_id FROM (SELECT *, min(us) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS first FROM ev) WHERE us >= first")
def await_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events from the first purchase on."""
    return timeline.from_first(_events(spark, sf_dir), ["user_id"], "us", F.col("event_type") == "purchase").select("event_id", "user_id")


@_query(f"WITH {_EV} SELECT event_id, row_number() OVER (PARTITION BY us // 86400000000 ORDER BY us, event_type, event_id) AS place FROM ev")
def merge_by_dts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which tracks (event types) interleave, for each day."""
    order = W.partitionBy(F.expr("us div 86400000000")).orderBy("us", "event_type", "event_id")
    return _events(spark, sf_dir).select("event_id", F.row_number().over(order).cast("long").alias("place"))


@_query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 16")
def latest_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last events that each user's bounded buffer holds."""
    return timeline.top(_table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 16).select("event_id", "user_id")


@_query("""
SELECT c_nationkey, c_custkey, score FROM (
  SELECT *, 1000 * (c_mktsegment = 'BUILDING')::INT + 100 * (c_acctbal > 0)::INT + 10 * (c_custkey % 2 = 0)::INT AS score FROM customer)
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) = 1""")
def top1_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scored row of each group, the first of equals."""
    flag = lambda c: c.cast("int")
    score = 1000 * flag(F.col("c_mktsegment") == "BUILDING") + 100 * flag(F.col("c_acctbal") > 0) + 10 * flag(F.col("c_custkey") % 2 == 0)
    return timeline.top(_table(spark, sf_dir, "customer").withColumn("score", score), ["c_nationkey"], [F.desc("score"), "c_custkey"]).select("c_nationkey", "c_custkey", "score")


_CUES = "c AS (SELECT event_id AS seq, us / 1e6 AS s, us / 1e6 + abs(value) * 60 AS e FROM ev WHERE value IS NOT NULL AND value <> 0)"


def _event_cues(ev: DataFrame) -> DataFrame:
    return ev.filter("value is not null and value <> 0").select(F.col("event_id").alias("seq"), (F.col("us") / 1e6).alias("start"), (F.col("us") / 1e6 + F.abs("value") * 60).alias("end"))


@_query(f"WITH {_EV}, {_HOURS}, {_CUES} SELECT target / 1e6 AS at, count(*) AS active, max(seq) AS latest FROM hours JOIN c ON s <= target / 1e6 AND target / 1e6 < e GROUP BY target")
def cues_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of `value` minutes; those active at each hour mark, and the latest."""
    ev = _events(spark, sf_dir)
    points = _hours(ev).select((F.col("target") / 1e6).alias("at"))
    return cues.active(points, _event_cues(ev), 3600.0).groupBy("at").agg(F.count("*").alias("active"), F.max("seq").alias("latest"))


@_query(f"""
WITH {_EV}, {_HOURS}, {_CUES}, n AS (SELECT *, row_number() OVER (ORDER BY s, e, seq) AS n FROM c),
l AS (SELECT target / 1e6 AS "at", max(n) AS last FROM hours JOIN n ON s <= target / 1e6 GROUP BY target),
b AS (SELECT "at", n.seq, n.n, e > "at" AS alive FROM l JOIN n ON n.n BETWEEN last - 7 AND last),
h AS (SELECT *, count(*) FILTER (alive) OVER (PARTITION BY "at" ORDER BY n DESC) AS hits FROM b),
t AS (SELECT *, count(*) FILTER (NOT alive AND hits > 0) OVER (PARTITION BY "at" ORDER BY n DESC) AS stops FROM h)
SELECT "at", seq FROM t WHERE alive AND stops = 0""")
def cues_backscan8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cues_overlap, by the scan of eight with its stop rule."""
    ev = _events(spark, sf_dir)
    return cues.back_scan(_hours(ev).select((F.col("target") / 1e6).alias("at")), _event_cues(ev))


@_query(f"WITH {_EV} SELECT event_id, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us), us + 5000000) AS end_us FROM ev")
def next_sync_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event ends where its user's next begins, the last after five seconds."""
    nxt = F.lead("us").over(W.partitionBy("user_id").orderBy("us"))
    return _events(spark, sf_dir).select("event_id", F.coalesce(nxt, F.col("us") + 5_000_000).alias("end_us"))


@_query(f"""
WITH {_EV}, g AS (SELECT us, us - lag(us) OVER (PARTITION BY us // 3600000000 ORDER BY us) AS gap FROM ev)
SELECT us // 3600000000 AS bucket, count(*) AS calls, max(gap) AS max_gap_us FROM g GROUP BY 1""")
def interval_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and the longest wait in each hour."""
    bucket = F.expr("us div 3600000000")
    ev = _events(spark, sf_dir).select("us", bucket.alias("bucket"))
    ev = ev.withColumn("gap", F.col("us") - F.lag("us").over(W.partitionBy("bucket").orderBy("us")))
    return ev.groupBy("bucket").agg(F.count("*").alias("calls"), F.max("gap").alias("max_gap_us"))


@_query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock FROM events")
def monotonic_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock that never runs back."""
    so_far = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return _table(spark, sf_dir, "events").select("event_id", F.max("value").over(so_far).alias("clock"))


@_query(f"""
WITH {_EV}, t AS (SELECT event_id, user_id, us, (us // 1000 * 90) % 8589934592 AS ticks FROM ev),
o AS (SELECT user_id, arg_min(ticks, us) AS origin FROM t GROUP BY user_id)
SELECT event_id, ((ticks - origin) % 8589934592 + 8589934592) % 8589934592 AS pts FROM t JOIN o USING (user_id)""")
def pts_unwrap33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 kHz counters of 33 bits, counted from each user's first."""
    t = _events(spark, sf_dir).select("event_id", "user_id", "us", F.expr("(us div 1000 * 90) % 8589934592").alias("ticks"))
    origin = t.groupBy("user_id").agg(F.min_by("ticks", "us").alias("origin"))
    return t.join(origin, "user_id").select("event_id", timeline.unwrap(F.col("ticks"), F.col("origin")).alias("pts"))


@_query("""
SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, b: a + 0.1 * (b - a)), 6) AS latency
FROM events WHERE value > 0 AND value < 1000000 GROUP BY user_id""")
def ema_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential filter seeded by its first observation."""
    seen = _table(spark, sf_dir, "events").filter("value > 0 and value < 1000000")
    ordered = F.sort_array(F.collect_list(F.struct("event_id", "value")))
    return seen.groupBy("user_id").agg(ordered.alias("x")).select("user_id", F.round(audio.ema(F.transform("x", lambda x: x["value"])), 6).alias("latency"))


@_query("""
SELECT event_id // 50 AS bin, round(ln(1 + sqrt(avg(value * value)) * 1000), 6) AS energy FROM events GROUP BY 1 HAVING count(*) = 50""")
def energy_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log energy of full bins of fifty."""
    return audio.envelope(_table(spark, sf_dir, "events"), "event_id", "value", 50)


@_query(f"""
WITH {_EV}, w AS (SELECT us, value, unnest(range(greatest(0, (us // 3600000000 - a - 2) // 10), (us // 3600000000 - a) // 10 + 1)) AS w, us // 3600000000 - a AS h
  FROM ev, (SELECT min(us) // 3600000000 AS a FROM ev))
SELECT w AS hop, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE h >= w * 10 AND h < w * 10 + 12 GROUP BY w""")
def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve hours every ten."""
    ev = _events(spark, sf_dir)
    first = ev.agg(F.expr("min(us) div 3600000000").alias("a"))
    h = ev.join(F.broadcast(first)).withColumn("h", F.expr("us div 3600000000 - a"))
    return h.withColumn("hop", F.explode(audio.hops(F.col("h"), 12, 10))).groupBy("hop").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_X = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"


def _pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@_query(f"SELECT vec_id, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms FROM ({_X}) GROUP BY vec_id")
def pcm_peak_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05, A08."""
    return _pcm(spark, sf_dir).select("vec_id", F.round(audio.peak("x"), 6).alias("peak"), F.round(audio.rms("x"), 6).alias("rms"))


@_query(f"""
SELECT vec_id, sum(q)::BIGINT AS q_sum, min(q)::BIGINT AS q_min, max(q)::BIGINT AS q_max, sum(q * i)::BIGINT AS q_dot
FROM (SELECT vec_id, i, round(CASE WHEN c < 0 THEN c * 32768 ELSE c * 32767 END)::BIGINT AS q FROM (SELECT *, greatest(-1, least(1, x)) AS c FROM ({_X}))) GROUP BY vec_id""")
def pcm16_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 16 bits."""
    q = _pcm(spark, sf_dir).select("vec_id", audio.to_pcm16("x").alias("q"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return q.select("vec_id", total("q").alias("q_sum"), F.array_min("q").alias("q_min"), F.array_max("q").alias("q_max"), total(F.transform("q", lambda x, i: x * i)).alias("q_dot"))


@_query(f"SELECT vec_id, i // 2 AS frame, round(avg(x), 6) AS mono FROM ({_X}) GROUP BY ALL")
def pcm_mono_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of samples as stereo frames."""
    return _pcm(spark, sf_dir).select("vec_id", F.posexplode(audio.mono("x")).alias("frame", "m")).select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("m", 6).alias("mono"))


@_query(f"""
WITH f AS (SELECT vec_id, i // 6 AS frame, list(x ORDER BY i) AS c FROM ({_X}) WHERE i < 60 GROUP BY ALL)
SELECT vec_id, frame, round(greatest(-1, least(1, c[1] + 0.7071067811865476 * c[3] + 0.7071067811865476 * c[5] + 0.5 * c[4])), 6) AS l,
  round(greatest(-1, least(1, c[2] + 0.7071067811865476 * c[3] + 0.7071067811865476 * c[6] + 0.5 * c[4])), 6) AS r FROM f""")
def pcm_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of six channels to stereo."""
    f = _pcm(spark, sf_dir).select("vec_id", F.posexplode(audio.frames(F.slice("x", 1, 60), 6)).alias("frame", "c"))
    left, right = audio.downmix(F.col("c"), 6)
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(left, 6).alias("l"), F.round(right, 6).alias("r"))


_TAPS = ", ".join(f"{x!r}::DOUBLE" for x in audio.low_pass())


@_query(f"""
WITH t AS (SELECT unnest([{_TAPS}]) AS tap, generate_subscripts([{_TAPS}], 1) - 1 AS k), x AS ({_X})
SELECT vec_id, x.i // 3 AS n, round(greatest(-1, least(1, sum(tap * y.x))), 6) AS v
FROM x JOIN t ON x.i % 3 = 0 AND t.k <= x.i JOIN x y USING (vec_id) WHERE y.i = x.i - t.k GROUP BY ALL""")
def fir_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """63 taps, every third output, limited to 1."""
    return _pcm(spark, sf_dir).select("vec_id", F.posexplode(audio.fir("x", 3)).alias("n", "v")).select("vec_id", F.col("n").cast("long").alias("n"), F.round("v", 6).alias("v"))


_PAIR = f"p AS (SELECT a.vec_id, a.i, a.x, b.x AS y FROM ({_X}) a JOIN ({_X}) b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _pcm(spark, sf_dir)
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@_query(f"WITH {_PAIR} SELECT vec_id, round(sqrt(sum(x * x) / sum(y * y)), 6) AS level, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS correlation FROM p GROUP BY vec_id")
def level_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector against the next one; uncentred correlation."""
    level, correlation = audio.compare("x", "y")
    return _pairs(spark, sf_dir).select("vec_id", F.round(level, 6).alias("level"), F.round(correlation, 6).alias("correlation"))


@_query(f"""
WITH {_PAIR}, l AS (SELECT unnest(range(-8, 9)) AS lag),
c AS (SELECT a.vec_id, lag, coalesce(covar_pop(a.x, b.y) / nullif(sqrt(var_pop(a.x) * var_pop(b.y)), 0), -1) AS c
  FROM p a, l JOIN p b ON b.vec_id = a.vec_id AND b.i = a.i + lag WHERE a.i BETWEEN 8 AND 55 GROUP BY ALL)
SELECT vec_id, lag, round(c, 6) AS corr FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, lag) = 1""")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of the highest centred correlation, the lowest of equals."""
    return _pairs(spark, sf_dir).select("vec_id", audio.best_lag("x", "y", 8, 48, 8).alias("b")).select("vec_id", F.col("b.lag").cast("long").alias("lag"), F.round("b.corr", 6).alias("corr"))


def _entity_sql(column: str) -> str:
    for name, sign in text.ENTITIES:
        column = f"regexp_replace({column}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}', 'gi')"
    return column


@_query(f"SELECT page_id, md5({_entity_sql('html')}) AS decoded FROM pages")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """six entities, one after the other."""
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text.decode_entities(F.col("html"))).alias("decoded"))


def _strip_sql(column: str) -> str:
    lines = rf"regexp_replace({column}, '(?i)<(?:[^<>]*<)*\s*(?:br/?|/?p)\s*>', chr(10), 'g')"
    plain = _entity_sql(f"regexp_replace({lines}, '<[^>]*(>|$)', '', 'g')")
    return rf"array_to_string(list_filter(list_transform(string_split({plain}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))"


@_query(f"SELECT page_id, {_strip_sql('html')} AS plain FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tags out, line tags as line ends, entities, blank lines."""
    return _table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@_query("SELECT lang, CASE WHEN replace(lower(lang), '_', '-') LIKE 'zh%' THEN 'zh' ELSE split_part(replace(lower(lang), '_', '-'), '-', 1) END AS base, count(*) AS n, CASE WHEN lang IN ('zh', 'ja', 'ko') THEN 22 WHEN lang IN ('hi', 'ar') THEN 36 ELSE 42 END AS width FROM documents GROUP BY lang")
def base_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, F19, P07."""
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", text.base_language(F.col("lang")).alias("base"), "n", text.line_width(F.col("lang")).alias("width"))


@_query(r"""
WITH v AS (SELECT doc_id, translate(coalesce(text, ''), chr(13) || chr(10) || chr(9), '   ') AS v, CASE WHEN lang IN ('zh', 'ja', 'ko') THEN 22 WHEN lang IN ('hi', 'ar') THEN 36 ELSE 42 END AS width FROM documents),
m AS (SELECT *, length(v) AS n, length(v) // 2 AS mid FROM v),
s AS (SELECT *, CASE WHEN contains(substr(v, 1, mid + 1), ' ') THEN mid + 1 - strpos(reverse(substr(v, 1, mid + 1)), ' ') END AS a, CASE WHEN contains(substr(v, mid + 2), ' ') THEN mid + strpos(substr(v, mid + 2), ' ') END AS b FROM m),
c AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN least(width, (n + 1) // 2) WHEN b IS NULL OR mid - a <= b - mid THEN a ELSE b END AS k FROM s)
SELECT doc_id, CASE WHEN n <= width THEN v ELSE rtrim(substr(v, 1, k), ' ') || CASE WHEN ltrim(substr(v, k + 1), ' ') <> '' THEN chr(10) || ltrim(substr(v, k + 1), ' ') ELSE '' END END AS wrapped FROM c""")
def wrap_two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole documents as one cue each, wrapped."""
    own = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("s"), F.coalesce(text.line_width(F.col("lang")), F.lit(42)).alias("width"))
    return own.select("doc_id", text.wrap_two_lines("s", "width").alias("wrapped"))


_SRT = "lpad((ms // 3600000)::VARCHAR, greatest(2, length((ms // 3600000)::VARCHAR))::INTEGER, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0')"


def _event_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    return ev.join(F.broadcast(_events(spark, sf_dir).agg(F.min("us").alias("first")))).select("event_id", ((F.col("us") - F.col("first")) / 1e6).alias("s"))


_SECONDS = "s AS (SELECT event_id, ((us - (SELECT min(us) FROM ev)) / 1e6)::DOUBLE AS s FROM ev)"


@_query(f"WITH {_EV}, {_SECONDS}, m AS (SELECT *, round(s * 1000)::BIGINT AS ms, floor(s + 0.5)::BIGINT AS w FROM s) SELECT event_id, {_SRT} AS srt, CASE WHEN w >= 3600 THEN (w // 3600)::VARCHAR || ':' ELSE '' END || lpad((w // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((w % 60)::VARCHAR, 2, '0') AS clock FROM m")
def srt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times since the first event, of over 100 hours, too."""
    return _event_seconds(spark, sf_dir).select("event_id", text.srt_time(F.col("s")).alias("srt"), text.media_time(F.col("s")).alias("clock"))


@_query(f"WITH {_EV}, {_SECONDS} SELECT event_id, round(s * 1000)::BIGINT / 1000.0::DOUBLE AS seconds FROM s")
def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted times, read again."""
    return _event_seconds(spark, sf_dir).select("event_id", F.round(text.parse_srt_time(text.srt_time(F.col("s"))), 6).alias("seconds"))


@_query("SELECT page_id, list_filter(list_transform(string_split(url, '.'), lambda x: lower(trim(x))), lambda x: x <> '').array_to_string('|') AS tokens FROM pages")
def dot_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urls as names with dots."""
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(matching.dot_tokens(F.col("url")), "|").alias("tokens"))


@_query("""
WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS t FROM part), c AS (SELECT p_partkey, k, count(*) AS n FROM (SELECT p_partkey, unnest(t) AS k FROM t) GROUP BY ALL),
m AS (SELECT a.p_partkey, sum(least(a.n, b.n))::BIGINT AS common FROM c a JOIN c b ON b.p_partkey = a.p_partkey + 1 AND a.k = b.k GROUP BY ALL)
SELECT a.p_partkey, coalesce(common, 0) AS common,
  coalesce(list_position(list_transform(range(1, least(len(a.t), len(b.t)) + 1), lambda i: a.t[i] = b.t[i]), false) - 1, least(len(a.t), len(b.t)))::BIGINT AS leading
FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1 LEFT JOIN m ON m.p_partkey = a.p_partkey""")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a part's name shares with the next one's."""
    a = _table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("a"))
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", matching.common_tokens(F.col("a"), F.col("b")).alias("common"), matching.leading_tokens(F.col("a"), F.col("b")).alias("leading"))


@_query("SELECT d.doc_id, coalesce('q' || quality::VARCHAR, 'lang-' || lang, '[' || d.doc_id || ']') AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def catalog_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label, else the language, else the key in brackets."""
    d, lab = _table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("lang-"), "lang"), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))).alias("label"))


@_query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one catalog that the other lacks."""
    a, b = _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").distinct().withColumn("side", F.lit("missing")).unionByName(b.join(a, "doc_id", "left_anti").distinct().withColumn("side", F.lit("extra")))


@_query("""
WITH t AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(text, '[a-z]{6,}'))) AS t FROM conversations)
SELECT a.conv_id, a.turn, len(a.t) AS tokens, a.t = b.t AS same FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def token_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of a turn against the next turn's."""
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{6,})"), F.lit(1)))).alias("a"))
    return t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"]).select("conv_id", "turn", F.size("a").cast("long").alias("tokens"), (F.col("a") == F.col("b")).alias("same"))


@_query("SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to their dimensions. Nations and regions are fixed, 25 and 5 rows."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    s = _table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@_query("""
WITH i AS (SELECT vec_id, unnest(range(0, 21)) AS i, embedding FROM embeddings),
c AS (SELECT vec_id, i, unnest([0, 1, 2]) AS k, least(1, greatest(0, embedding[3 * i + 1 + unnest([0, 1, 2])]::DOUBLE)) AS e FROM i),
p AS (SELECT *, pow(e, 1 / 78.84375) AS p FROM c),
n AS (SELECT *, 10000 * pow(greatest(p - 0.8359375, 0) / (18.8515625 - 18.6875 * p), 1 / 0.1593017578125) AS n FROM p),
w AS (SELECT vec_id, i, max(n) FILTER (k = 0) AS r, max(n) FILTER (k = 1) AS g, max(n) FILTER (k = 2) AS b FROM n GROUP BY ALL),
l AS (SELECT vec_id, i, greatest(0, 1.660496 * r - 0.587656 * g - 0.072840 * b) / 203 AS r, greatest(0, -0.124547 * r + 1.132895 * g - 0.008348 * b) / 203 AS g, greatest(0, -0.018154 * r - 0.100597 * g + 1.118751 * b) / 203 AS b FROM w),
y AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y FROM l),
s AS (SELECT *, CASE WHEN y > 1e-6 THEN (1 + y / pow(1000.0 / 203, 2)) / (1 + y) ELSE 0 END AS s FROM y)
SELECT vec_id, i, round(pow(least(1, r * s), 1 / 2.2::DOUBLE), 6) AS r, round(pow(least(1, g * s), 1 / 2.2::DOUBLE), 6) AS g, round(pow(least(1, b * s), 1 / 2.2::DOUBLE), 6) AS b FROM s""")
def tone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three values of a vector as one picture element."""
    rgb = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(i.cast("long").alias("i"), audio.tone_map(F.slice("x", i * 3 + 1, F.lit(3))).alias("c")))
    out = _pcm(spark, sf_dir).select("vec_id", F.explode(rgb).alias("p"))
    return out.select("vec_id", "p.i", *[F.round(F.get("p.c", F.lit(k)), 6).alias(n) for k, n in enumerate("rgb")])


@_query("""
WITH p AS (SELECT p_partkey, p_size * 16 - 32 AS w, (51 - p_size) * 9 AS h, CASE WHEN p_partkey % 7 = 0 THEN 1000.0::DOUBLE ELSE (p_partkey % 40) / 16.0::DOUBLE END AS a FROM part),
q AS (SELECT *, w * CASE WHEN a BETWEEN 0.01 AND 100 THEN a ELSE 1 END / h AS shape FROM p),
f AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 OR shape > 1920.0::DOUBLE / 1080 THEN 1920 ELSE greatest(1, least(1920, round(1080 * shape))) END::BIGINT AS out_w,
  CASE WHEN w <= 0 OR h <= 0 OR NOT shape > 1920.0::DOUBLE / 1080 THEN 1080 ELSE greatest(1, least(1080, round(1920 / shape))) END::BIGINT AS out_h FROM q)
SELECT p_partkey, out_w, out_h, (1920 - out_w) // 2 AS x, (1080 - out_h) // 2 AS y FROM f""")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes as frames, fitted into 1920 x 1080, with sizes and aspects that are none."""
    aspect = F.when(F.col("p_partkey") % 7 == 0, 1000.0).otherwise((F.col("p_partkey") % 40) / 16.0)
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16 - 32).alias("w"), ((51 - F.col("p_size")) * 9).alias("h"), aspect.alias("a"))
    return p.select("p_partkey", *audio.letterbox(F.col("w"), F.col("h"), F.col("a"), 1920, 1080))


from framelode.plans import media, scalars  # noqa: E402, F401 (they register their queries)
