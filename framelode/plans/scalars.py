"""Queries of scalar functions over the driver's tables, each beside its SQL. The tables stand in for tracks and pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.functions import audio, text, tracks
from framelode.plans.catalog import _query, _table


def _pick(values: list, at: Column) -> Column:
    return F.get(F.lit(values), at.cast("int"))


def _sql_list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in values) + "]"


@_query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN round(l_orderkey / (l_linenumber - 1), 6) ELSE 0 END AS seconds,
  CASE WHEN l_linenumber <> 1 THEN round(l_partkey / (l_linenumber - 1), 6) ELSE 1 END AS ratio,
  greatest(1, round(90000.0::DOUBLE * CASE WHEN l_linenumber <> 1 AND l_partkey > 0 THEN l_linenumber - 1 ELSE 1001 END / CASE WHEN l_linenumber <> 1 AND l_partkey > 0 THEN l_partkey ELSE 24000 END))::BIGINT AS ticks,
  greatest(0, least(25, l_quantity - 20)) AS seek,
  CASE WHEN l_quantity + 1024 / 48000.0::DOUBLE <= 20.01 THEN 1024 WHEN l_quantity < 20.01 THEN least(1024, ceil(greatest(0, (20.01 - l_quantity) * 48000 - 1e-9)))::BIGINT ELSE 0 END AS cut
FROM lineitem""")
def track_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as seconds, rates, seek targets, frames cut at a seek."""
    scale = F.col("l_linenumber") - 1
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(tracks.in_seconds(F.col("l_orderkey"), scale), 6).alias("seconds"), F.round(tracks.ratio(F.col("l_partkey"), scale, 1.0), 6).alias("ratio"),
        tracks.frame_ticks(F.col("l_partkey"), scale).alias("ticks"), tracks.seek_target(F.col("l_quantity"), F.lit(45.0)).alias("seek"),
        tracks.trimmed_frames(F.col("l_quantity"), F.lit(1024), F.lit(48000), F.lit(20.01)).alias("cut"),
    ).withColumn("seek", F.greatest(F.lit(0.0), F.col("seek") - 20))


@_query("SELECT event_id, ((epoch_us(ts) % 1000000000)::HUGEINT * (user_id * 7919 + 1) + 500)::HUGEINT // 1000 AS us FROM events")
def timecode_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block time codes of a time scale as microseconds."""
    code = F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000_000
    return _table(spark, sf_dir, "events").select("event_id", tracks.microseconds(code, F.col("user_id") * 7919 + 1).alias("us"))


_CODECS = ["aac", "mp3", "opus", "flac", "ac3", "eac3", "dts", "vorbis", "pcm"]
_EXT = ["mp4", "MKV", "avi", "ts", "m2ts", "Mts", "mov", "txt"]


@_query(f"""
SELECT p_partkey, {_sql_list(_CODECS)}[p_size % 9 + 1] IN ('aac', 'mp3', 'opus', 'flac', 'ac3', 'eac3', 'dts') AS supported,
  {_sql_list(["AAC-LC", "MP3", "Opus", "FLAC", "AC-3", "E-AC-3", "DTS", "Unknown", "Unknown"])}[p_size % 9 + 1] AS label, p_size % 8 < 6 AS playable,
  n BETWEEN 16 AND 23 AS irap, n IN (19, 20) AS idr, n BETWEEN 16 AND 18 AS bla, n IN (8, 9) AS rasl, n BETWEEN 16 AND 23 OR n IN (1, 3, 5, 7, 9) AS reference
FROM (SELECT *, p_partkey % 32 AS n FROM part) WHERE p_size % 2 = 1 OR p_partkey = 7""")
def codec_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be played, kinds of units, one chosen track of a kind."""
    p = _table(spark, sf_dir, "part").withColumn("track_id", F.col("p_partkey")).withColumn("kind", F.when(F.col("p_size") % 2 == 1, "video").otherwise("audio"))
    codec, path = _pick(_CODECS, F.col("p_size") % 9), F.concat(F.lit("/films/a.b/"), "p_name", F.lit("."), _pick(_EXT, F.col("p_size") % 8))
    own = tracks.selected(p, "audio", 7)
    return own.select("p_partkey", tracks.supported_audio(codec).alias("supported"), tracks.audio_label(codec).alias("label"), tracks.supported_path(path).alias("playable"), *tracks.nal_flags(F.col("p_partkey") % 32))


@_query("SELECT p_partkey, gcd(p_partkey * p_size, 1080)::BIGINT AS divisor, (p_partkey * p_size // gcd(p_partkey * p_size, 1080))::BIGINT AS num, (1080 // gcd(p_partkey * p_size, 1080))::BIGINT AS den, CASE WHEN p_size <= 1 THEN 0 ELSE length(bin(p_size - 1)) END::BIGINT AS bits FROM part")
def reduced_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios in lowest terms; bits that tell values apart."""
    value = F.col("p_partkey") * F.col("p_size")
    own = _table(spark, sf_dir, "part").select("p_partkey", value.alias("v"), tracks.greatest_divisor(value, F.lit(1080)).alias("divisor"), tracks.ceil_log2(F.col("p_size")).alias("bits"))
    return own.select("p_partkey", "divisor", F.floor(F.col("v") / F.col("divisor")).alias("num"), F.floor(1080 / F.col("divisor")).alias("den"), "bits")


_MATRIX, _TRANSFER, _PRIMARIES = ["bt709", "bt601", "bt2020", "unspecified", None], ["pq", "hlg", "bt709"], ["bt709", "bt601", "bt2020"]


@_query(f"""
WITH p AS (SELECT p_partkey, p_size * 20 AS height, {_sql_list(_MATRIX)}[p_partkey % 5 + 1] AS m, {_sql_list(_TRANSFER)}[p_partkey % 3 + 1] AS t, {_sql_list(_PRIMARIES)}[p_size % 3 + 1] AS q, p_partkey % 2 = 0 AS rgb, p_size % 2 = 0 AS whole, p_partkey % 7 < 3 AS tl FROM part),
c AS (SELECT *, coalesce(m, CASE WHEN height > 576 THEN 'bt709' ELSE 'bt601' END) AS matrix, CASE WHEN whole THEN 'full' ELSE 'studio' END AS reach, CASE WHEN tl THEN 'topleft' ELSE 'left' END AS side FROM p)
SELECT p_partkey, matrix, 'limited' AS "range", 'left' AS chroma,
  CASE t WHEN 'pq' THEN CASE WHEN rgb THEN 'rgb_full_g2084_none_p2020' WHEN NOT whole THEN 'ycbcr_studio_g2084_' || side || '_p2020' END
         WHEN 'hlg' THEN CASE WHEN NOT rgb THEN 'ycbcr_' || reach || '_ghlg_topleft_p2020' END
         ELSE CASE WHEN rgb THEN CASE WHEN matrix = 'bt2020' OR q = 'bt2020' THEN 'rgb_full_g22_none_p2020' ELSE 'rgb_full_g22_none_p709' END
                   WHEN matrix = 'bt2020' OR q = 'bt2020' THEN CASE WHEN whole THEN 'ycbcr_full_g22_left_p2020' ELSE 'ycbcr_studio_g22_' || side || '_p2020' END
                   WHEN matrix IN ('bt709', 'unspecified') OR q = 'bt709' THEN 'ycbcr_' || reach || '_g22_left_p709'
                   WHEN whole THEN 'ycbcr_full_g22_none_p709_x601' ELSE 'ycbcr_studio_g22_left_p601' END END AS space
FROM c""")
def color_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours that are not told, and the space that a picture is shown in."""
    p = _table(spark, sf_dir, "part").select("*", _pick(_MATRIX, F.col("p_partkey") % 5).alias("m"), _pick(_TRANSFER, F.col("p_partkey") % 3).alias("t"), _pick(_PRIMARIES, F.col("p_size") % 3).alias("q"))
    none = F.lit(None).cast("string")
    c = p.select("p_partkey", "p_size", *tracks.color_defaults(F.col("p_size") * 20, {"matrix": F.col("m"), "range": none, "chroma": none, "primaries": F.col("q"), "transfer": F.col("t")}))
    space = tracks.input_color_space(F.col("p_partkey") % 2 == 0, F.col("p_size") % 2 == 0, F.col("transfer"), F.col("matrix"), F.col("primaries"), F.col("p_partkey") % 7 < 3)
    return c.select("p_partkey", "matrix", "range", "chroma", space.alias("space"))


_LANG = ["en", "und", "", "de-AT"]


@_query(f"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'Forced ' || c_name ELSE c_name END AS name, {_sql_list(_CODECS)}[c_custkey % 9 + 1] AS codec,
  {_sql_list(["AAC-LC", "MP3", "Opus", "FLAC", "AC-3", "E-AC-3", "DTS", "Unknown", "Unknown"])}[c_custkey % 9 + 1] AS label, {_sql_list(_LANG)}[c_custkey % 4 + 1] AS lang, {_sql_list(["ass", "vobsub", "srt"])}[c_custkey % 3 + 1] AS sub FROM customer),
d AS (SELECT *, CASE WHEN lang IN ('', 'und') THEN '' ELSE ' [' || lang || ']' END AS told, CASE WHEN c_custkey % 6 = 0 THEN ' [Default]' ELSE '' END AS def, CASE sub WHEN 'ass' THEN 'ASS' WHEN 'vobsub' THEN 'VobSub' ELSE 'SRT/UTF-8' END AS kind FROM c)
SELECT c_custkey, (c_custkey + 1)::VARCHAR || '. ' || CASE WHEN name = '' THEN label ELSE name || ' — ' || label END || CASE WHEN label = 'Unknown' THEN ' [Not Support]' ELSE '' END || told || ', 48000 Hz' || CASE WHEN c_custkey % 7 > 0 THEN ', ' || (c_custkey % 7)::VARCHAR || ' ch' ELSE '' END || def AS audio,
  (c_custkey + 1)::VARCHAR || '. ' || CASE WHEN name = '' THEN kind ELSE name || ' — ' || kind END || told || def || CASE WHEN c_custkey % 2 = 0 AND NOT contains(name, 'Forced') THEN ' [Forced]' ELSE '' END AS subtitle,
  CASE c_custkey % 3 WHEN 0 THEN 'H.264' WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'HEVC Main 10' ELSE 'HEVC Main' END ELSE 'Microsoft MPEG-4 v3' END || '  ' || (c_custkey * 2)::VARCHAR || '×' || c_custkey::VARCHAR
    || CASE WHEN c_custkey % 4 > 0 THEN '  ' || printf('%.3f', 24000 / (c_custkey % 4 * 1000)::DOUBLE) || ' fps' ELSE '' END || CASE WHEN label <> 'Unknown' THEN '  ·  ' || label || ' 48000 Hz 2 ch' ELSE '' END AS description
FROM d""")
def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of tracks, one line about a file."""
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, "").when(key % 5 == 0, F.concat(F.lit("Forced "), "c_name")).otherwise(F.col("c_name"))
    c = _table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), _pick(_CODECS, key % 9).alias("codec"), _pick(_LANG, key % 4).alias("lang"), _pick(["ass", "vobsub", "srt"], key % 3).alias("sub"), _pick(["h264", "hevc", "msmpeg4"], key % 3).alias("video"))
    rate = F.when(key % 4 > 0, 24_000 / (key % 4 * 1000))
    sound = F.when(tracks.supported_audio(F.col("codec")), tracks.audio_label(F.col("codec")))
    return c.select(
        "c_custkey", tracks.audio_track_label(key, F.col("name"), F.col("codec"), F.col("lang"), F.lit(48_000), key % 7, key % 6 == 0, "Default").alias("audio"),
        tracks.subtitle_track_label(key, F.col("name"), F.col("sub"), F.col("lang"), key % 6 == 0, key % 2 == 0, "Default").alias("subtitle"),
        tracks.description(tracks.video_label(F.col("video"), key % 2 == 0), key * 2, key, rate, sound, F.lit(48_000), F.lit(2)).alias("description"),
    )


_LOCALES = ["ja-JP", "ko", "fr-CA", "es", "pt-BR", "hi", "id", "ar-EG", "zh-TW", "zh-Hant-HK", "zh_CN", "de-DE", "en-GB", "ZH_TW"]


@_query(f"""
WITH s AS (SELECT s_suppkey, {_sql_list(_LOCALES)}[s_suppkey % 14 + 1] AS l FROM supplier), b AS (SELECT *, replace(lower(l), '_', '-') AS low FROM s), c AS (SELECT *, CASE WHEN low LIKE 'zh%' THEN 'zh' ELSE split_part(low, '-', 1) END AS base FROM b)
SELECT s_suppkey, CASE WHEN low LIKE 'zh%' THEN CASE WHEN l LIKE '%TW%' OR l LIKE '%HK%' OR l LIKE '%MO%' OR l LIKE '%Hant%' THEN 'zh-TW' ELSE 'zh-CN' END WHEN base IN ('ja', 'ko', 'fr', 'es', 'pt', 'hi', 'id', 'ar') THEN base ELSE 'en' END AS system,
  CASE WHEN base = 'zh' THEN CASE WHEN low = 'zh-tw' THEN 'zh-TW' ELSE 'zh-CN' END WHEN base IN ('en', 'ja', 'ko', 'fr', 'es', 'pt', 'hi', 'id', 'ar') THEN base END AS target,
  '/films/s.' || s_suppkey::VARCHAR || '.' || CASE WHEN base = 'zh' THEN 'zh-CN' ELSE base END || '.whisper.srt' AS path
FROM c""")
def locale_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of locales, languages to translate to, names of made subtitles."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", _pick(_LOCALES, F.col("s_suppkey") % 14).alias("l"))
    path = F.concat(F.lit("/films/s."), F.col("s_suppkey").cast("string"), F.lit(".mkv"))
    return s.select("s_suppkey", text.system_language(F.col("l")).alias("system"), text.target_language(F.col("l")).alias("target"), text.source_subtitle_path(path, F.col("l")).alias("path"))


@_query("""
WITH p AS (SELECT p_partkey, (p_partkey * 37 % 55000 + 1)::INTEGER AS c, CASE WHEN p_partkey % 3 = 0 THEN 'Serif' END AS own FROM part)
SELECT p_partkey, CASE WHEN c BETWEEN 2304 AND 2431 THEN 'Nirmala UI' WHEN own IS NOT NULL THEN own WHEN c BETWEEN 12352 AND 12543 OR c BETWEEN 13312 AND 40959 OR c BETWEEN 44032 AND 55215 THEN 'Malgun Gothic' ELSE 'Segoe UI' END AS font,
  c BETWEEN 1424 AND 2303 AS rtl FROM p""")
def script_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts by script, of one letter each."""
    code = F.lpad(F.hex(F.col("p_partkey") * 37 % 55000 + 1), 4, "0")
    letter = F.decode(F.unhex(code), "UTF-16BE")
    own = F.when(F.col("p_partkey") % 3 == 0, "Serif")
    return _table(spark, sf_dir, "part").select("p_partkey", text.subtitle_font(F.concat(F.lit("a"), letter), own).alias("font"), text.right_to_left(F.concat(F.lit("a"), letter)).alias("rtl"))


@_query(r"""
WITH c AS (SELECT conv_id, turn, chr(9) || ' ' || text || chr(13) || chr(10) || '{\an8}' || '\N' || turn::VARCHAR || ' ' AS t FROM conversations)
SELECT conv_id, turn, md5(lower(t)) AS low, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS trimmed, md5(replace(t, chr(13), '')) AS lines,
  md5(regexp_replace(replace(regexp_replace(regexp_replace(t, '\{[^}]*(\}|$)', '', 'g'), '\\[Nn]', chr(10), 'g'), '\h', ' '), '\s+$', '', 'g')) AS plain,
  turn AS number, CASE WHEN turn % 2 = 0 THEN turn END AS some FROM c""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case, ends, line ends, overrides, numbers."""
    turn = F.col("turn").cast("string")
    t = F.concat(F.lit("\t "), "text", F.lit("\r\n{\\an8}\\N"), turn, F.lit(" "))
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    some = F.concat(turn, F.when(F.col("turn") % 2 == 0, "").otherwise("x"))
    return c.select("conv_id", "turn", F.md5(F.lower("t")).alias("low"), F.md5(text.trim(F.col("t"))).alias("trimmed"), F.md5(F.replace("t", F.lit("\r"), F.lit(""))).alias("lines"), F.md5(text.embedded_plain(F.col("t"))).alias("plain"), text.unsigned(turn).alias("number"), text.unsigned(some).alias("some"))


@_query("""
WITH p AS (SELECT p_partkey, p_size - 25 AS v, p_partkey % 200 AS f, p_partkey % 256 AS g, p_size % 4 AS r, p_partkey % 40 AS c FROM part)
SELECT p_partkey, round(sign(v) * pow(abs(v), 4 / 3.0::DOUBLE) * pow(2, (f - 100) * 0.25), 4) AS value,
  round((32 + g % 32) / 64.0::DOUBLE * pow(2, CASE WHEN g // 32 >= 4 THEN g // 32 - 8 ELSE g // 32 END + 1), 9) AS gain,
  CASE WHEN r > 2 OR c >= 38 THEN 0 WHEN r = 0 THEN [32,40,48,56,64,80,96,112,128,160,192,224,256,320,384,448,512,576,640][c // 2 + 1] * 2
    WHEN r = 1 THEN [69,87,104,121,139,174,208,243,278,348,417,487,557,696,835,975,1114,1253,1393][c // 2 + 1] + c % 2 ELSE [32,40,48,56,64,80,96,112,128,160,192,224,256,320,384,448,512,576,640][c // 2 + 1] * 3 END::BIGINT AS words
FROM p""")
def audio_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients, gains and frame sizes of coded audio."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(audio.dequantize(size - 25, key % 200), 4).alias("value"), F.round(audio.gain_of((key % 256).cast("int")), 9).alias("gain"), audio.ac3_frame_words(size % 4, (key % 40).cast("int")).alias("words"))


@_query("""
WITH RECURSIVE s AS (
  SELECT 0 AS i, 1779033703::BIGINT AS x UNION ALL
  SELECT i + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT i, xor(b, b >> 17) AS c FROM (SELECT i, xor(x, (x << 13) & 4294967295) AS b FROM s)) WHERE i < 500
)
SELECT i::BIGINT AS i, round(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END / 2147483647.0::DOUBLE, 9) AS noise FROM s WHERE i > 0""")
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 values of the generator that fills noise bands."""
    return spark.range(1).select(F.posexplode(audio.noise(1779033703, 500)).alias("i", "noise")).select((F.col("i") + 1).cast("long").alias("i"), F.round("noise", 9).alias("noise"))


@_query("""
WITH RECURSIVE p AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) * 4) AS p FROM embeddings),
g AS (
  SELECT vec_id, p, 1 AS i, CASE WHEN p[1] > 0.98 THEN 0.98 / p[1] ELSE 1 END::DOUBLE AS g FROM p UNION ALL
  SELECT vec_id, p, i + 1, CASE WHEN t < g THEN t ELSE g + (t - g) * (1 - exp(-1024 / 48000.0::DOUBLE)) END FROM (SELECT *, CASE WHEN p[i + 1] > 0.98 THEN 0.98 / p[i + 1] ELSE 1 END::DOUBLE AS t FROM g WHERE i < 64)
)
SELECT vec_id, i::BIGINT AS i, round(g, 6) AS gain FROM g""")
def limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter's gain from frame to frame; a vector's values as peaks."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 4).alias("p"))
    gains = F.posexplode(audio.limiter_gains(F.col("p"), 48_000)).alias("i", "gain")
    return e.select("vec_id", gains).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("gain", 6).alias("gain"))


_UNITS = "SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 1000) % 24)::BIGINT) AS u FROM embeddings"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 24).alias("u"))


@_query(f"""
WITH RECURSIVE u AS ({_UNITS}),
s AS (
  SELECT vec_id, u, 0 AS i, 0::BIGINT AS low, 0::BIGINT AS high FROM u UNION ALL
  SELECT vec_id, u, i + 1, u[i + 1] % 16, CASE WHEN u[i + 1] % 16 < low AND low - u[i + 1] % 16 >= 8 THEN high + 16 WHEN u[i + 1] % 16 > low AND u[i + 1] % 16 - low > 8 THEN high - 16 ELSE high END FROM s WHERE i < 64
)
SELECT vec_id, i::BIGINT AS i, high + low AS poc FROM s WHERE i > 0""")
def order_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture order counts from four low bits."""
    orders = F.posexplode(tracks.unwrapped_order(F.transform("u", lambda x: x % 16), 4)).alias("i", "poc")
    return _units(spark, sf_dir).select("vec_id", orders).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), "poc")


@_query(f"""
WITH RECURSIVE u AS ({_UNITS}),
s AS (
  SELECT vec_id, u, 0 AS i, 0 AS state, -1::BIGINT AS n FROM u UNION ALL
  SELECT vec_id, u, i + 1, CASE WHEN state = 0 THEN CASE WHEN u[i + 1] BETWEEN 16 AND 23 THEN CASE WHEN u[i + 1] IN (19, 20) THEN 2 ELSE 1 END ELSE 0 END WHEN state = 1 AND u[i + 1] NOT IN (8, 9) THEN 2 ELSE state END, u[i + 1] FROM s WHERE i < 64
)
SELECT vec_id, i::BIGINT AS i, NOT (state = 1 AND n IN (8, 9)) AS kept FROM s WHERE i > 0""")
def leading_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading pictures after the first random access."""
    kept = F.posexplode(tracks.kept_after_reset(F.col("u"))).alias("i", "kept")
    return _units(spark, sf_dir).select("vec_id", kept).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), "kept")


@_query("""
WITH n AS (SELECT unnest([128, 1024]) AS n), i AS (SELECT n, unnest(range(n)) AS i FROM n), x AS (SELECT n, i, pi() * CASE n WHEN 128 THEN 6 ELSE 4 END * sqrt(greatest(0, 1 - pow(2.0::DOUBLE * i / (n - 1) - 1, 2))) AS x FROM i),
b AS (SELECT n, i, list_sum(list_transform(range(0, 60), lambda k: exp(2 * k * ln(greatest(x, 1e-300) / 2) - 2 * lgamma(k + 1)))) AS b FROM x)
SELECT n::BIGINT AS n, i, round(sin(pi() * (i + 0.5) / (2 * n)), 6) AS sine, round(sqrt(sum(b) OVER (PARTITION BY n ORDER BY i) / sum(b) OVER (PARTITION BY n)), 6) AS kbd FROM b""")
def block_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sine and Kaiser-Bessel derived windows of both block lengths, as literal arrays."""
    rows = [(n, i, s, k) for n, alpha in ((128, 6.0), (1024, 4.0)) for i, (s, k) in enumerate(zip(audio.sine_window(n), audio.kbd_window(n, alpha), strict=True))]
    return spark.createDataFrame(rows, "n long, i long, sine double, kbd double").select("n", "i", F.round("sine", 6).alias("sine"), F.round("kbd", 6).alias("kbd"))


@_query("""
WITH e AS (SELECT event_id, value, event_id % 5 > 0 AS opened, event_id % 4 = 0 AS paused, CASE WHEN event_id % 3 = 0 THEN value * 2 END AS audio, [0.25, 0.5, 0.75, 1, 1.25, 1.5, 2, 4][event_id % 8 + 1]::DOUBLE AS speed FROM events)
SELECT event_id, round(CASE WHEN opened THEN greatest(0, least(100, CASE WHEN paused THEN value ELSE coalesce(audio, 5 + value * speed) END)) ELSE 0 END, 6) AS clock,
  CASE WHEN speed < 0.49 THEN 0.5 WHEN speed < 0.74 THEN 0.75 WHEN speed < 0.99 THEN 1 WHEN speed < 1.24 THEN 1.25 WHEN speed < 1.49 THEN 1.5 WHEN speed < 1.99 THEN 2 ELSE 0.5 END::DOUBLE AS faster, greatest(0.25, least(4, value / 10)) AS bounded,
  NOT paused AND 1 / nullif((event_id % 60) / 1000.0::DOUBLE, 0) BETWEEN 23 AND 31 IS TRUE AS doubled,
  CASE WHEN 10.0::DOUBLE + 0.075 < p THEN 'reset' WHEN 10.0::DOUBLE + 0.0005 < p THEN 'wait' WHEN 10 - p > 0.075 THEN 'drop' ELSE 'show' END AS late
FROM (SELECT *, 9.9 + (event_id % 400) / 2000.0::DOUBLE AS p FROM e)""")
def player_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock, speeds, doubling, late pictures."""
    key, value = F.col("event_id"), F.col("value")
    e = _table(spark, sf_dir, "events").withColumn("speed", _pick([0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 4.0], key % 8))
    clock = tracks.player_clock(key % 5 > 0, key % 4 == 0, value, F.when(key % 3 == 0, value * 2), F.lit(5.0), value, F.col("speed"), F.lit(100.0))
    return e.select(
        "event_id", F.round(clock, 6).alias("clock"), tracks.next_speed(F.col("speed")).alias("faster"), tracks.bounded_speed(value / 10).alias("bounded"),
        tracks.interpolates(key % 4 == 0, (key % 60) / 1000.0).alias("doubled"), tracks.lateness(F.lit(10.0), 9.9 + (key % 400) / 2000.0).alias("late"),
    )


@_query("""
WITH p AS (SELECT p_partkey, p_size * 30.0::DOUBLE AS w, p_size * 20.0::DOUBLE AS h, CASE WHEN p_partkey % 2 = 0 THEN 720 ELSE 1920 END AS cw, CASE WHEN p_partkey % 2 = 0 THEN 576 ELSE 1080 END AS ch FROM part),
s AS (SELECT *, CASE WHEN cw > 720 THEN greatest(w / cw, h / ch) ELSE w / cw END AS sx, CASE WHEN cw > 720 THEN greatest(w / cw, h / ch) ELSE h / ch END AS sy FROM p),
t AS (SELECT *, greatest(1, round(w * 0.9))::BIGINT AS tw, greatest(1, round(h * 0.3))::BIGINT AS th FROM s)
SELECT p_partkey, round(10 + CASE WHEN cw > 720 THEN (w - cw * sx) / 2 ELSE 0 END + 100 * sx, 6) AS x, round(20 + CASE WHEN cw > 720 THEN (h - ch * sy) / 2 ELSE 0 END + 400 * sy, 6) AS y, round(greatest(1, 300 * sx), 6) AS w, round(greatest(1, 40 * sy), 6) AS h,
  round(10 + (w - tw) / 2, 6) AS tx, round(greatest(20, 20 + h - greatest(10, h * 0.045) - th), 6) AS ty, tw, th, round(greatest(22, least(58, h / 18)), 6) AS font
FROM t""")
def subtitle_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where bitmap and text subtitles go."""
    small = F.col("p_partkey") % 2 == 0
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 30.0).alias("vw"), (F.col("p_size") * 20.0).alias("vh"), F.when(small, 720).otherwise(1920).alias("cw"), F.when(small, 576).otherwise(1080).alias("ch"))
    bitmap = tracks.bitmap_place((F.lit(10.0), F.lit(20.0), F.col("vw"), F.col("vh")), (F.col("cw"), F.col("ch")), (F.lit(100), F.lit(400), F.lit(300), F.lit(40)))
    words = tracks.text_place(F.lit(10.0), F.lit(20.0), F.col("vw"), F.col("vh"), False)
    own = p.select("p_partkey", *bitmap, *[c.alias(n) for c, n in zip(words, ("tx", "ty", "tw", "th", "font"), strict=True)])
    return own.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h", "tx", "ty")], "tw", "th", F.round("font", 6).alias("font"))


@_query("SELECT p_partkey, ((p_size + 1) * 16 - 2 * (p_partkey % 8))::BIGINT AS width, (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END * ((p_size + 3) * 16 - 2 * (p_partkey % 5)))::BIGINT AS height, chr((65 + p_size % 26)::INTEGER) || 'BC1' AS code FROM part")
def cropped_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of cropped pictures, four-letter codes."""
    key, size, none = F.col("p_partkey"), F.col("p_size"), F.lit(0)
    wide, high = tracks.cropped_size(size, size + 2, key % 2 == 0, (key % 8, none, key % 5, none))
    code = (97 + size % 26) + F.lit(ord("b") << 8) + F.lit(ord("C") << 16) + F.lit(ord("1") << 24)
    return _table(spark, sf_dir, "part").select("p_partkey", wide.cast("long").alias("width"), high.cast("long").alias("height"), text.fourcc(code).alias("code"))
