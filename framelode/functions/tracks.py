"""Tracks as rows: codecs, units, defaults, labels, the player's clock, and where pictures of subtitles go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codecs that can be played, and the names that stand for them.
AUDIO_LABELS = {"aac": "AAC-LC", "mp3": "MP3", "opus": "Opus", "flac": "FLAC", "ac3": "AC-3", "eac3": "E-AC-3", "dts": "DTS"}
VIDEO_LABELS = {"h264": "H.264", "mpeg4": "MPEG-4 Part 2", "mpeg2": "MPEG-2", "wmv3": "WMV3"}
EXTENSIONS = ["mp4", "mkv", "avi", "ts", "m2ts", "mts"]
SPEEDS = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]
SLOWEST, FASTEST = 0.25, 4.0
#: Frames a second and ticks of a second where a track names none.
DEFAULT_RATE, TICKS = (24_000, 1001), 90_000


def _lookup(codec: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for key, name in names.items():
        out = F.when(codec == key, name).otherwise(out)
    return out


def supported_audio(codec: Column) -> Column:
    return F.coalesce(codec.isin(*AUDIO_LABELS), F.lit(False))


def audio_label(codec: Column) -> Column:
    return _lookup(codec, AUDIO_LABELS, "Unknown")


def video_label(codec: Column, main10: Column) -> Column:
    return F.when(codec == "hevc", F.when(main10, "HEVC Main 10").otherwise("HEVC Main")).otherwise(_lookup(codec, VIDEO_LABELS, "Microsoft MPEG-4 v3"))


def supported_path(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1)).isin(EXTENSIONS)


def selected(tracks: DataFrame, kind: str, chosen: int) -> DataFrame:
    """Of one kind of track the chosen one alone (0: none), of the others all. tracks: kind, track_id."""
    return tracks.filter((F.col("kind") != kind) | (F.col("track_id") == chosen))


def in_seconds(ticks: Column, scale: Column) -> Column:
    """0 without a time scale."""
    return F.when(scale != 0, ticks / scale).otherwise(0.0)


def microseconds(timecode: Column, scale_ns: Column) -> Column:
    """Rounded half away from zero."""
    exact = timecode.cast("decimal(38,0)") * scale_ns.cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)")
    return F.round(exact, 0).cast("long")


def ratio(numerator: Column, denominator: Column, other: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(other))


def frame_ticks(numerator: Column, denominator: Column) -> Column:
    """Ticks of a frame, 1 at least; the default rate where there is none."""
    real = (numerator > 0) & (denominator > 0)
    up, down = F.when(real, numerator).otherwise(DEFAULT_RATE[0]), F.when(real, denominator).otherwise(DEFAULT_RATE[1])
    return F.greatest(F.lit(1).cast("long"), F.round(F.lit(float(TICKS)) * down / up).cast("long"))


def greatest_divisor(a: Column, b: Column) -> Column:
    """By Euclid; 64-bit values need under 93 steps."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def seek_target(target: Column, duration: Column) -> Column:
    """Within the media; what is no number is its start."""
    real = F.when(F.isnan(target) | (F.abs(target) == float("inf")), 0.0).otherwise(F.coalesce(target, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(duration, real))


def trimmed_frames(pts: Column, frames: Column, rate: Column, target: Column) -> Column:
    """Frames to cut from the start of decoded audio so that it begins at the target: all of them where it ends before."""
    cut = F.ceil(F.greatest(F.lit(0.0), (target - pts) * rate - 1e-9)).cast("long")
    return F.when(pts + frames / rate <= target, frames).when(pts < target, F.least(frames, cut)).otherwise(F.lit(0)).cast("long")


def player_clock(opened: Column, paused: Column, position: Column, audio: Column, base: Column, elapsed: Column, speed: Column, duration: Column) -> Column:
    """Seconds into the media: where it is paused, else the audio's clock (null: none), else the time since a start at some speed."""
    now = F.when(paused, position).otherwise(F.coalesce(audio, base + elapsed * speed))
    return F.when(opened, seek_target(now, duration)).otherwise(0.0)


def next_speed(speed: Column) -> Column:
    """The next of the speeds, the first after the last."""
    return F.coalesce(F.get(F.filter(F.lit(SPEEDS), lambda x: x > speed + 0.01), F.lit(0)), F.lit(SPEEDS[0]))


def bounded_speed(speed: Column) -> Column:
    return F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), speed))


def nal_flags(nal: Column) -> list[Column]:
    """Kinds of an HEVC unit by its type."""
    return [nal.between(16, 23).alias("irap"), nal.isin(19, 20).alias("idr"), nal.between(16, 18).alias("bla"), nal.isin(8, 9).alias("rasl"), (nal.between(16, 23) | (nal.between(0, 9) & (nal % 2 != 0))).alias("reference")]


def kept_after_reset(units: Column) -> Column:
    """Whether each unit (its type, in order after a reset) stays: leading pictures that follow a first random access other than IDR go.

    Types 8 and 9 are dropped from that point on, up to the first unit of another type.
    """

    def step(acc: Column, nal: Column) -> Column:
        state, irap, idr, rasl = acc["state"], nal.between(16, 23), nal.isin(19, 20), nal.isin(8, 9)
        # 0: nothing seen, 1: dropping, 2: done
        new = F.when(state == 0, F.when(irap, F.when(idr, 2).otherwise(1)).otherwise(0)).when((state == 1) & ~rasl, 2).otherwise(state)
        return F.struct(new.alias("state"), F.concat(acc["out"], F.array(~((new == 1) & rasl))).alias("out"))

    start = F.struct(F.lit(0).alias("state"), F.expr("cast(array() as array<boolean>)").alias("out"))
    return F.aggregate(units, start, step, lambda acc: acc["out"])


def unwrapped_order(lsb: Column, bits: int) -> Column:
    """Picture order counts of their low bits in decoding order: the high part steps where the low one jumps by half its range."""
    full = 1 << bits

    def step(acc: Column, low: Column) -> Column:
        last, high = acc["low"], acc["high"]
        new = F.when((low < last) & (last - low >= full // 2), high + full).when((low > last) & (low - last > full // 2), high - full).otherwise(high)
        return F.struct(low.cast("long").alias("low"), new.alias("high"), F.concat(acc["out"], F.array(new + low)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(lsb, start, step, lambda acc: acc["out"])


def cropped_size(mbs_wide: Column, map_units: Column, frame_only: Column, crop: tuple[Column, Column, Column, Column]) -> list[Column]:
    """Width and height of an H.264 picture with 4:2:0 chroma. crop: left, right, top, bottom, in its units."""
    left, right, top, bottom = crop
    fields = F.when(frame_only, 1).otherwise(2)
    return [((mbs_wide + 1) * 16 - (left + right) * 2).alias("width"), (fields * (map_units + 1) * 16 - (top + bottom) * 2 * fields).alias("height")]


def color_defaults(height: Column, values: dict[str, Column]) -> list[Column]:
    """matrix, range, chroma, primaries and transfer; null counts as not told."""
    default = {"matrix": F.when(height > 576, "bt709").otherwise("bt601"), "range": F.lit("limited"), "chroma": F.lit("left"), "primaries": F.lit("bt709"), "transfer": F.lit("bt709")}
    return [F.coalesce(values[k], v).alias(k) for k, v in default.items()]


def input_color_space(rgb: Column, full: Column, transfer: Column, matrix: Column, primaries: Column, top_left: Column) -> Column:
    """The name of the space in which a decoded picture enters the video processor; null where there is none."""
    wide = (matrix == "bt2020") | (primaries == "bt2020") | transfer.isin("pq", "hlg")
    side, reach = F.when(top_left, "topleft").otherwise("left"), F.when(full, "full").otherwise("studio")
    pq = F.when(rgb, "rgb_full_g2084_none_p2020").when(~full, F.concat(F.lit("ycbcr_studio_g2084_"), side, F.lit("_p2020")))
    hlg = F.when(~rgb, F.concat(F.lit("ycbcr_"), reach, F.lit("_ghlg_topleft_p2020")))
    yuv2020 = F.when(full, "ycbcr_full_g22_left_p2020").otherwise(F.concat(F.lit("ycbcr_studio_g22_"), side, F.lit("_p2020")))
    plain = F.when(matrix.isin("bt709", "unspecified") | (primaries == "bt709"), F.concat(F.lit("ycbcr_"), reach, F.lit("_g22_left_p709")))
    old = F.when(full, "ycbcr_full_g22_none_p709_x601").otherwise("ycbcr_studio_g22_left_p601")
    return F.when(transfer == "pq", pq).when(transfer == "hlg", hlg).when(rgb, F.when(wide, "rgb_full_g22_none_p2020").otherwise("rgb_full_g22_none_p709")).when(wide, yuv2020).otherwise(F.coalesce(plain, old))


def _named(number: Column, name: Column, codec: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(". "), F.when(F.coalesce(name, F.lit("")) == "", codec).otherwise(F.concat(name, F.lit(" — "), codec)))


def _told(language: Column) -> Column:
    return F.when(F.coalesce(language, F.lit("")).isin("", "und"), "").otherwise(F.concat(F.lit(" ["), language, F.lit("]")))


def audio_track_label(index: Column, name: Column, codec: Column, language: Column, rate: Column, channels: Column, default: Column, default_text: str) -> Column:
    part = lambda v, unit: F.when(v > 0, F.concat(F.lit(", "), v.cast("string"), F.lit(f" {unit}"))).otherwise("")
    return F.concat(_named(index + 1, name, audio_label(codec)), F.when(supported_audio(codec), "").otherwise(" [Not Support]"), _told(language), part(rate, "Hz"), part(channels, "ch"), F.when(default, f" [{default_text}]").otherwise(""))


def subtitle_track_label(index: Column, name: Column, codec: Column, language: Column, default: Column, forced: Column, default_text: str) -> Column:
    kind = F.when(codec == "ass", "ASS").when(codec == "vobsub", "VobSub").otherwise("SRT/UTF-8")
    told = F.contains(F.coalesce(name, F.lit("")), F.lit("Forced"))
    return F.concat(_named(index + 1, name, kind), _told(language), F.when(default, f" [{default_text}]").otherwise(""), F.when(forced & ~told, " [Forced]").otherwise(""))


def description(video: Column, width: Column, height: Column, rate: Column, audio: Column, sample_rate: Column, channels: Column) -> Column:
    """One line about a file. video, audio: labels; rate null: not told; audio null: none."""
    frames = F.when(rate.isNotNull(), F.concat(F.lit("  "), F.format_string("%.3f", rate), F.lit(" fps"))).otherwise("")
    sound = F.when(audio.isNotNull(), F.concat(F.lit("  ·  "), audio, F.lit(" "), sample_rate.cast("string"), F.lit(" Hz "), channels.cast("string"), F.lit(" ch"))).otherwise("")
    return F.concat(video, F.lit("  "), width.cast("string"), F.lit("×"), height.cast("string"), frames, sound)


def bitmap_place(video: tuple[Column, Column, Column, Column], canvas: tuple[Column, Column], picture: tuple[Column, Column, Column, Column]) -> list[Column]:
    """x, y, w, h of a subtitle's picture on the screen; canvases larger than 720 x 576 keep their shape and are cropped around the centre."""
    (left, top, width, height), (cw, ch), (x, y, w, h) = video, canvas, picture
    across, down = width / cw, height / ch
    large, most = (cw > 720) | (ch > 576), F.greatest(width / cw, height / ch)
    sx, sy = F.when(large, most).otherwise(across), F.when(large, most).otherwise(down)
    ox, oy = F.when(large, left + (width - cw * most) / 2).otherwise(left), F.when(large, top + (height - ch * most) / 2).otherwise(top)
    return [(ox + x * sx).alias("x"), (oy + y * sy).alias("y"), F.greatest(F.lit(1.0), w * sx).alias("w"), F.greatest(F.lit(1.0), h * sy).alias("h")]


def text_place(left: Column, top: Column, width: Column, height: Column, fullscreen: bool) -> list[Column]:
    """Box and font size of a text subtitle over a picture."""
    low, high, part = (26.0, 86.0, 15.5) if fullscreen else (22.0, 58.0, 18.0)
    w, h = (F.greatest(F.lit(1), F.round(v * s).cast("long")) for v, s in ((width, 0.9), (height, 0.3)))
    margin = F.greatest(F.lit(10.0), height * 0.045)
    return [(left + (width - w) / 2).alias("x"), F.greatest(top.cast("double"), top + height - margin - h).alias("y"), w.alias("w"), h.alias("h"), F.greatest(F.lit(low), F.least(F.lit(high), height / part)).alias("font")]


def ceil_log2(value: Column) -> Column:
    """Bits that tell so many values apart."""
    return F.when(value <= 1, 0).otherwise(F.length(F.bin(value - 1))).cast("long")


def interpolates(interlaced: Column, duration: Column) -> Column:
    """Whether frames are doubled: progressive ones of 23 to 31 a second."""
    return F.coalesce(~interlaced & F.try_divide(F.lit(1.0), duration).between(23.0, 31.0), F.lit(False))


def lateness(clock: Column, pts: Column, most: float = 0.075, early: float = 0.0005) -> Column:
    """What becomes of a waiting picture: `reset` where the clock jumped back, `drop` where it is too late, `wait` or `show` between."""
    return F.when(clock + most < pts, "reset").when(clock + early < pts, "wait").when(clock - pts > most, "drop").otherwise("show")
