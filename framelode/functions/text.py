"""Subtitle text: entities, tags, times, wrapping, languages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entities in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]

# Tags that stand for a line end, exactly as written.
LINE_TAGS = {"br", "br/", "p", "/p"}


def decode_entities(column: Column) -> Column:
    """One entity after the other in any letter case, so what a decoded one forms with its neighbours is decoded later in the list."""
    for name, sign in ENTITIES:
        column = F.regexp_replace(column, f"(?i){name}", sign)
    return column


def strip_tags(text: str) -> str:
    """Without tags, entities decoded after them; a line tag ends a line, `<` in a tag starts it anew, an open tag takes the rest. Lines are trimmed, blank ones go."""
    out, at = [], 0
    while (start := text.find("<", at)) >= 0:
        out.append(text[at:start])
        end = text.find(">", start)
        if end < 0:
            at = len(text)
            break
        name = text[text.rfind("<", start, end) + 1 : end]
        out.append("\n" if name.strip().lower() in LINE_TAGS else "")
        at = end + 1
    plain = "".join(out) + text[at:]
    for name, sign in ENTITIES:
        plain = re.sub(name, lambda _, s=sign: s, plain, flags=re.I)
    return "\n".join(x for x in (line.strip() for line in plain.split("\n")) if x)


def trim(column: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def strip_html(column: Column) -> Column:
    """`strip_tags` in the JVM. What follows the last > is cut at its first <, so that every other < has a > after it."""
    tail = F.substring_index(column, ">", -1)
    closed = F.concat(F.substring(column, F.lit(1), F.length(column) - F.length(tail)), F.substring_index(tail, "<", 1))
    lines = F.regexp_replace(closed, r"(?iU)<(?:[^<>]*+<)*+\s*(?:br/?|/?p)\s*>", "\n")
    plain = decode_entities(F.regexp_replace(lines, "<[^>]*+>", ""))
    return F.array_join(F.filter(F.transform(F.split(plain, "\n"), trim), lambda x: x != ""), "\n")


def strip_overrides(column: Column) -> Column:
    """ASS text without `{...}`; `\\N` and `\\n` end lines, `\\h` is a space."""
    plain = F.regexp_replace(F.regexp_replace(column, r"\{[^}]*(\}|$)", ""), r"\\[Nn]", "\n")
    return F.regexp_replace(plain, r"\\h", " ")


def event_text(column: Column) -> Column:
    """What follows the eighth comma of an embedded ASS event, else all."""
    return F.coalesce(F.nullif(F.regexp_extract(column, r"(?s)^(?:[^,]*,){8}(.*)$", 1), F.lit("")), column)


def base_language(lang: Column) -> Column:
    plain = F.replace(F.lower(lang), F.lit("_"), F.lit("-"))
    return F.when(plain.startswith("zh"), "zh").otherwise(F.split_part(plain, F.lit("-"), F.lit(1)))


def line_width(lang: Column) -> Column:
    base = base_language(lang)
    return F.when(base.isin("zh", "ja", "ko"), 22).when(base.isin("hi", "ar"), 36).otherwise(42)


def utf16_units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def wrap(text: str, width: int) -> str:
    """At most two lines: split at the space nearest the middle, the first of equals, else at the width or the middle; in UTF-16 units.

    Line ends and tabs count as spaces; spaces around the split go.
    """
    text = text.replace("\r", " ").replace("\n", " ").replace("\t", " ")
    raw = text.encode("utf-16-le", "surrogatepass")
    units = len(raw) // 2
    if units <= width:
        return text
    middle = units // 2
    spaces = [i for i in range(units) if raw[2 * i : 2 * i + 2] == b" \0"]
    split = min(spaces, key=lambda i: abs(i - middle)) if spaces else min(width, (units + 1) // 2)
    first, second = (x.decode("utf-16-le", "replace") for x in (raw[: 2 * split], raw[2 * split :]))
    second = second.lstrip(" ")
    return first.rstrip(" ") + ("\n" + second if second else "")


@F.pandas_udf(T.StringType())
def wrap_two_lines(text: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else wrap(t, w) for t, w in zip(text, width, strict=True)])


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds, rounded half away from zero, 0 at least."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda div, mod: F.floor(ms / div) % mod if mod else F.floor(ms / div)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def media_time(seconds: Column) -> Column:
    """H:MM:SS, or MM:SS under an hour."""
    s = F.floor(seconds + 0.5)
    short = F.format_string("%02d:%02d", F.floor(s / 60) % 60, s % 60)
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), short)).otherwise(short)


_TIME = r"(?s)^([0-9]+):([0-9]+):([0-9]+)(?:[,.]([0-9]{0,3}).*)?$"


def parse_srt_time(text: Column) -> Column:
    """Seconds of H:MM:SS, with up to three digits after a comma or dot and anything behind them; null if there are no hours or a part is out of range."""
    own = trim(text)
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(own, _TIME, i), F.lit("")), F.lit("999999999")).cast("double")
    ms = F.rpad(F.regexp_extract(own, _TIME, 4), 3, "0").cast("double")
    whole = part(1) * 3600 + part(2) * 60 + part(3) + ms / 1000
    return F.when((part(2) < 60) & (part(3) < 60), whole)


def trim_ascii(column: Column) -> Column:
    return F.regexp_replace(column, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def format_template(column: Column, values: dict[str, Column]) -> Column:
    """`{name}` by its value, one after the other: later names also meet in earlier values."""
    for name, value in values.items():
        column = F.replace(column, F.lit("{" + name + "}"), value)
    return column


def right_to_left(column: Column) -> Column:
    return column.rlike("[֐-ࣿיִ-﷿ﹰ-﻿]")


# Prefixes of system locales that have a catalog.
LOCALES = ["ja", "ko", "fr", "es", "pt", "hi", "id", "ar"]
# Base languages that texts are translated to.
TARGETS = ["en", "ja", "ko", "fr", "zh", "es", "pt", "hi", "id", "ar"]


def system_language(locale: Column) -> Column:
    """The catalog of a system locale; English where there is none."""
    low = F.lower(locale)
    own = F.when(low.startswith("zh"), F.when(locale.rlike("TW|HK|MO|Hant"), "zh-TW").otherwise("zh-CN"))
    for name in LOCALES:
        own = own.when(low.startswith(name), name)
    return F.coalesce(own.otherwise("en"), F.lit("en"))


def target_language(lang: Column) -> Column:
    """A language to translate to; null where it is none of the supported ones."""
    base = base_language(lang)
    return F.when(base == "zh", F.when(F.lower(lang).isin("zh-tw", "zh_tw"), "zh-TW").otherwise("zh-CN")).when(base.isin(TARGETS), base)


def source_subtitle_path(path: Column, lang: Column) -> Column:
    """folder/stem.language.whisper.srt of a media path."""
    base = base_language(lang)
    stem = F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", "")
    return F.concat(stem, F.lit("."), F.when(base == "zh", "zh-CN").otherwise(base), F.lit(".whisper.srt"))


def subtitle_font(text: Column, configured: Column) -> Column:
    """The font family of a text: by its script, but the configured one before the default ones."""
    cjk = text.rlike("[\\u3040-\\u30FF\\u3400-\\u9FFF\\uAC00-\\uD7AF]")
    return F.when(text.rlike("[\\u0900-\\u097F]"), "Nirmala UI").when(F.coalesce(configured, F.lit("")) != "", configured).when(cjk, "Malgun Gothic").otherwise("Segoe UI")


def embedded_plain(text: Column) -> Column:
    """Text of an embedded event: overrides out, line ends in, the right end trimmed; tags stay."""
    return F.regexp_replace(strip_overrides(text), r"(?U)\s+$", "")


def unsigned(text: Column) -> Column:
    """A number of ASCII digits alone; null for anything else."""
    return F.when(text.rlike("^[0-9]{1,18}$"), F.try_to_number(text, F.lit("9" * 18)).cast("long"))


def status_flag(value: Column) -> Column:
    return F.lower(trim_ascii(value)).isin("1", "true", "yes", "on")


def status_progress(value: Column) -> Column:
    """A number with or without a percent sign, from 0 to 100; null if it is none."""
    number = F.regexp_extract(trim_ascii(value), r"(?i)^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)[ \t]*%?[ \t]*$", 1)
    value = F.nullif(number, F.lit("")).try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def fourcc(value: Column) -> Column:
    """The four letters of a little-endian code, upper-cased."""
    byte = lambda k: F.char(F.shiftright(value, 8 * k).bitwiseAND(255))
    return F.upper(F.concat(*[byte(k) for k in range(4)]))
