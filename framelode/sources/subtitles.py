"""Subtitle files and message catalogs as tables; SubRip text from cues.

`cues` takes (path, content). Text is read by its byte-order mark, as UTF-8, else as CP949. Times need hours; a line with `-->` whose
times cannot be read is passed over.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions.text import srt_time, strip_tags

MOST_BYTES = 64 << 20
LAST_SECONDS = 5.0
CUES = "path string, seq long, start double, end double, text string"
_TIME = re.compile(r"([0-9]+):([0-9]+):([0-9]+)(?:[,.]([0-9]{0,3}).*)?\Z", re.A | re.S)


def decode(content: bytes) -> str:
    if content[:2] == b"\xff\xfe":
        text = content[2:].decode("utf-16-le", "replace")
    elif content[:2] == b"\xfe\xff":
        text = content[2:].decode("utf-16-be", "replace")
    else:
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = content.decode("cp949", "replace")
    return text.replace("\r", "")


def seconds(value: str) -> float | None:
    m = _TIME.match(value.strip())
    if not m or int(m[2]) > 59 or int(m[3]) > 59:
        return None
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3]) + int((m[4] or "").ljust(3, "0")) / 1000


def srt(text: str) -> list[tuple[float, float, str]]:
    """SubRip and WebVTT: a time line, then lines up to a blank one."""
    out, lines, at = [], text.split("\n"), 0
    while at < len(lines):
        before, arrow, after = lines[at].partition("-->")
        at += 1
        if not arrow:
            continue
        # settings follow the first space or tab that is not the very first sign
        start, end = seconds(before), seconds(after[:1] + re.split("[ \t]", after[1:], maxsplit=1)[0])
        if start is None or end is None:
            continue
        body = []
        while at < len(lines) and lines[at].strip():
            body.append(lines[at])
            at += 1
        out.append((start, end, strip_tags("\n".join(body))))
    return out


def ass(text: str) -> list[tuple[float, float, str]]:
    """Dialogue lines: nine commas, then the text with its overrides taken out."""
    out = []
    for line in text.split("\n"):
        if not line.strip().lower().startswith("dialogue:"):
            continue
        parts = line.strip()[9:].split(",", 9)
        if len(parts) < 10:
            continue
        start, end = seconds(parts[1]), seconds(parts[2])
        if start is not None and end is not None:
            body = re.sub(r"\\h", " ", re.sub(r"\\[Nn]", "\n", re.sub(r"\{[^}]*(\}|\Z)", "", parts[9])))
            out.append((start, end, strip_tags(body)))
    return out


def smi(text: str) -> list[tuple[float, float, str]]:
    """Sync marks in milliseconds; a cue ends where the next mark is, blank ones too, the last after LAST_SECONDS."""
    marks = [(m.start(), m.end(), int(m[1]) / 1000) for m in re.finditer(r"<sync\b[^>]*?start\s*=\s*[\"']?([0-9]+)[^>]*>", text, re.I)]
    out = []
    for i, (_, begin, start) in enumerate(marks):
        stop, end = (marks[i + 1][0], marks[i + 1][2]) if i + 1 < len(marks) else (len(text), start + LAST_SECONDS)
        out.append((start, end, strip_tags(text[begin:stop])))
    return out


def parse(path: str, content: bytes) -> list[tuple[float, float, str]]:
    """Valid cues by start and end: with text, and ending after they start."""
    if len(content) > MOST_BYTES:
        return []
    text, kind = decode(content), path.lower().rpartition(".")[2]
    readers = {"srt": [srt], "vtt": [srt], "ass": [ass], "ssa": [ass], "smi": [smi], "sami": [smi]}.get(kind, [srt, ass, smi])
    for read in readers:
        found = sorted((c for c in read(text) if c[2] and c[1] > c[0]), key=lambda c: c[:2])
        if found:
            return found
    return []


def problems(files: DataFrame) -> DataFrame:
    """(path, error) of the files that `cues` gives nothing for because of their size."""
    return files.filter(F.length("content") > MOST_BYTES).select("path", F.lit(f"larger than {MOST_BYTES} bytes").alias("error"))


def cues(files: DataFrame) -> DataFrame:
    """(path, seq, start, end, text) of every file of (path, content)."""

    def read(batches):
        for batch in batches:
            rows = [(p, i, *c) for p, content in zip(batch.path, batch.content, strict=True) for i, c in enumerate(parse(p, bytes(content)))]
            yield pd.DataFrame(rows, columns=["path", "seq", "start", "end", "text"]).astype({"seq": "int64", "start": "float64", "end": "float64"})

    return files.select("path", "content").mapInPandas(read, CUES)


def srt_text(cue: DataFrame) -> DataFrame:
    """(path, content): each file's cues as SubRip text, numbered from 1, lines ended by CR LF."""
    body = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    one = F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\r\n"), body, F.lit("\r\n\r\n"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", one.alias("one"))))
    numbered = F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\r\n"), x["one"]))
    return cue.groupBy("path").agg(F.array_join(numbered, "").alias("content"))


def unescape(value: str) -> str:
    r"""`\n`, `\r`, `\t` and `\\`; what else follows a backslash is kept with it."""
    return re.sub(r"\\([nrt\\])", lambda m: {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}[m[1]], value)


def catalog(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(path, key, text) of key=value lines (path, line_no, value); of repeated keys the last counts. strict: (path, key) of repeats instead."""
    own = lines.filter(~F.ltrim("value").rlike("^[#;]") & F.contains("value", F.lit("="))).select("path", "line_no", F.trim(F.regexp_extract("value", "^([^=]*)=", 1)).alias("key"), F.regexp_extract("value", "(?s)^[^=]*=(.*)$", 1).alias("text"))
    if strict:
        return own.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1").select("path", "key")
    return own.groupBy("path", "key").agg(F.max_by("text", "line_no").alias("text"))


def placeholders(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\{[A-Za-z0-9_]+\})"), F.lit(1))))
