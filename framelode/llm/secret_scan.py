"""Secret scans: all rules compiled into one minimised automaton that reads each byte once.

Rules of the base kinds are kept as the contract words them; further kinds add spans. The automaton marks where matches first end;
the rule's own automata give the start and the longest end; a rule's check drops what fails, without retries.

Null text counts as empty, and an empty text has no spans; very long texts are read whole, in memory linear in the text. Repeated
rows each get their answer; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .automaton import Rule, Scanner

_KEYWORD = r"(password|passwd|secret|token|api_?key)"
BASE = [
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", fold=True),
    Rule("access", r"AKIA[A-Z0-9]+"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+"),
    Rule("google", r"AIza[0-9A-Za-z_\-]+"),
    Rule("stripe", r"[rs]k_live_[0-9a-zA-Z]+"),
    Rule("private", r"-----BEGIN[A-Z\x20]*PRIVATE\x20KEY-----"),
]
_VALUE = re.compile(rf"""{_KEYWORD}["']? *[:=] *["']?(.+)\Z""", re.I | re.S)


def _long_value(text: str) -> bool:
    return len(_VALUE.match(text)[2]) >= 6


#: What a match of a kind must also satisfy.
CHECKS: dict[str, Callable[[str], bool]] = {
    "assign": _long_value,
    "access": lambda x: len(x) >= 20,
    "github": lambda x: len(x) >= 40,
    "slack": lambda x: len(x) >= 15,
    "google": lambda x: len(x) >= 39,
    "stripe": lambda x: len(x) >= 32,
}

_BATCH = 8 << 20


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, checks: dict[str, Callable[[str], bool]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, found: array of (start, end, rank, kind), code points, by start and then rank of the rule."""
    rules = BASE + MORE if rules is None else rules
    checks = CHECKS if checks is None else checks
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    kind = "struct<start:long,end:long,rank:int,kind:string>"

    def scan(batches):
        own = scanner.value
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            rows = []
            for a, b in C.runs_of(offsets, _BATCH):
                for i, found in enumerate(own.spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])):
                    rows.append(_row(data[offsets[a + i] : offsets[a + i + 1]], found, rules, checks) if found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rank", pa.int32()), ("kind", pa.string())])))], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id long, found array<{kind}>")


def _row(data: np.ndarray, found: list[tuple[int, int, int]], rules: list[Rule], checks: dict) -> list[dict]:
    points, raw = C.code_points(data), data.tobytes()
    out = []
    for rule, start, end in found:
        kind = rules[rule].kind
        if kind not in checks or checks[kind](raw[start:end].decode()):
            out.append((int(points[start]), rule, int(points[end]), kind))
    return [{"start": s, "end": e, "rank": r, "kind": k} for s, r, e, k in sorted(out)]


def listed(found, kinds: list[str] | None = None):
    """Spans as kind:start:end, comma-joined; kinds: only these."""
    own = found if kinds is None else F.filter(found, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(kind: str):
    """How many spans of `found` are of this kind."""
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `find_secrets`."""
    base = [r.kind for r in BASE]
    return found.select("doc_id", *map(count_of, base), F.sha2(listed(F.col("found"), base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(text: str, found: list, mark: str = "[{kind}]") -> str:
    """The text with its spans replaced; overlapping ones become one."""
    out, at = [], 0
    for x in found:
        if x["end"] > at:
            out += [text[at : x["start"]], mark.format(kind=x["kind"])] if x["start"] >= at else []
            at = x["end"]
    return "".join(out) + text[at:]

