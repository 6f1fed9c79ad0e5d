"""Personal data: patterns for entities, and terms that reveal them by the corpus' own co-occurrence.

Base kinds (email, ip, card, phone) are matched as the contract words them, leftmost and without overlap, in time linear in the
text. Each matched value is a protected entity. For every term t of a document that holds an entity e, however far from it,

    disclosure(t, e) = log(N c / (n_t n_e)) / log(N / n_e),

where N counts the documents, n_t and n_e those that hold t and e, and c those that hold both, t outside of entities: pointwise mutual
information over the information of e, 1 when t never stands without e. All four counts cover all documents. The threshold alone
decides, however rare e and t are: a term is marked wherever it stands in a document that holds e, `generalise` from GENERALISE_AT on,
`remove` from REMOVE_AT.

Since c is n_e at most, no term in more than N^(1-g) n_e^g documents reaches a disclosure of g: such terms are left out before pairs
are made, which changes no result.

`sanitise` puts an entity's kind in its place, takes out what is to be removed, and generalises a term to what it looks like: "[name]"
where it begins with a capital letter, else "[term]".

Null text: empty, no spans, and it stays null. Repeated rows: each gets its spans and counts as a document. Null doc_id: as any other row. An entity in
all documents carries no information and reveals nothing. Empty table: no rows. `find_personal_data` reads
doc_id and text alone; `sanitise_documents` keeps all columns, whatever their names. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .secret_scan import count_of, listed

KINDS = ["email", "ip", "card", "phone"]
GENERALISE_AT, REMOVE_AT = 0.8, 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[128:] = True
_BATCH = 4 << 20


def emails(text: str) -> Iterator[tuple[int, int]]:
    past = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            past = m.end()
            yield start, past
        at = text.find("@", max(at + 1, past))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base kinds, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(kind: int, value: str) -> int:
    """A protected entity: its kind and its value without what writing it differently changes."""
    plain = value.lower() if kind == 0 else value if kind == 1 else "".join(_DIGIT.findall(value))
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rank", pa.int32()), ("kind", pa.string())])
_WORD = pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _free_words(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """The terms of one text outside of its entities."""
    data = np.frombuffer(text.encode(), np.uint8)
    points = C.code_points(data)
    start, end, term, _ = C.words(data, np.array([0, len(data)]), _LETTERS)
    start, end = points[start], points[end]
    free = np.ones(len(start), bool)
    for a, _, b in spans:
        free[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = False
    return [{"term": t, "start": a, "end": b} for t, a, b in zip(term[free].view(np.int64).tolist(), start[free].tolist(), end[free].tolist(), strict=True)]


def _entities(docs: DataFrame) -> DataFrame:
    def find(batches):
        for whole in batches:
            for batch in C.sliced([whole], 1):
                found, entities, words, own, plain = [], [], [], [], []
                for text in batch.column(1):
                    text = text.as_py() or ""
                    spans = base_spans(text)
                    own.append(text if spans else None)
                    plain.append(None if spans else hashlib.sha256(text.encode()).hexdigest())
                    found.append([{"start": a, "end": b, "rank": k, "kind": KINDS[k]} for a, k, b in spans])
                    entities.append(sorted({_entity(k, text[a:b]) for a, k, b in spans}))
                    words.append(_free_words(text, spans) if spans else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN)), pa.array(entities, pa.list_(pa.int64())), pa.array(words, pa.list_(_WORD)), pa.array(own, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "found", "entities", "words", "own", "plain"])

    return docs.mapInArrow(find, "doc_id long, found array<struct<start:long,end:long,rank:int,kind:string>>, entities array<long>, words array<struct<term:long,start:long,end:long>>, own string, plain string")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, docs): of every term the documents that hold it; counted in part before the shuffle."""

    def count(batches):
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            own = []
            for a, b in C.runs_of(offsets, _BATCH):
                _, _, term, first = C.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _LETTERS)
                for x, y in zip(first[:-1], first[1:], strict=True):
                    term[x:y].sort()
                new = np.ones(len(term), bool)
                new[1:] = term[1:] != term[:-1]
                new[first[:-1][np.diff(first) > 0]] = True
                own.append(term[new])
            value, n = np.unique(np.concatenate([np.empty(0, np.uint64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "docs"])

    return docs.mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def find_personal_data(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """One row per row of docs: doc_id, found: array of (start, end, rank, kind) of base kinds and of revealing terms, sorted.

    own is the text where it holds an entity, else null, and plain then its SHA-256: texts without entities are not carried along.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = C.cut(_entities(texts).withColumn("row", F.monotonically_increasing_id()), "entities")
    total = rows.count()
    holds = rows.select("row", F.explode("entities").alias("entity"))
    # the documents that a term may be in and still reveal the entity, a little more for rounding
    most = F.lit(float(max(1, total))) ** (1 - generalise_at) * F.col("n_e") ** generalise_at * (1 + 1e-9)
    entities = holds.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") < total).withColumn("most", most)
    held = C.cut(holds.join(entities, "entity"), "held")
    widest = held.agg(F.max("most")).first()[0] or 0.0
    frequency = C.cut(document_frequencies(texts), "frequencies")
    # terms in a hundredth of the documents are few; the most common ones meet no shuffle
    common = frequency.filter(F.col("docs") > max(widest, total / 100)).select("term")
    bound = held.groupBy("row").agg(F.max("most").alias("row_most"))
    own = rows.filter(F.size("words") > 0).select("row", F.explode(F.array_distinct(F.transform("words", lambda x: x["term"]))).alias("term"))
    rare = own.join(F.broadcast(common), "term", "left_anti").join(frequency, "term").join(bound, "row").filter(F.col("docs") <= F.col("row_most")).select("row", "term", "docs")
    pairs = rare.join(held, "row").filter(F.col("docs") <= F.col("most")).select("row", "entity", "term", "docs", "n_e")
    counted = pairs.groupBy("entity", "term").agg(F.count("*").alias("c"), F.first("docs").alias("docs"), F.first("n_e").alias("n_e"))
    share = F.log(F.lit(float(total)) * F.col("c") / (F.col("docs") * F.col("n_e"))) / F.log(F.lit(float(total)) / F.col("n_e"))
    strong = C.cut(counted.select("entity", "term", share.alias("disclosure")).filter(F.col("disclosure") >= generalise_at), "disclosure")
    span = F.struct("start", "end", F.when(F.col("disclosure") >= remove_at, 5).otherwise(4).alias("rank"), F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("kind"))
    marked = pairs.select("row", "entity", "term").join(strong, ["entity", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    words = rows.filter(F.size("words") > 0).select("row", F.explode("words").alias("x")).select("row", "x.*")
    terms = words.join(marked, ["row", "term"]).select("row", span.alias("s")).groupBy("row").agg(F.collect_list("s").alias("terms"))
    every = F.concat("found", F.coalesce("terms", F.expr("cast(array() as array<struct<start:bigint,end:bigint,rank:int,kind:string>>)")))
    ordered = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind")))
    return rows.join(terms, "row", "left").select("doc_id", ordered.alias("found"), "own", "plain")


_FOUND = "array<struct<start:long,end:long,rank:int,kind:string>>"


def cleaned(found: DataFrame) -> DataFrame:
    """`find_personal_data` with clean, the sanitised text, null where there is nothing to do."""

    def clean(batches):
        for whole in batches:
            for batch in C.sliced([whole], 2):
                new = [None if t is None else sanitise(t, f) for t, f in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(new, pa.string())], names=["doc_id", "found", "plain", "clean"])

    return found.select("doc_id", "found", "own", "plain").mapInArrow(clean, f"doc_id long, found {_FOUND}, plain string, clean string")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `find_personal_data`, and the SHA-256 of the sanitised text."""
    return cleaned(found).select("doc_id", *map(count_of, KINDS), F.sha2(listed(F.col("found"), KINDS), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.coalesce(F.sha2("clean", 256), "plain").alias("sanitised_sha256"))


def sanitise(text: str, found: list) -> str:
    """The text without its marked spans: entities leave their kind, generalised terms what they look like, removed terms nothing."""
    out, at = [], 0
    for x in found:
        if x["start"] >= at:
            shape = "[name]" if text[x["start"]].isupper() else "[term]"
            out += [text[at : x["start"]], "" if x["kind"] == "remove" else shape if x["kind"] == "generalise" else f"[{x['kind']}]"]
        at = max(at, x["end"])
    return "".join(out) + text[at:]


def sanitise_documents(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """The documents with their texts sanitised, all columns kept; n_chars, where there is one, follows the text."""
    keyed = C.cut(C.packed(docs).select("row", F.monotonically_increasing_id().alias("key")), "documents")
    found = find_personal_data(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), generalise_at, remove_at)
    new = cleaned(found).filter("clean is not null").select(F.col("doc_id").alias("key"), "clean")
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("clean").cast(docs.schema["n_chars"].dataType))
    return C.unpacked(keyed.join(new, "key", "left").select(F.when(F.col("clean").isNull(), F.col("row")).otherwise(row).alias("row")))
