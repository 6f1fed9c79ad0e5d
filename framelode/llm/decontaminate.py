"""Benchmark decontamination: an FM-index per shard of documents, searched for all windows of the benchmark items.

A window is ten consecutive words of an item (an item of fewer words is one window). The documents of a shard become one sequence
of symbols: words that the benchmark uses keep their own symbol, each run of other words and each end of a document is one foreign
symbol, which no window holds. Backward search through wavelet-tree ranks finds the windows' suffix ranges, sampled suffix
positions place them, and overlapping occurrences merge into spans.

Documents never move: a shard is a run of documents of one Arrow batch, so no key can be hot. Benchmark items are read in blocks of
bounded size; one block serves up to BLOCK_WORDS words of items. With several blocks the documents are written once under a key of
their row, what all blocks find in a row is united by it, and texts are cut by these united spans, so the number of blocks changes no
result.

Null or empty text: no words, not contaminated. Null item text or an item without words: ignored. Null item_id: its windows count
as hits, the item is not listed. Repeated rows: each is judged alone; repeated items: listed once. Empty tables: no rows, or
documents without hits. Other columns are not read by `contamination`, and kept by `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .fm_index import FMIndex

WINDOW = 10
#: Benchmark words that one pass holds in the driver and in each Python worker.
BLOCK_WORDS = 2_000_000
#: Bytes of text that one index covers.
SHARD_BYTES = 4 << 20

_FOUND = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>, word_spans array<struct<start:long,end:long>>"


class Windows:
    """The distinct windows of some items, as symbols over these items' own words."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW):
        texts = [C.word_hashes(text, C.ALNUM) for _, text in items]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *texts]))
        rows: dict[bytes, set[int]] = {}
        for (item, _), own in zip(items, texts, strict=True):
            symbols = np.searchsorted(self.vocabulary, own).astype(np.int32) + 2
            size = min(window, len(symbols))
            for at in range(len(symbols) - size + 1 if size else 0):
                rows.setdefault(symbols[at : at + size].tobytes(), set()).update([] if item is None else [item])
        self.lengths = np.array([len(k) // 4 for k in rows], np.int64)
        self.phrases = np.zeros((len(rows), window), np.int64)
        for row, key in enumerate(rows):
            own = np.frombuffer(key, np.int32)
            self.phrases[row, window - len(own) :] = own
        self.items = list(rows.values())

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words: 1 for a foreign one."""
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
        """For each word whether a window covers it; for each text the items found. first: where each text's words begin, and their number."""
        texts, n = len(first) - 1, len(hashes)
        hit, items = np.zeros(n, bool), [set() for _ in range(texts)]
        symbol = self.symbols(hashes)
        known = symbol > 1
        opens = np.zeros(n + 1, bool)
        opens[first] = True
        # one foreign symbol stands before each run of known words of one text
        head = known & (opens[:n] | np.concatenate([[True], ~known[:-1]]))
        kept = np.flatnonzero(known)
        if not len(kept) or not len(self.lengths):
            return hit, items
        gap = head[kept].astype(np.int64)
        place = np.arange(len(kept)) + np.cumsum(gap)
        seq = np.ones(len(kept) + int(gap.sum()), np.int64)
        seq[place] = symbol[kept]
        index = FMIndex(seq, len(self.vocabulary) + 1)
        low, high = index.search(self.phrases, self.lengths)
        found = np.flatnonzero(high > low)
        if not len(found):
            return hit, items
        count = (high - low)[found]
        row = np.repeat(low[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        phrase = np.repeat(found, count)
        at = index.locate(row)
        word_of = np.zeros(len(seq), np.int64)
        word_of[place] = kept
        start = word_of[at]
        cover = np.bincount(start, minlength=n + 1) - np.bincount(start + self.lengths[phrase], minlength=n + 1)
        hit = np.cumsum(cover)[:n] > 0
        text = np.searchsorted(first, start, "right") - 1
        for pair in np.unique(text * len(self.lengths) + phrase).tolist():
            items[pair // len(self.lengths)] |= self.items[pair % len(self.lengths)]
        return hit, items


def _shards(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = C.utf8(column)
    for a, b in C.runs_of(offsets, SHARD_BYTES):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _runs(flags: np.ndarray) -> np.ndarray:
    """Start and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _spans(data: np.ndarray, offsets: np.ndarray, windows: Windows):
    """Of each text of a shard: words, runs of hit words, their byte spans, items."""
    start, end, hashes, first = C.words(data, offsets, C.ALNUM)
    hit, items = windows.hits(hashes, first)
    any_hit = np.concatenate([[0], np.cumsum(hit)])
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if any_hit[b] > any_hit[a]:
            run = _runs(hit[a:b])
            yield b - a, run, np.stack([start[a + run[:, 0]], end[a + run[:, 1] - 1]], 1) - offsets[i], items[i]
        else:
            yield b - a, None, None, items[i]


def _blocks(bench: DataFrame, block_words: int, window: int) -> list[Broadcast]:
    """The items in blocks of bounded size, read one after the other."""
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text is not null").distinct()
    sizes = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-sizes // (4 * block_words)))
    shared = []
    for part in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        shared.append(bench.sparkSession.sparkContext.broadcast(Windows([tuple(x) for x in own.collect()], window)))
    return shared


def _found(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """What one block finds in each row of texts: doc_id, text."""

    def find(batches):
        own = shared.value
        for batch in batches:
            out = []
            for a, b, data, offsets in _shards(batch.column(1)):
                for i, (n, run, span, items) in enumerate(_spans(data, offsets, own)):
                    if run is not None:
                        points = C.code_points(data[offsets[i] : offsets[i + 1]])
                        span = [{"start": int(s), "end": int(e)} for s, e in points[span]]
                        run = [{"start": int(s), "end": int(e)} for s, e in run]
                    out.append((int(n), span or [], sorted(items), run or []) if run is not None else (int(n), [], sorted(items), []))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), spans, pa.list_(pa.int64()), spans), strict=True)]], names=["doc_id", "n_words", "spans", "items", "word_spans"])

    return texts.mapInArrow(find, _FOUND)


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (code points of merged occurrences), items (sorted ids), word_spans.

    docs: doc_id, text. bench: item_id, text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(bench, block_words, window)
    if len(blocks) == 1:
        return _found(texts, blocks[0])
    rows = C.cut(texts.withColumn("key", F.monotonically_increasing_id()), "texts")
    found = _merged(rows.select("key", "text"), blocks)
    return rows.select("key", "doc_id").join(found, "key").select("doc_id", "n_words", "spans", "items", "word_spans")


def _merged(texts: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """What all blocks find in each row of texts (a unique key, text): spans that share or adjoin words united, items together."""
    every = _found(texts, blocks[0])
    for block in blocks[1:]:
        every = every.unionByName(_found(texts, block))
    unite = """aggregate(sort_array(flatten(collect_list(zip_with(word_spans, spans, (w, s) -> named_struct('a', w.start, 'b', w.end, 'start', s.start, 'end', s.end))))),
        cast(array() as array<struct<a:bigint,b:bigint,start:bigint,end:bigint>>),
        (acc, x) -> CASE WHEN size(acc) > 0 AND x.a <= element_at(acc, -1).b
            THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b),
                'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
            ELSE concat(acc, array(x)) END)"""
    united = every.groupBy(F.col("doc_id").alias("key")).agg(F.max("n_words").alias("n_words"), F.expr(unite).alias("u"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    part = "transform(u, x -> named_struct('start', x.{}, 'end', x.{}))"
    return united.select("key", "n_words", F.expr(part.format("start", "end")).alias("spans"), "items", F.expr(part.format("a", "b")).alias("word_spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `contamination`."""
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without their benchmark spans, all columns kept; n_chars, where there is one, follows the text.

    A span goes from its first to its last word; what stands around it stays. If cutting joins words to a window again, that is cut
    too. A text without hits is returned as it is, null included.
    """
    columns, types = docs.columns, docs.schema
    blocks = _blocks(bench, block_words, window)
    if len(blocks) > 1:
        return _cut_by_all(docs, blocks)
    (shared,) = blocks

    def clean(batches):
        own, place = shared.value, columns.index("text")
        for batch in C.sliced(batches, place):
            texts = batch.column(place)
            new: dict[int, str] = {}
            for a, _, data, offsets in _shards(texts):
                for i, (_, run, span, _) in enumerate(_spans(data, offsets, own)):
                    if run is not None:
                        new[a + i] = _without(data[offsets[i] : offsets[i + 1]], span, own)
            arrays = list(batch.columns)
            if new:
                arrays[place] = pa.array([new.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
                if "n_chars" in columns:
                    at = columns.index("n_chars")
                    sizes = arrays[at].to_pylist()
                    arrays[at] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(sizes)], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(clean, types)


def _cut_by_all(docs: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """`decontaminate` with several blocks: all of them search a text before it is cut, until none finds anything."""
    rows = C.cut(C.packed(docs).select("row", F.col("row.text").cast("string").alias("text"), F.monotonically_increasing_id().alias("key")), "texts")

    def shorten(batches):
        for batch in batches:
            new = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                edges = [0, *[x for s in spans for x in (s["start"], s["end"])], len(text)]
                new.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["key", "text"])

    rest, rounds = rows.select("key", "text"), []
    while True:
        hit = _merged(rest, blocks).filter(F.size("spans") > 0).select("key", "spans")
        rest = C.cut(rest.join(hit, "key").select("key", "text", "spans").mapInArrow(shorten, "key long, text string"), "shortened")
        if rest.isEmpty():
            break
        rounds.append(rest.withColumn("round", F.lit(len(rounds))))
    if not rounds:
        return C.unpacked(rows.select("row"))
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    last = every.groupBy("key").agg(F.max_by("text", "round").alias("new"))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    return C.unpacked(rows.select("key", "row").join(last, "key", "left").select(F.when(F.col("new").isNull(), F.col("row")).otherwise(row).alias("row")))


def _without(data: np.ndarray, span: np.ndarray, windows: Windows) -> str:
    while True:
        keep = np.ones(len(data), bool)
        for a, b in span:
            keep[a:b] = False
        data = data[keep]
        (_, run, span, _), *_ = _spans(data, np.array([0, len(data)]), windows)
        if run is None:
            return data.tobytes().decode()
