"""Edit-aware token counts: a segment tree over each document's pre-tokens, and edits that re-encode only what they touch.

The pre-tokens of a text (the pieces that byte-pair encoding never joins) are the tree's leaves, in blocks; each node holds the
characters and tokens below it. An edit finds its block by characters, splits the text anew from a little before the edit until the
new pieces fall into step with the old ones, encodes those pieces alone, and updates the sums on the way up.

Trees outlive a run: `store` gives each document's leaves as a table, and `update` applies a table of edits to stored trees and the texts
they were made from, so a later run encodes what its edits touch and nothing else.

The vocabulary is a file of ranks on the driver, named by a parameter and broadcast; counts of pieces are kept in a bounded table.
Null text counts as empty: 0 tokens. Repeated rows are counted alike; an empty table gives no rows; very long texts and pieces are
counted whole. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .pii import KINDS, base_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pattern of pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters before an edit that the pattern may look at from an earlier piece.
LOOK = 3
BLOCK = 64
KNOWN_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Counter(dict):
    """Tokens of each piece; the table starts anew when it holds KNOWN_PIECES."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= KNOWN_PIECES:
            self.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) < 64:
            self[piece] = n
        return n

    def leaves(self, text: str) -> list[tuple[int, int]]:
        return [(len(p), self[p]) for p in self.pieces.findall(text)]


class Tree:
    """Sums of characters and tokens over blocks of leaves."""

    def __init__(self, leaves: Iterable[tuple[int, int]]):
        every = list(leaves)
        self.blocks = [every[i : i + BLOCK] for i in range(0, len(every), BLOCK)] or [[]]
        self._build()

    def _build(self) -> None:
        self.width = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, block in enumerate(self.blocks):
            self._sum(i, block)
        for node in range(self.width - 1, 0, -1):
            self._join(node)

    def _sum(self, i: int, block: list[tuple[int, int]]) -> None:
        self.chars[self.width + i], self.tokens[self.width + i] = sum(c for c, _ in block), sum(t for _, t in block)

    def _join(self, node: int) -> None:
        self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, char: int) -> tuple[int, int]:
        """The block that holds this character, and the characters before the block."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if char - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def replace(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        """Puts leaves in place of those of blocks first to last; only these and the nodes above them change."""
        if len(leaves) > 4 * BLOCK:
            self.blocks[first : last + 1] = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)]
            self._build()
            return
        for i in range(first, last + 1):
            self.blocks[i] = leaves if i == first else []
            self._sum(i, self.blocks[i])
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for node in range(low, high + 1):
                self._join(node)
            low, high = low // 2, high // 2


def edit(tree: Tree, counter: Counter, old: str, start: int, end: int, new: str) -> tuple[str, int]:
    """Replaces old[start:end] by new and updates the tree; returns the new text and how many pieces were encoded."""
    text = old[:start] + new + old[end:]
    shift = len(new) - (end - start)
    block, before = tree.find(max(0, start - LOOK))
    own, at = tree.blocks[block], before
    kept = 0  # leaves of the block that end well before the edit
    while kept < len(own) and at + own[kept][0] <= start - LOOK:
        at += own[kept][0]
        kept += 1
    # old boundaries after the edit, read on as the new pieces are
    last, place, index = block, at, kept
    leaves, encoded, to = own[:kept], 0, at
    while to < len(text):
        piece = counter.pieces.match(text, to)[0]
        leaves.append((len(piece), counter[piece]))
        encoded += 1
        to += len(piece)
        while place + shift < to or place < end:
            while index >= len(tree.blocks[last]):
                if last + 1 >= len(tree.blocks):
                    break
                last, index = last + 1, 0
            else:
                place += tree.blocks[last][index][0]
                index += 1
                continue
            break
        if place + shift == to and place >= end:
            break
    else:
        last, index = len(tree.blocks) - 1, len(tree.blocks[-1])
    tree.replace(block, last, leaves + tree.blocks[last][index:])
    return text, encoded


def masks(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: personal data becomes its kind in brackets; overlapping spans are one."""
    out: list[tuple[int, int, str]] = []
    for a, kind, b in base_spans(text):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, f"[{KINDS[kind]}]"))
    return out


def count_tokens(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = masks, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces and n_tokens of the text, n_edits, n_tokens_edited after them, n_encoded pieces for that.

    edits gives (start, end, replacement) of a text, in order and without overlap.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def count(batches):
        counter = Counter(ranks.value, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                tree = Tree(counter.leaves(text))
                pieces, tokens, encoded, shift = sum(map(len, tree.blocks)), tree.total, 0, 0
                todo = edits(text)
                for start, end, new in todo:
                    text, n = edit(tree, counter, text, start + shift, end + shift, new)
                    encoded += n
                    shift += len(new) - (end - start)
                rows.append((pieces, tokens, len(todo), tree.total, encoded))
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n_pieces", "n_tokens", "n_edits", "n_tokens_edited", "n_encoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_pieces long, n_tokens long, n_edits long, n_tokens_edited long, n_encoded long")


_STORED = "doc_id long, lengths array<int>, tokens array<int>, n_tokens long"


def store(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Each row's tree as the characters and tokens of its leaves in order: doc_id, lengths, tokens, n_tokens. docs: doc_id, text."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def plant(batches):
        counter = Counter(ranks.value, pattern)
        for whole in batches:
            for batch in C.sliced([whole], 1):
                leaves = [counter.leaves(t.as_py() or "") for t in batch.column(1)]
                lists = [pa.array([[x[k] for x in own] for own in leaves], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array([sum(t for _, t in own) for own in leaves], pa.int64())], names=["doc_id", "lengths", "tokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(plant, _STORED)


def update(stored: DataFrame, docs: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Stored trees after edits, with the edited texts: of each document that edits name doc_id, text, lengths, tokens, n_tokens, n_encoded.

    stored: as `store` gives it. docs: doc_id, text, of which it was made, doc_id unique. edits: doc_id, start, end, new, by places of the
    old text, without overlap; they are put in order. Documents without edits are not read beyond the join and not returned.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    todo = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("edits"))
    rows = todo.join(docs.select("doc_id", "text"), "doc_id").join(stored, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lengths", "tokens", "edits")

    def apply(batches):
        counter = Counter(ranks.value, pattern)
        for whole in batches:
            for batch in C.sliced([whole], 1):
                out = []
                for text, lengths, tokens, own in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    text, tree, encoded, shift = text or "", Tree(zip(lengths, tokens, strict=True)), 0, 0
                    for e in own:
                        text, n = edit(tree, counter, text, e["start"] + shift, e["end"] + shift, e["new"])
                        encoded += n
                        shift += len(e["new"]) - (e["end"] - e["start"])
                    leaves = [x for block in tree.blocks for x in block]
                    out.append((text, [c for c, _ in leaves], [t for _, t in leaves], tree.total, encoded))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "text", "lengths", "tokens", "n_tokens", "n_encoded"])

    return rows.mapInArrow(apply, "doc_id long, text string, lengths array<int>, tokens array<int>, n_tokens long, n_encoded long")
