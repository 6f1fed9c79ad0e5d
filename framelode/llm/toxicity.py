"""Toxicity: a support vector machine over a gapped subsequence kernel with Nyström landmarks, trained on labelled documents.

A text falls into units: its words without ASCII punctuation, A-Z folded, where consecutive pieces of one letter are one unit. A word
that spaces split into longer pieces is several units and is not put together again. The
kernel of two units counts the subsequences of ORDER bytes that both hold within SPAN bytes (the ends count as bytes), weighted by
DECAY for each byte skipped, over the root of both units' own weights: "idiot", "i-d-i-o-t", "idxiot" stay close.

Landmarks are the units that set toxic documents apart most, and as many from other documents. Nyström's map takes a unit to
K_mm^(-1/2) k_m(u); a linear machine with squared hinge loss is trained on units there, where the units that speak for a toxic
document are chosen anew each round (the label is the document's). As the kernel has explicit features, the trained machine folds into
one table of weights, so scoring a text looks up its subsequences. The text's score is a logistic of its highest unit, the mean of its
three highest, how many lie on the toxic side, and how many there are, calibrated across two folds.

The machine is fitted on a bounded sample of labelled documents (MOST_TOXIC and MOST_CLEAN, in the order of a hash of doc_id);
every text is scored whole. Null or empty text: scored as a text without units. No labels, or labels of one kind: the prior alone.
Repeated rows are scored alike; null labels are ignored, several labels of a document count as their largest. An empty table gives
no rows. Scores read the text only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER, SPAN, DECAY = 4, 6, 0.7
TABLE_BITS = 18
LANDMARKS = 256
MOST_TOXIC, MOST_CLEAN = 2000, 5000
NEGATIVES = 12_000
#: Units of clean documents that each round adds, those that it takes for toxic most.
HARD = 6_000
ROUNDS = 3
#: Log-odds from which a unit may speak for a toxic document.
SURE = 1.5
LEARN_FOLDS = 5

_GAPS = [(a, b, c) for a in range(1, SPAN - 2) for b in range(a + 1, SPAN - 1) for c in range(b + 1, SPAN)]
_SIGNS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_OPEN, _CLOSE = 1, 2
_KEPT = np.ones(256, bool)
_KEPT[:48] = _KEPT[58:65] = _KEPT[91:97] = _KEPT[123:128] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CHUNK = 1 << 16
#: Bytes of text that are taken apart at once.
_PART = 2 << 20


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all units with their end marks, where each unit begins (and the length), and where each text's units begin."""
    start, end, _, first = C.words(data, offsets, C.NOT_SPACE)
    size = end - start
    glued = np.zeros(len(start), bool)
    short = (size == 1) | ((size == 2) & (data[start] >= 0xC0)) if len(start) else glued
    glued[1:] = short[1:] & short[:-1]
    glued[first[:-1][first[:-1] < len(start)]] = False
    head = np.flatnonzero(~glued)
    unit_of_text = np.searchsorted(head, first)
    mark = np.zeros(len(data) + 1, bool)
    mark[start[head]] = True
    keep = _KEPT[data]
    unit = np.cumsum(mark[:-1], dtype=np.int32) - 1
    body, owner = _FOLD[data[keep]], unit[keep]
    length = np.bincount(owner, minlength=len(head)) + 2
    begin = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(begin[-1], np.uint8)
    out[begin[:-1]], out[begin[1:] - 1] = _OPEN, _CLOSE
    inner = np.ones(len(out), bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    out[inner] = body
    return out, begin, unit_of_text


def _features(stream: np.ndarray, begin: np.ndarray):
    """For each shape of gaps: the table places of the subsequences, where they start, and their weight."""
    wide = stream.astype(np.uint32)
    part = [wide * sign for sign in _SIGNS]
    unit = np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin))
    n = len(stream)
    for a, b, c in _GAPS:
        if n <= c:
            continue
        key = part[0][: n - c] + part[1][a : n - c + a]
        key += part[2][b : n - c + b]
        key += part[3][c:]
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        key >>= np.uint32(32 - TABLE_BITS)
        yield key.view(np.int32), unit[: n - c] == unit[c:], DECAY ** (c - ORDER + 1)


def _norms(begin: np.ndarray) -> np.ndarray:
    length = np.diff(begin)
    return np.sqrt(np.maximum(sum(DECAY ** (2 * (c - ORDER + 1)) * np.maximum(0, length - c) for _, _, c in _GAPS), 1e-9))


@dataclass(frozen=True)
class Model:
    """weight: of each subsequence; line: of the logistic over 1 and the evidence."""

    weight: np.ndarray
    bias: float
    line: np.ndarray

    def unit_scores(self, stream: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin) - 1, np.float32)
        for x, y in C.runs_of(begin, _CHUNK):
            own, at = stream[begin[x] : begin[y]], begin[x : y + 1] - begin[x]
            total = np.zeros(len(own), np.float32)
            for place, valid, decay in _features(own, at):
                value = self.weight.take(place)
                value *= valid
                value *= np.float32(decay)
                total[: len(place)] += value
            out[x:y] = np.add.reduceat(total, at[:-1]) / _norms(at) + self.bias
        return out

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text the highest unit, the mean of its three highest, the logs of the units on the toxic side and of all units."""
        stream, begin, first = units(data, offsets)
        score = self.unit_scores(stream, begin) if len(begin) > 1 else np.empty(0, np.float32)
        out = np.tile([self.bias, self.bias, 0.0, 0.0], (len(offsets) - 1, 1))
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if b > a:
                own = score[a:b]
                top = np.partition(own, -3)[-3:] if len(own) > 3 else own
                out[i] = top.max(), top.sum() / 3 + self.bias * (3 - len(top)) / 3, np.log1p((own > 0.5).sum()), np.log1p(len(own))
        return out

    def all_evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """`evidence`, in parts of bounded size."""
        return np.concatenate([np.empty((0, 4)), *[self.evidence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in C.runs_of(offsets, _PART)]])

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] + evidence @ self.line[1:], -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton's steps of a ridge logistic regression with a free constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, hold = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton's steps on the examples inside the margin."""
    x = np.column_stack([x, np.ones(len(x))])
    w, hold = np.zeros(x.shape[1]), np.eye(x.shape[1])
    hold[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        own = x[inside]
        new = np.linalg.solve(hold + (own * cost[inside, None]).T @ own, own.T @ (cost[inside] * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


class Sample:
    """Labelled texts as sets of numbered units."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray):
        rows, bounds, past = [], [np.zeros(1, np.int64)], 0
        for a, b in C.runs_of(offsets, _PART):
            stream, begin, first = units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            rows.append(pa.BinaryArray.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(stream)]))
            bounds.append(first[1:] + past)
            past += len(begin) - 1
        coded = pa.chunked_array(rows, pa.binary()).dictionary_encode().unify_dictionaries()
        code = np.concatenate([np.empty(0, np.int32), *[c.indices.to_numpy() for c in coded.chunks]])
        self.names = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.binary())
        self.toxic = toxic
        first = np.concatenate(bounds)
        self.units = [np.unique(code[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def stream(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.names.take(pa.array(chosen)).cast(pa.large_binary())
        _, offsets, data = own.buffers()
        begin = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1]
        return np.frombuffer(data, np.uint8)[begin[0] : begin[-1]], begin - begin[0]


def _kernel(stream, begin, marks_stream, marks_begin) -> np.ndarray:
    """Kernel values of units against landmarks, through the landmarks' own subsequences."""
    m = len(marks_begin) - 1
    place_of = np.full(1 << TABLE_BITS, -1, np.int32)
    found = [(p[v], np.repeat(np.arange(m), np.diff(marks_begin))[: len(p)][v], d) for p, v, d in _features(marks_stream, marks_begin)]
    used = np.unique(np.concatenate([p for p, _, _ in found] or [np.empty(0, np.int32)]))
    place_of[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, m), np.float32)
    for p, owner, d in found:
        np.add.at(table, (place_of[p], owner), d)
    out = np.zeros((len(begin) - 1, m), np.float32)
    for x, y in C.runs_of(begin, 1 << 14):
        own, at = stream[begin[x] : begin[y]], begin[x : y + 1] - begin[x]
        room = np.zeros((len(own), m), np.float32)
        for place, valid, d in _features(own, at):
            row = place_of[place]
            on = np.flatnonzero(valid & (row >= 0))
            room[on] += d * table[row[on]]
        out[x:y] = np.add.reduceat(room, at[:-1], 0)
    return out / _norms(begin)[:, None] / _norms(marks_begin)[None, :]


def _weights(sample: Sample, docs: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """The machine trained on these documents of the sample, as a table of weights and a bias."""
    n = len(sample.names)
    toxic, clean = [sample.units[i] for i in docs if sample.toxic[i]], [sample.units[i] for i in docs if not sample.toxic[i]]
    in_toxic, in_clean = (np.bincount(np.concatenate(x), minlength=n) if x else np.zeros(n, int) for x in (toxic, clean))
    odds = np.log((in_toxic + 0.5) / (len(toxic) + 1)) - np.log((in_clean + 0.5) / (len(clean) + 1))
    draw = np.random.default_rng(seed)
    telling = np.argsort(-odds * np.log1p(in_toxic), kind="stable")[: LANDMARKS // 2]
    other = np.flatnonzero(in_clean > 0)
    other = draw.choice(other, min(len(other), LANDMARKS // 2), replace=False, p=in_clean[other] / in_clean[other].sum())
    marks = np.unique(np.concatenate([telling, other]))
    marks_stream, marks_begin = sample.stream(marks)
    value, vector = np.linalg.eigh(_kernel(marks_stream, marks_begin, marks_stream, marks_begin).astype(np.float64))
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])
    negative = np.flatnonzero((in_clean > 0))
    if len(negative) > NEGATIVES:
        negative = draw.choice(negative, NEGATIVES, replace=False)
    strength = odds * np.log1p(in_toxic)
    telltale = odds > SURE
    speak = np.unique(np.concatenate([u[np.argsort(-strength[u], kind="stable")[:2]] for u in toxic]))
    every = np.flatnonzero(in_toxic + in_clean)
    stream, begin = sample.stream(every)
    for turn in range(ROUNDS):
        positive = speak[telltale[speak]]
        if not len(positive):
            return np.zeros(1 << TABLE_BITS, np.float32), 0.0
        chosen = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        often = np.sqrt(np.where(y > 0, in_toxic[chosen], in_clean[chosen]))
        cost = np.where(y > 0, often / max(1, often[y > 0].sum()), often / max(1, often[y < 0].sum())) * len(y) * 0.5
        theta, bias = _machine(_kernel(*sample.stream(chosen), marks_stream, marks_begin) @ root, y, cost)
        beta = root @ theta / _norms(marks_begin)
        weight = np.zeros(1 << TABLE_BITS, np.float32)
        for place, valid, d in _features(marks_stream, marks_begin):
            np.add.at(weight, place[valid], d * np.repeat(beta, np.diff(marks_begin))[: len(place)][valid])
        if turn + 1 < ROUNDS:
            score = np.zeros(n)
            score[every] = Model(weight, bias, np.zeros(5)).unit_scores(stream, begin)
            speak = np.unique(np.concatenate([u[np.argsort(-(score * telltale)[u], kind="stable")[:3]] for u in toxic]))
            # units of clean documents that the machine takes for toxic join the negatives
            clean_units = every[(in_clean[every] > 0) & ~telltale[every]]
            hard = clean_units[np.argsort(-score[clean_units], kind="stable")[:HARD]]
            negative = np.unique(np.concatenate([negative, hard]))
    return weight, bias


def fit(texts: list[str | None] | pa.ChunkedArray, toxic: list[int]) -> Model:
    """Trains on labelled texts. Without both labels: the prior alone."""
    label = np.array(toxic, bool)
    prior = np.log((label.sum() + 0.5) / ((~label).sum() + 0.5)) if len(label) else -3.0
    blank = Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0, np.array([prior, 0.0, 0.0, 0.0, 0.0]))
    if min(label.sum(), (~label).sum()) < 2:
        return blank
    data, offsets = C.utf8(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string()))
    sample = Sample(data, offsets, label)
    if not any(len(sample.units[i]) for i in np.flatnonzero(label)) or not any(len(sample.units[i]) for i in np.flatnonzero(~label)):
        return blank
    fold = np.zeros(len(label), int)
    for kind in (True, False):
        own = np.flatnonzero(label == kind)
        fold[own] = np.arange(len(own)) % 2
    evidence = np.zeros((len(label), 4))
    for k in (0, 1):
        weight, bias = _weights(sample, np.flatnonzero(fold != k), seed=k)
        evidence[fold == k] = Model(weight, bias, np.zeros(5)).all_evidence(data, offsets)[fold == k]
    weight, bias = _weights(sample, np.arange(len(label)), seed=2)
    return Model(weight.astype(np.float32), bias, _logistic(evidence, label.astype(float)))


def learning_rows(docs: DataFrame, labels: DataFrame, folds: int = LEARN_FOLDS, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """(text, toxic) of the bounded sample: labelled documents whose crc32 of doc_id is not 0 modulo folds."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic")).filter(F.crc32(F.col("id").cast("string")) % folds != 0)
    order = [F.xxhash64("id"), F.col("id")]
    chosen = own.filter("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(own.filter("toxic = 0").orderBy(*order).limit(most_clean))
    # at most most_toxic + most_clean rows of two numbers: a proven bound
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).orderBy("id").select("text", "toxic")


def score(docs: DataFrame, labels: DataFrame, folds: int = LEARN_FOLDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. docs: doc_id, text. labels: doc_id, toxic."""
    rows = learning_rows(docs, labels, folds).toArrow()
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.column("text"), rows.column("toxic").to_pylist()))
    del rows

    def assess(batches):
        own = model.value
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            p = own.probability(own.all_evidence(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(assess, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
