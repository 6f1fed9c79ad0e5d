"""MinHash near-duplicates: universal hash minima, banding, signature verification, full sets, components by stars.

A document's set is its distinct word shingles (A-Z folded, words between white space); a text of fewer words than a shingle is one
shingle. Two documents are linked when 100 x intersection >= percent x union of their whole sets.

1. Documents with the same set become one class, stood for by its smallest doc_id.
2. Each class gets `bands x rows` minima of multiply-shift hashes, kept in 16 bits each. `bands` is set so that a pair at the
   threshold shares no band with a chance under MISS; what is left of MISS bounds the loss by step 3.
3. In each bucket (band and its minima) that holds two classes or more, all members are paired with one pivot. Pairs are dropped if
   their signatures agree in fewer places than a pair at the threshold does but for that chance, then confirmed on whole sets.
4. Links go to components. Where a bucket's members still lie in several components, all of its members are joined again, exactly,
   by prefixes: shingles are put in order of how many such documents hold them, those within one component first, and two linked
   sets of different components have their first common shingle near the front of both. Only documents that meet in such a shingle
   are compared: lengths, what the places of the shingle leave possible, signatures, and then whole sets of the pairs that remain.
   So near copies that differ in words of their own are never compared with each other, however many share a bucket.
5. Components over all links give the smallest doc_id.

Null or empty text, or one of white space: empty set, linked with nothing. Null doc_id: no member of any group, component_id null,
kept true. Rows that repeat a doc_id: one node, linked by any of their texts; each row gets the answer for its own text's class.
Empty table: no rows. Other columns are not read by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import connected_components

#: Chance that two documents at the threshold share no band or fail the signature check.
MISS = 1e-5
BAND_ROWS = 6
#: Rows of one side of a block.
BLOCK_ROWS = 1024
_CHUNK = 1 << 15


class Family:
    """Multiply-shift hash functions and their bands."""

    def __init__(self, percent: int, rows: int = BAND_ROWS, miss: float = MISS, seed: int = 7):
        self.percent, self.rows = percent, rows
        self.bands = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))
        self.hashes = self.bands * rows
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 2**63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, self.hashes, dtype=np.uint64)
        share = percent / 100
        # what banding leaves of the chance goes to the signature check, by the exact binomial
        left = miss - (1 - share**rows) ** self.bands
        self.least_equal = 0
        while (left := left - math.comb(self.hashes, self.least_equal) * share**self.least_equal * (1 - share) ** (self.hashes - self.least_equal)) >= 0:
            self.least_equal += 1

    def signatures(self, sets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The minima of non-empty sets that lie one after the other; 16 bits of each."""
        out = np.empty((len(first) - 1, self.hashes), np.uint64)
        for x, y in C.runs_of(first, _CHUNK):
            own, at = sets[first[x] : first[y]], first[x:y] - first[x]
            room = np.empty_like(own)
            for k in range(self.hashes):
                np.multiply(own, self.a[k], out=room)
                np.add(room, self.b[k], out=room)
                out[x:y, k] = np.minimum.reduceat(room, at)
        return (C.mixed(out) >> np.uint64(48)).astype(np.uint16)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts one after the other, and where each text's begin."""
    data, offsets = C.utf8(column)
    _, _, word, first = C.words(data, offsets, C.NOT_SPACE)
    count = np.diff(first)
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    start = np.concatenate([[0], np.cumsum(number)])
    text = np.repeat(np.arange(len(number)), number)
    at = np.arange(start[-1]) - start[text] + first[text]
    length = np.minimum(count[text], size)
    out = length.astype(np.uint64)
    for k in range(size):
        inside = length > k
        out[inside] = C.mixed(out[inside] * np.uint64(0x9E3779B97F4A7C15) + word[at[inside] + k])
    for a, b in zip(start[:-1], start[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[start[:-1][number > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])[start]
    return out[new], kept


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, shingle: int, family: Family) -> DataFrame:
    """doc_id, n_shingles, same (equal for equal sets, null for empty ones), minima (16 bits each)."""

    def sign(batches):
        for batch in C.sliced(batches, 1):
            sets, first = shingle_sets(batch.column(1), shingle)
            n = np.diff(first)
            full = np.flatnonzero(n)
            minima, same = [None] * len(n), [None] * len(n)
            if len(full):
                own = family.signatures(sets, np.concatenate([first[full], first[-1:]]))
                for row, i in enumerate(full.tolist()):
                    minima[i] = own[row].tobytes()
                    same[i] = hashlib.md5(sets[first[i] : first[i + 1]].tobytes()).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(minima, pa.binary())], names=["doc_id", "n_shingles", "same", "minima"])

    return _texts(docs).mapInArrow(sign, "doc_id long, n_shingles long, same binary, minima binary")


def whole_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its set of shingle hashes."""

    def take(batches):
        for batch in C.sliced(batches, 1):
            sets, first = shingle_sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(sets.view(np.int64)))], names=["doc_id", "shingles"])

    return docs.mapInArrow(take, "doc_id long, shingles array<long>")


def _agree(family: Family):
    """Places in which two signatures agree, counted in the JVM."""
    bits = F.expr(f"aggregate(sequence(0, {family.hashes - 1}), 0, (n, i) -> n + int(substring(x.minima, 2 * i + 1, 2) = substring(y.minima, 2 * i + 1, 2)))")
    return bits >= family.least_equal


def _linked(percent: int):
    common = F.size(F.array_intersect("x.shingles", "y.shingles")).cast("long")
    return 100 * common >= percent * (F.size("x.shingles") + F.size("y.shingles") - common)


def _cross_block(family: Family):
    """Pairs of different components that may be linked, among documents that hold one shingle in their prefixes."""

    def compare(table: pa.Table) -> pa.Table:
        doc, part, size, place = (table.column(x).to_numpy() for x in ("doc_id", "component", "n", "place"))
        indexed, outer = (table.column(x).to_numpy(zero_copy_only=False) for x in ("indexed", "outer"))
        minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint16).reshape(-1, family.hashes)
        left, right = np.flatnonzero(outer == 0), np.flatnonzero(outer == 1)
        found = []
        for i in left:
            n, m = size[i], size[right]
            least, most = np.minimum(n, m), np.maximum(n, m)
            left_over = np.minimum(n - place[i], m - place[right])
            # the smaller one (of equals, the one with the smaller id) must hold the shingle in its shorter prefix
            short = np.where((m < n) | ((m == n) & (doc[right] < doc[i])), indexed[right], indexed[i])
            fit = (part[right] != part[i]) & short & (100 * least >= family.percent * most) & ((100 + family.percent) * left_over >= family.percent * (n + m))
            others = right[fit]
            near = others[(minima[others] == minima[i]).sum(1) >= family.least_equal]
            found += [(int(doc[i]), int(doc[j])) if doc[i] < doc[j] else (int(doc[j]), int(doc[i])) for j in near]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return compare


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of docs with a doc_id: doc_id, n_shingles, component_id, kept.

    docs: doc_id, text. component_id is the smallest doc_id reachable by links, kept tells whether it is the row's own. The result is
    written; the tables that it was made from are deleted.
    """
    family = Family(percent, rows)
    with C.Scope() as scope:
        signed = C.cut(signatures(docs, shingle, family), "minhash")
        classes = signed.filter("doc_id is not null and same is not null").groupBy("same").agg(F.min(F.struct("doc_id", "n_shingles", "minima")).alias("r"))
        classes = C.cut(classes.select("same", "r.*"), "classes")
        width = 2 * family.rows
        keys = F.transform(F.sequence(F.lit(0), F.lit(family.bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.expr("minima").substr(i * width + 1, F.lit(width))).alias("bucket")))
        members = classes.select("doc_id", F.explode(keys).alias("k")).select("doc_id", "k.band", "k.bucket")
        # written, so that the join meets a plain shuffle, which adaptive execution may split at hot buckets
        pivots = C.cut(members.groupBy("band", "bucket").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("band", "bucket", "pivot"), "pivots")
        # only members of buckets that hold two classes or more go on
        shared = C.cut(members.join(pivots, ["band", "bucket"]).select("band", "bucket", "doc_id", "pivot"), "buckets")
        sets = C.cut(whole_sets(_texts(docs).join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), shingle), "sets")
        light = classes.select("doc_id", "minima")
        pairs = shared.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
        near = pairs.join(light.select(F.col("doc_id").alias("a"), F.struct("minima").alias("x")), "a").join(light.select(F.col("doc_id").alias("b"), F.struct("minima").alias("y")), "b").filter(_agree(family)).select("a", "b")
        first = C.cut(connected_components(C.cut(_confirmed(near, sets, percent), "links")), "first")
        rest = C.cut(_confirmed(_rest(shared, first, light, sets, family), sets, percent), "rest")
        groups = first
        if rest.first() is not None:
            groups = connected_components(first.toDF("a", "b").unionByName(rest))
        by_class = classes.select("same", "doc_id").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("same", F.coalesce("component", "doc_id").alias("component"))
        out = signed.select("doc_id", "n_shingles", "same").join(by_class, "same", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        return scope.kept(out, "duplicates")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked."""
    x, y = sets.select(F.col("doc_id").alias("a"), F.struct("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.struct("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").filter(_linked(percent)).select("a", "b").distinct()


def _rest(shared: DataFrame, groups: DataFrame, light: DataFrame, sets: DataFrame, family: Family) -> DataFrame:
    """Pairs that may be linked across the components that remain inside a bucket, by the prefixes of their sets."""
    member = shared.select("band", "bucket", "doc_id").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    several = member.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band", "bucket")
    open_ = C.cut(member.join(several, ["band", "bucket"]).select("doc_id", "component").distinct(), "open")
    held = sets.join(open_, "doc_id").select("doc_id", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    crossing = held.groupBy("s").agg(F.count("*").alias("f"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("s", "f")
    order = held.join(C.cut(crossing, "crossing"), "s").groupBy("doc_id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("c"))
    # the places of a set's front: those of shingles within one component, then the others by frequency
    percent = family.percent
    own, probed, indexed = F.col("n") - F.size("c"), F.expr(f"n - ceil({percent} * n / 100) + 1"), F.expr(f"n - ceil({2 * percent} * n / {100 + percent}) + 1")
    front = order.select("doc_id", "component", "n", own.alias("own"), indexed.alias("indexed"), F.slice("c", F.lit(1), F.greatest(F.lit(0), probed - own).cast("int")).alias("c"))
    front = front.select("doc_id", "component", "n", "own", "indexed", F.posexplode("c").alias("at", "c"))
    place = F.col("own") + F.col("at")
    front = C.cut(front.select("doc_id", "component", "n", place.alias("place"), (place < F.col("indexed")).alias("indexed"), F.col("c.s").alias("s")), "fronts")
    parts = front.groupBy("s", "component").agg(F.count("*").alias("n"), F.max("indexed").alias("indexed"))
    total = parts.groupBy("s").agg(F.count("*").alias("parts"), F.max("indexed").alias("any"), F.sum("n").alias("n"), F.max(F.struct("n", F.negative("component").alias("c"))).alias("main")).filter("parts > 1 and any")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    total = total.select("s", F.negative(F.col("main.c")).alias("main"), blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("main.n")).alias("few_blocks"))
    meeting = front.join(C.cut(total, "meetings"), "s")
    spread = F.xxhash64("doc_id")
    columns = ("s", "doc_id", "component", "n", "place", "indexed")
    every = meeting.select(*columns, F.lit(1).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("i"), F.pmod(spread, "all_blocks").cast("int").alias("j"))
    few = meeting.filter("component <> main").select(*columns, F.lit(0).alias("outer"), F.pmod(spread, "few_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"))
    rows = every.unionByName(few).join(light, "doc_id")
    return C.cut(rows.groupBy("s", "i", "j").applyInArrow(_cross_block(family), "a long, b long").distinct(), "maybe")


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = BAND_ROWS) -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest doc_id stays, all columns kept.

    Rows that repeat a doc_id stay or go together.
    """
    gone = near_duplicates(docs, shingle, percent, rows).filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    return C.unpacked(C.packed(docs, "doc_id").join(gone, F.col("doc_id") == F.col("id"), "left_anti"))
