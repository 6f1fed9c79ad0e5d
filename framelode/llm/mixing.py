"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked in turn to the target shares of each
dimension until all marginals are within TOLERANCE, SWEEPS times at most. A cell cannot give more tokens than it holds: its weight is
bounded by its capacity, tokens / (budget x all tokens). A step keeps the full cells of a category at their capacity and scales its
others to what remains of the target, so what full cells cannot give is drawn from others. A category whose cells together hold less
than its target is taken whole, and the rest of that target goes to the dimension's other categories in proportion (`attainable`);
targets that no choice of weights meets together leave the last dimension's met and the others' missed, after SWEEPS. `marginals` reports target, attainable, expected and drawn shares. A cell's calibrated probability is its weight over its capacity. A
document is sampled if a hash of seed and doc_id, as a number from 0 to 1, lies under its cell's probability, so a rerun draws the same
documents.

A dimension's targets name shares of categories; what they leave is shared among the other categories by their tokens, and names that
do not occur are left out. Null source, language or topic is a category of its own, "". Null text: no tokens, a "note". Null doc_id:
drawn as the text "". Repeated rows are drawn alike. Empty table: no rows. Very long texts count whole. Cells are few (their number is
checked): up to MOST_CELLS they are raked on the driver and broadcast, beyond that as tables. All columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMENSIONS = ("source", "lang", "topic")
#: None: equal shares for all categories.
TARGETS: dict[str, dict[str, float] | None] = {
    "source": None,
    "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15},
    "topic": {"article": 0.5, "longform": 0.3, "note": 0.05, "licensed": 0.1, "listing": 0.05},
}
BUDGET = 0.5
SWEEPS = 100
TOLERANCE = 1e-10
SEED = "mix-1"
MOST_CELLS = 50_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    return F.when(F.contains(text, F.lit(" | ")), "listing").when(F.contains(text, F.lit("License")), "licensed").when(tokens < 100, "note").when(tokens > 1000, "longform").otherwise("article")


def _cells(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    own = C.packed(docs, "doc_id", "source", "lang", "text")
    own = own.select("row", F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"), n_tokens(text).alias("n_tokens"))
    return own.select("row", "doc_id", "source", "lang", F.coalesce(topic_of(F.col("text"), F.col("n_tokens")), F.lit("note")).alias("topic"), "n_tokens")


def shares(own: dict[str, float], target: dict[str, float] | None) -> dict[str, float]:
    """Target shares of the categories that occur. own: tokens of each."""
    own = {k: v for k, v in own.items() if v > 0}
    if target is None:
        return dict.fromkeys(own, 1 / max(1, len(own)))
    named = {k: target[k] for k in own if target.get(k, 0) > 0}
    other = {k: v for k, v in own.items() if k not in target}
    rest = max(0.0, 1 - sum(target.values())) if other else 0.0
    out = named | {k: rest * v / sum(other.values()) for k, v in other.items()}
    total = sum(out.values())
    return {k: v / total for k, v in out.items()} if total else {}


def attainable(want: dict[str, float], capacity: dict[str, float]) -> dict[str, float]:
    """Target shares, none above its capacity: what is cut off goes to the others in proportion, as far as they can hold it."""
    for _ in want:
        full = {k for k, v in want.items() if v >= capacity[k]}
        open_ = sum(v for k, v in want.items() if k not in full)
        rest = 1 - sum(capacity[k] for k in full)
        new = {k: capacity[k] if k in full else v * rest / open_ for k, v in want.items()}
        if new == want or not open_:
            return new
        want = new
    return want


def _step(target: float, full: float, open_: float) -> float:
    """What a category's weights are scaled by, where `full` is held by cells at their capacity and `open_` by others."""
    if open_ > 0 and target > full:
        return (target - full) / open_
    return target / (full + open_) if full + open_ > target else 1.0


def rake(cells: list[tuple], targets: dict[str, dict[str, float] | None], sweeps: int = SWEEPS, budget: float = BUDGET) -> list[float]:
    """Weights that sum to 1, none above its capacity. cells: (category of each dimension, tokens)."""
    total = sum(c[-1] for c in cells) or 1
    capacity = [c[-1] / (budget * total) for c in cells]
    weight = [c[-1] / total for c in cells]

    def by(d: int, values) -> dict[str, float]:
        out: dict[str, float] = {}
        for c, v in zip(cells, values, strict=True):
            out[c[d]] = out.get(c[d], 0) + v
        return out

    want = [attainable(shares(by(d, (c[-1] for c in cells)), targets.get(name)), by(d, capacity)) for d, name in enumerate(DIMENSIONS)]
    for _ in range(sweeps):
        worst = 0.0
        for d in range(len(DIMENSIONS)):
            full = by(d, (p if w >= p else 0.0 for w, p in zip(weight, capacity, strict=True)))
            open_ = by(d, (w if w < p else 0.0 for w, p in zip(weight, capacity, strict=True)))
            worst = max([worst, *(abs(full[k] + open_[k] - want[d].get(k, 0.0)) for k in full)])
            scale = {k: _step(want[d].get(k, 0.0), full[k], open_[k]) for k in full}
            weight = [w * scale[c[d]] for c, w in zip(cells, weight, strict=True)]
        if worst < TOLERANCE:
            break
    return [min(w, p) for w, p in zip(weight, capacity, strict=True)]


def _wanted(now: DataFrame, name: str, target: dict[str, float] | None) -> DataFrame:
    """(category, share): `shares` and `attainable` for any number of categories."""
    own = now.groupBy(name).agg(F.sum("tokens").alias("t"), F.sum("capacity").alias("most")).filter("t > 0")
    if target is None:
        share = own.select(name, "most", (1 / F.lit(own.count())).alias("share"))
    else:
        given = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
        left = own.select(name, "t", "most", F.try_element_at(given, F.col(name)).alias("share"))
        named, other = left.agg(F.coalesce(F.sum("share"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("t"))), F.lit(0))).first()
        rest = max(0.0, 1 - sum(target.values())) if other else 0.0
        share = left.select(name, "most", (F.coalesce("share", F.lit(rest) * F.col("t") / F.lit(float(other or 1))) / F.lit((named + rest) or 1.0)).alias("share"))
    last = None
    while True:
        share = C.cut(share, "shares")
        is_full = F.col("share") >= F.col("most")
        number, full, open_ = share.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("share"))), F.lit(0.0))).first()
        if number == last or not number:
            return share.select(name, "share")
        last = number
        scale = (1 - full) / open_ if open_ else 1.0
        share = share.select(name, "most", F.when(is_full, F.col("most")).otherwise(F.col("share") * scale).alias("share"))


def _rake_tables(cells: DataFrame, targets: dict[str, dict[str, float] | None], sweeps: int, budget: float) -> DataFrame:
    """`rake` for any number of cells: a marginal is a sum, joined back; each sweep is written. Categories may be many, too."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    now = C.Cut(cells.select("*", (F.col("tokens") / F.lit(total)).alias("weight"), (F.col("tokens") / F.lit(budget * total)).alias("capacity")), "cells")
    wanted = [_wanted(now.df, name, targets.get(name)) for name in DIMENSIONS]
    is_full = F.col("weight") >= F.col("capacity")
    for _ in range(sweeps):
        df, off = now.df, F.lit(0.0)
        for d, (name, want) in enumerate(zip(DIMENSIONS, wanted, strict=True)):
            have = df.groupBy(name).agg(F.sum(F.when(is_full, F.col("capacity")).otherwise(0.0)).alias("full"), F.sum(F.when(~is_full, F.col("weight")).otherwise(0.0)).alias("open"))
            share, sum_ = F.coalesce("share", F.lit(0.0)), F.col("full") + F.col("open")
            scale = F.when((F.col("open") > 0) & (share > F.col("full")), (share - F.col("full")) / F.col("open")).when(sum_ > share, share / sum_).otherwise(1.0)
            step = have.join(want, name, "left").select(name, scale.alias("scale"), F.abs(sum_ - share).alias(f"off{d}"))
            df = df.drop(f"off{d}").join(step, name).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
            off = F.greatest(off, F.col(f"off{d}"))
        new = C.Cut(df.select(*DIMENSIONS, "tokens", "weight", "capacity", off.alias("off")), "cells")
        now.drop()
        now = new
        if (now.df.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    return now.df.select(*DIMENSIONS, F.least("weight", "capacity").alias("weight"), "capacity")


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, budget: float = BUDGET, seed: str = SEED, sweeps: int = SWEEPS, most_cells: int = MOST_CELLS) -> DataFrame:
    """Each row of docs as `row`, with doc_id, source, lang, topic, n_tokens, probability and sampled."""
    targets = TARGETS if targets is None else targets
    own = _cells(docs)
    cells = own.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    found = [tuple(x) for x in cells.limit(most_cells + 1).collect()]
    if len(found) > most_cells:
        table = _rake_tables(cells, targets, sweeps, budget)
    else:
        found.sort()
        total = sum(c[-1] for c in found) or 1
        rows = [(*c[:-1], float(w), c[-1] / (budget * total)) for c, w in zip(found, rake(found, targets, sweeps, budget), strict=True)]
        table = F.broadcast(docs.sparkSession.createDataFrame(rows, "source string, lang string, topic string, weight double, capacity double"))
    odds = F.coalesce(F.try_divide("weight", "capacity"), F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    joined = own.join(table.select(*DIMENSIONS, odds.alias("probability")), list(DIMENSIONS), "left")
    return joined.select("row", "doc_id", *DIMENSIONS, "n_tokens", "probability", (draw < F.col("probability")).alias("sampled"))


def marginals(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """Of each category of each dimension its shares: target (null: none named), available, expected and drawn, of tokens."""
    targets = TARGETS if targets is None else targets
    every = probabilities(docs, targets, budget, seed).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in DIMENSIONS])).alias("c"), "n_tokens", "probability", "sampled")
    own = every.groupBy("c").agg(F.sum("n_tokens").alias("a"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("d"))
    all_ = own.groupBy("c.dimension").agg(*[F.sum(x).alias(f"all_{x}") for x in "aed"])
    named = F.create_map(*[F.lit(x) for d, t in targets.items() for k, v in (t or {}).items() for x in (f"{d}={k}", float(v))]) if any(targets.values()) else F.create_map(F.lit(""), F.lit(0.0))
    part = lambda x: F.coalesce(F.try_divide(F.col(x), F.col(f"all_{x}")), F.lit(0.0))
    return own.select("c.*", "a", "e", "d").join(F.broadcast(all_), "dimension").select("dimension", "category", F.try_element_at(named, F.concat_ws("=", "dimension", "category")).alias("target"), part("a").alias("available"), part("e").alias("expected"), part("d").alias("drawn"))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, its cell, n_tokens, probability (6 places), sampled."""
    return probabilities(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *DIMENSIONS, "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """The sampled documents, all columns kept."""
    return C.unpacked(probabilities(docs, targets, budget, seed).filter("sampled").select("row"))
