"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule tests a few figures of a text. On a sample the cost of every figure and the rows that every rule rejects are measured, and
the rules are put in order of rejection per cost: each next rule is the one that rejects most of the rows still alive for the figures
that no earlier rule has computed. A row stops at the first rule that rejects it, and a figure is computed once, when a rule first
needs it. The order changes how fast the verdict is reached, never the verdict.

Null or empty text, or one without words: no words, rejected as too short. Repeated rows are judged alike; an empty table gives no
rows (and keeps the rules' given order). Very long texts are judged whole, in time n log n of their words. `judge` reads doc_id and
text; `keep_good` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: Rows on which cost and selectivity are measured, about: each row is drawn by itself.
SAMPLE_ROWS = 1000
#: Timed runs of a figure: the first also makes its code, and the least time counts.
RUNS = 2

Known = Mapping[str, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text: split at single spaces, which needs no pattern."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    odd = F.contains(text, F.lit("\t"))
    for sign in "\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(sign))
    return F.array_remove(F.split(F.when(odd, F.translate(flat, "\t\x0b\x0c\r", "    ")).otherwise(flat), " "), "")


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{C.SPACE}]"))


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort, mark equal neighbours, unite the windows."""

    def unite(order: Column) -> Column:
        last = F.size(order) - 1
        same = lambda x, j: F.coalesce(F.get(order, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(order, lambda x, i: same(x, i - 1) | ((i < last) & same(x, i + 1)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    marked = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(marked), unite))


def n_repeat_words(tokens: Column) -> Column:
    """Words in windows of three words found twice or more in the text."""
    after = lambda x, n: F.slice(x, F.lit(n + 1), F.size(x))
    pair = lambda a, b: F.xxhash64(a, b)
    # what has no third word gets a null hash and is cut off
    windows = lambda h: F.slice(F.zip_with(F.zip_with(h, after(h, 1), pair), after(h, 2), pair), F.lit(1), F.size(h) - 2)
    hashes = F.transform(tokens, lambda x: F.xxhash64(x))
    return F.when(F.size(tokens) < 4, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), _covered)))


def _times(text: Column, signs: str) -> Column:
    """How often any of some signs occurs."""
    return F.regexp_count(text, F.lit(f"[{signs}]")).cast("long")


#: A figure's name, the figures that it is made of, and how; "text" is known from the start.
FIGURES: dict[str, tuple[tuple[str, ...], Callable[[Known], Column]]] = {
    "words": (("text",), lambda k: words(k["text"])),
    "n_words": (("words",), lambda k: F.size(k["words"]).cast("long")),
    "word_chars": (("words",), lambda k: F.length(F.array_join(k["words"], "")).cast("long")),
    "n_symbols": (("text",), lambda k: _times(k["text"], SYMBOLS)),
    "n_capitals": (("text",), lambda k: _times(k["text"], "A-Z")),
    "n_exclamations": (("text",), lambda k: _times(k["text"], "!")),
    "lines": (("text",), lambda k: filled_lines(k["text"])),
    "n_lines": (("lines",), lambda k: F.size(k["lines"]).cast("long")),
    "n_dup_lines": (("lines",), lambda k: (F.size(k["lines"]) - F.size(F.array_distinct(k["lines"]))).cast("long")),
    "n_repeat_words": (("words",), lambda k: n_repeat_words(k["words"])),
}


class Rule(NamedTuple):
    """The figures that a rule looks at, and the test that rejects."""

    needs: tuple[str, ...]
    test: Callable[[Known], Column]


#: What rejects a text, from cheap to costly as a first guess.
RULES: dict[str, Rule] = {
    "few_words": Rule(("n_words",), lambda k: k["n_words"] < MIN_WORDS),
    "symbols": Rule(("n_symbols", "n_words"), lambda k: 5 * k["n_symbols"] > k["n_words"]),
    "exclamations": Rule(("n_exclamations", "n_words"), lambda k: 4 * k["n_exclamations"] > k["n_words"]),
    "capitals": Rule(("n_capitals", "word_chars"), lambda k: 10 * k["n_capitals"] > 3 * k["word_chars"]),
    "word_length": Rule(("word_chars", "n_words"), lambda k: (k["word_chars"] < 2 * k["n_words"]) | (k["word_chars"] > 30 * k["n_words"])),
    "dup_lines": Rule(("n_dup_lines", "n_lines"), lambda k: 100 * k["n_dup_lines"] > 40 * k["n_lines"]),
    "repetition": Rule(("n_repeat_words", "n_words"), lambda k: 100 * k["n_repeat_words"] > 50 * k["n_words"]),
}


def _missing(needs: Iterable[str], known: Iterable[str]) -> list[str]:
    """The figures to compute before `needs` are known, in order."""
    out: list[str] = []
    for name in needs:
        if name not in known and name not in out:
            out += [x for x in _missing(FIGURES[name][0], [*known, *out])] + [name]
    return out


def with_figures(needs: Iterable[str], known: Known, body: Callable[[Known], Column]) -> Column:
    """body of the needed figures, each computed once unless it is known."""
    todo = _missing(needs, known)
    if not todo:
        return body(known)
    return let(FIGURES[todo[0]][1](known), lambda v: with_figures(todo[1:], {**known, todo[0]: v}, body))


def rejects(order: list[str], rules: dict[str, Rule], known: Known) -> Column:
    """Whether one of the rules, tried in this order, rejects a text; what comes after the first that does is not computed."""
    if not order:
        return F.lit(False)
    rule = rules[order[0]]
    return with_figures(rule.needs, known, lambda k: F.when(rule.test(k), F.lit(True)).otherwise(rejects(order[1:], rules, k)))


def best_order(rules: dict[str, Rule], cost: Mapping[str, float], patterns: list[tuple[tuple[bool, ...], int]]) -> list[str]:
    """Rules by rejections among the rows still alive per cost of the figures still unknown; ties keep the given order.

    cost: seconds of each figure beyond those it is made of. patterns: which rules, as given, reject, and of how many rows.
    """
    names, known, out = list(rules), {"text"}, []
    while len(out) < len(names):

        def worth(name: str) -> tuple[float, float]:
            price = 1e-9 + sum(cost[x] for x in _missing(rules[name].needs, known))
            return sum(n for hit, n in patterns if hit[names.index(name)]) / price, -price

        best = max((x for x in names if x not in out), key=worth)
        out.append(best)
        known |= set(_missing(rules[best].needs, known))
        patterns = [(hit, n) for hit, n in patterns if not hit[names.index(best)]]
    return out


def _sampled(docs: DataFrame, rows: int) -> C.Cut:
    """About `rows` texts, each drawn by itself in its own partition: no row is moved, however many partitions there are."""
    total = docs.count()
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return C.Cut(text.filter(F.rand(7) < min(1.0, rows / max(1, total))), "rules")


def order_rules(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in the order in which a cascade tries them, as measured on a sample."""
    rules = RULES if rules is None else rules
    sample = _sampled(docs, sample_rows)
    rows, known = sample.df.coalesce(1), {"text": F.col("text")}

    def seconds(value: Column) -> float:
        def once() -> float:
            began = time.perf_counter()
            rows.agg(F.max(F.xxhash64(value))).first()
            return time.perf_counter() - began

        return min(once() for _ in range(RUNS))

    every = _missing([x for rule in rules.values() for x in rule.needs], known)
    idle = seconds(F.lit(0))
    whole = {x: max(0.0, seconds(with_figures([x], known, lambda k, x=x: k[x])) - idle) for x in every}
    # in steps of two and from a millisecond on, so that what a run's chance decides does not decide the order
    cost = {x: 2.0 ** round(math.log2(max(1e-3, whole[x] - sum(whole.get(y, 0.0) for y in FIGURES[x][0])))) for x in every}
    tests = F.array(*[F.coalesce(with_figures(r.needs, known, r.test), F.lit(False)) for r in rules.values()])
    patterns = [(tuple(x["hits"]), x["n"]) for x in rows.groupBy(tests.alias("hits")).agg(F.count("*").alias("n")).collect()]
    sample.drop()
    return best_order(rules, cost, patterns)


_REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs: doc_id, the figures, base_failed, kept.

    The figures are columns of the result, so all rows have them; the cascade computes the others only where they decide.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = (*_REPORTED, "n_lines")
    figures = with_figures(own, {"text": F.col("text")}, lambda k: F.struct(*[k[x].alias(x) for x in own]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", figures.alias("s"))
    known = {"text": F.col("text")} | {x: F.col(f"s.{x}") for x in own}
    failed = RULES["few_words"].test(known) | RULES["repetition"].test(known)
    rest = [x for x in order_rules(docs) if x not in ("few_words", "repetition")]
    kept = F.when(failed, F.lit(False)).otherwise(~rejects(rest, RULES, known))
    return rows.select("doc_id", *[F.col(f"s.{x}") for x in _REPORTED], failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects; tests run in the measured order, and none after the first that rejects."""
    rules = RULES if rules is None else rules
    known = {"text": F.coalesce(F.col("text").cast("string"), F.lit(""))}
    return docs.filter(~rejects(order_rules(docs, rules), rules, known))
