"""Line deduplication by a log-template tree, in DataFrame functions only.

A line's tokens are its words; a token with a digit becomes a wildcard. The tree has a fixed depth: token count, then the DEPTH leading
tokens, which lead to a leaf. In a leaf, lines with the same masked tokens are one template. A leaf's templates of MIN_TOKENS tokens or
more form groups, as many as there are: two templates are alike if they have the same token in SIMILAR of their places or more, and
the places in which the templates of a group differ are its variable fields.

Alike templates of n tokens differ in d = n - ceil(SIMILAR n) places at most, so of d + 1 bands (places with the same remainder by
d + 1) they share one in full. In each band, templates with the same tokens there are compared with the least of them (by hash); where
they do not all come together by that, alike ones that are still apart are found by their rarest tokens (`_rest`). The groups are the
connected components over all alike pairs, so a group may chain.

A template recurs if it occurs in two documents or more and has MIN_TOKENS tokens, or if its group occurs in two or more, or if it is of
any length and occurs COMMON times over two documents or more. Of a recurring template or group the first line stays (smallest doc_id,
then line) and all others are dropped.

Counts are aggregated in part before each shuffle; lines meet their template's decision by a join that adaptive execution may split.
Null text has no lines and stays null; empty lines never count. Repeated rows (same doc_id and text) are one document and fare alike;
rows of one doc_id with other texts are other documents. Null doc_id: a document that comes first. A document that loses its last word
is dropped with it, and with min_words one that lost lines and keeps fewer words. Empty table: no rows. All columns are kept, whatever
their names; n_chars, where there is one, follows the text. Very long texts and lines are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import connected_components

DEPTH = 3
MIN_TOKENS = 8
COMMON = 20
#: Alike: differing places are at most this many percent.
OTHER_PERCENT = 20
#: Pairs a row up to which templates that share a token are compared at once; rows of one side of a block; bits kept of a token's hash.
PAIRS_A_ROW = 16
BLOCK_ROWS = 4096
BITS = (0, 8, 16, 24)

_DIGIT_TOKEN = rf"(?<![^{C.SPACE}])[^{C.SPACE}0-9]*+[0-9][^{C.SPACE}]*"
_OTHER_SPACE = "\t\x0b\x0c\r"


def tokens_of(line: Column) -> Column:
    """The words of a line, those with a digit as wildcards."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _DIGIT_TOKEN, "<*>")).otherwise(line)
    odd = F.contains(line, F.lit(_OTHER_SPACE[0]))
    for sign in _OTHER_SPACE[1:]:
        odd = odd | F.contains(line, F.lit(sign))
    return F.array_remove(F.split(F.when(odd, F.translate(masked, _OTHER_SPACE, "    ")).otherwise(masked), " "), "")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash that tells apart texts of one doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("doc", F.xxhash64("doc_id", "text"))


def template_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id and doc (its document), line, leaf, template (hash of its tokens), t (each token's hash; null under MIN_TOKENS)."""
    lines = _texts(docs).filter("text is not null").select("doc_id", "doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    tokens = lines.select("doc_id", "doc", "line", tokens_of(F.col("body")).alias("t")).filter(F.size("t") > 0)
    leaf = F.xxhash64(F.size("t"), *[F.get("t", F.lit(i)) for i in range(DEPTH)])
    hashed = F.when(F.size("t") >= MIN_TOKENS, F.transform("t", lambda x: F.hash(x)))
    return tokens.select("doc_id", "doc", "line", leaf.alias("leaf"), F.xxhash64(F.array_join("t", " ")).alias("template"), hashed.alias("t"))


def _bands(t: Column) -> Column:
    """(band, hash of the tokens in it): one more than the places in which alike templates may differ."""
    number = F.floor(F.size(t) * OTHER_PERCENT / 100).cast("int") + 1
    own = lambda b: F.transform(F.sequence(b, F.size(t) - 1, number), lambda i: F.get(t, i))
    return F.transform(F.sequence(F.lit(0), number - 1), lambda b: F.struct(b.alias("band"), F.xxhash64(own(b)).alias("part")))


def _alike(a: str, b: str) -> Column:
    other = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: ~same))
    return 100 * other <= OTHER_PERCENT * F.size(a)


def _confirmed(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of templates that are alike; own: template, t."""
    x, y = own.select(F.col("template").alias("a"), F.col("t").alias("x")), own.select(F.col("template").alias("b"), F.col("t").alias("y"))
    return pairs.join(x, "a").join(y, "b").filter(F.size("x") == F.size("y")).filter(_alike("x", "y")).select(*pairs.columns)


def _groups(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """(template, component) of templates that are alike another one of their leaf. A template's tokens decide its leaf."""
    full = templates.filter("full")
    many = full.groupBy("leaf").agg(F.count("*").alias("templates")).filter("templates > 1")
    own = C.cut(lines.filter("t is not null").join(many, "leaf").select("leaf", "template", "t").dropDuplicates(["leaf", "template"]), "templates")
    keys = C.cut(own.select("leaf", "template", F.explode(_bands(F.col("t"))).alias("b")).select("leaf", "b.band", "b.part", "template"), "keys")
    least = C.cut(keys.groupBy("leaf", "band", "part").agg(F.min("template").alias("least"), F.max("template").alias("most")).filter("least < most").select("leaf", "band", "part", "least"), "bands")
    shared = C.cut(keys.join(least, ["leaf", "band", "part"]).select("leaf", "band", "part", "template", "least"), "shared")
    pairs = shared.filter("template <> least").select(F.col("template").alias("a"), F.col("least").alias("b")).distinct()
    first = C.cut(connected_components(_confirmed(pairs, own), "groups"), "first")
    rest = _rest(shared, first, own)
    groups = first
    if rest is not None and rest.first() is not None:
        groups = connected_components(first.toDF("a", "b").unionByName(rest), "groups")
    return groups.select(F.col("node").alias("template"), "component")


def _rest(shared: DataFrame, groups: DataFrame, own: DataFrame) -> DataFrame | None:
    """Links (a, b) between groups, enough to bring all alike templates together; None: groups meet in no band, or in no token.

    Alike templates of different groups share a band in which groups meet. Of their tokens by place, put in one order (those that no
    other group has, then the rare ones first), they share one of the first d + 1. Where that leaves many pairs, links with one template
    of each such token come first, as often as they halve what is left; then each template outside a token's largest group is compared
    with all others there.
    """
    member = shared.join(groups.select(F.col("node").alias("template"), "component"), "template", "left").select("leaf", "band", "part", "template", F.coalesce("component", "template").alias("component"))
    several = member.groupBy("leaf", "band", "part").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("leaf", "band", "part")
    apart = C.cut(member.join(several, ["leaf", "band", "part"]).select("template", "component").distinct(), "apart")
    if apart.first() is None:
        return None
    front, found, before = C.cut(_fronts(apart.join(own, "template")), "fronts"), None, None
    while True:
        parts = front.groupBy("token", "component").agg(F.count("*").alias("n"))
        total = parts.groupBy("token").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main")).filter("parts > 1")
        total = C.cut(total.select("token", "n", F.col("main.component").alias("main"), (F.col("n") - F.col("main.n")).alias("few")), "tokens")
        left, size = total.agg(F.sum(F.col("n").cast("double") * F.col("few")), F.sum("n")).first()
        if left is None:
            return found
        whole = left <= PAIRS_A_ROW * size or (before is not None and 2 * left > before)
        links = C.cut(_confirmed(_pairs(front, total) if whole else _stars(front, total), own).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "rest")
        found = links if found is None else found.unionByName(links)
        if whole:
            return found
        now = C.cut(connected_components(links, "groups"), "labels").select(F.col("node").alias("component"), F.col("component").alias("label"))
        front = C.cut(front.join(now, "component", "left").withColumn("component", F.coalesce("label", "component")).drop("label"), "fronts")
        before = left


def _fronts(apart: DataFrame) -> DataFrame:
    """token (a leaf's, by place), template, component, other (places that may differ), bits: the first other + 1 tokens of each template."""
    bits = lambda k: F.expr(f"aggregate(transform(slice(t, {DEPTH + 1}, 64), (x, i) -> shiftleft(cast(shiftright(x, {k}) & 1 as bigint), i)), 0L, (a, b) -> a | b)")
    texts = C.cut(apart.select("leaf", "template", "component", F.floor(F.size("t") * OTHER_PERCENT / 100).cast("int").alias("other"), (F.size("t") - DEPTH).alias("n"), *[bits(k).alias(f"bits{k}") for k in BITS], "t"), "texts")
    # the leading tokens are the leaf's
    held = texts.select("leaf", "template", "component", F.posexplode(F.slice("t", DEPTH + 1, F.col("n"))).alias("at", "x")).select("template", "component", F.xxhash64("leaf", "at", "x").alias("token"))
    crossing = held.groupBy("token").agg(F.count("*").alias("f"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token", "f")
    order = held.join(C.cut(crossing, "crossing"), "token").groupBy("template").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("c"))
    few = F.greatest(F.lit(0), F.col("other") + 1 - (F.col("n") - F.size("c")))
    return texts.drop("t").join(order, "template").select("template", "component", "other", *[f"bits{k}" for k in BITS], F.explode(F.slice("c", F.lit(1), few)).alias("c")).withColumn("token", F.col("c.token")).drop("c")


def _may_be_alike() -> Column:
    """Tokens differ where bits of their hashes do; in the first 64 places after the leading ones."""
    differ = F.lit(0).cast("long")
    for k in BITS:
        differ = differ.bitwiseOR(F.col(f"x.bits{k}").bitwiseXOR(F.col(f"y.bits{k}")))
    return (F.col("x.component") != F.col("y.component")) & (F.bit_count(differ) <= F.col("x.other"))


_LINK = ("x.template as a", "y.template as b", "x.component as ca", "y.component as cb")


def _stars(front: DataFrame, total: DataFrame) -> DataFrame:
    """Pairs (a, b, ca, cb) of each token's other templates with one outside its largest group."""
    meeting = front.join(total, "token")
    one = C.cut(meeting.filter("component <> main").groupBy("token").agg(F.min_by(F.struct(*[c for c in front.columns if c != "token"]), F.xxhash64("template", "component")).alias("x")), "stars")
    every = front.select("token", F.struct(*[c for c in front.columns if c != "token"]).alias("y"))
    return every.join(one, "token").filter(_may_be_alike()).selectExpr(*_LINK).distinct()


def _pairs(front: DataFrame, total: DataFrame) -> DataFrame:
    """Pairs (a, b, ca, cb) of each token's templates outside its largest group with all others, in blocks."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    meeting = front.join(total, "token").select("token", F.struct(*[c for c in front.columns if c != "token"]).alias("x"), "main", blocks("n").alias("all_blocks"), blocks("few").alias("few_blocks"), F.xxhash64("template").alias("spread"))
    dealt = lambda n: F.pmod("spread", n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = meeting.filter("x.component <> main").select("token", "x", dealt("few_blocks").alias("i"), each("all_blocks").alias("j"))
    every = meeting.select("token", F.col("x").alias("y"), (F.col("x.component") == F.col("main")).alias("largest"), each("few_blocks").alias("i"), dealt("all_blocks").alias("j"))
    once = F.col("largest") | (F.col("x.template") < F.col("y.template"))
    return few.join(every, ["token", "i", "j"]).filter(once & _may_be_alike()).selectExpr(*_LINK).distinct()


def _recurring(lines: DataFrame) -> DataFrame:
    """(leaf, template) of the templates that recur, with the one line that stays."""
    place = F.struct("doc_id", "doc", "line")
    # min and max of one document's lines are lines of that document
    two = ~(F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("first.doc") == F.col("last.doc")))
    templates = C.cut(lines.groupBy("leaf", "template").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("times"), F.max(F.col("t").isNotNull()).alias("full")), "counts")
    exact = templates.filter(two & (F.col("full") | (F.col("times") >= COMMON))).select("leaf", "template", "first", F.lit(0).alias("general"))
    member = templates.join(_groups(lines, templates), "template")
    group = member.groupBy("component").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter(two).select("component", "first")
    general = member.select("leaf", "template", "component").join(group, "component").select("leaf", "template", "first", F.lit(1).alias("general"))
    # written, so that the join with the lines meets a plain shuffle, which adaptive execution may split at hot templates
    return C.cut(exact.unionByName(general).groupBy("leaf", "template").agg(F.max_by("first", "general").alias("first")), "recurring")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, drop): for each document that loses lines, their numbers from 0. Written; what it was made from is deleted."""
    with C.Scope() as scope:
        lines = C.cut(template_lines(docs), "lines")
        stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.doc") == F.col("doc")) & (F.col("first.line") == F.col("line"))
        gone = lines.select("doc_id", "doc", "line", "leaf", "template").join(_recurring(lines), ["leaf", "template"]).filter(~stays)
        return scope.kept(gone.groupBy("doc_id", "doc").agg(F.collect_set("line").alias("drop")), "dropped")


def _joined(docs: DataFrame) -> DataFrame:
    """row, drop (null: none), new text."""
    text = F.col("row.text").cast("string")
    own = C.packed(docs).select("row", F.col("row.doc_id").cast("long").alias("id")).withColumn("key", F.xxhash64("id", text))
    drop = dropped_lines(docs)
    new = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("drop", i)), "\n")
    joined = own.join(drop, (F.col("key") == F.col("doc")) & F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return joined.select("row", "drop", F.when(F.col("drop").isNull(), text).otherwise(new).alias("new"))


def deduplicate_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """The documents without their recurring lines; those that lost lines and keep fewer than min_words words are dropped."""
    words = F.regexp_count("new", F.lit(C.WORD))
    kept = _joined(docs).filter(F.col("drop").isNull() | (words >= min_words))
    row = F.when(F.col("drop").isNull(), F.col("row")).otherwise(F.col("row").withField("text", F.col("new")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = F.when(F.col("drop").isNull(), F.col("row")).otherwise(F.col("row").withField("text", F.col("new")).withField("n_chars", F.length("new").cast(kind)))
    return C.unpacked(kept.select(row.alias("row")))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, dropped (line numbers), kept_sha256 of the remaining text."""
    lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(F.split("row.text", "\n", -1)))
    dropped = F.coalesce(F.array_join(F.transform(F.sort_array("drop"), lambda x: x.cast("string")), ","), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _joined(rows).select("row.doc_id", lines.cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"), dropped.alias("dropped"), F.sha2(F.coalesce("new", F.lit("")), 256).alias("kept_sha256"))
