"""URL filters with redirect equivalence, in DataFrame functions only.

Rules name a host and a path; a rule fits its host and all subdomains where the url's path starts with the rule's, and the longest
fitting rule decides, of the same length an allowing one, then the last in order. Pages are aliases when they share an address: the url
without scheme, `www.`, fragment, tracking parameters and last slash; the target of a canonical link; the target of a refresh redirect,
both resolved against the page's base and url. Each address ties its pages to the smallest page_id, and connected components over these
ties spread decisions: a page without a rule is allowed if a page of its component, or an address that one of them links to, is allowed
by a rule, else blocked if one is blocked, else allowed. So a target decides even where no page of it is in the table. A page's own rule
always stands.

Up to INLINE_RULES rules are tests in the plan; beyond that, or where they come as a table, rules are joined by equality on the host's
suffixes and on path prefixes of the lengths that occur with that host, whatever their number.

Null urls, or ones without `://`: empty host and path, no rule, tied by their absolute links alone, allowed if nothing blocks them. Null
page_id: judged by rules alone. Pages that repeat a page_id: one node, blocked and allowed together. Very long urls and html are read
whole. Empty table: no rows. Only page_id, url and html are read, so names of other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import connected_components

#: (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Rules that are part of the plan; more are joined.
INLINE_RULES = 50
_TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(C.lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What urls of one page have in common; null without a host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    kept = F.array_join(F.filter(F.split(F.substring(query, 2, F.length(query)), "&"), lambda x: (x != "") & ~x.rlike(f"^{_TRACKING}(=|$)")), "&")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/$", ""), F.lit("?"), kept))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and the plan holding it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_dots(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != ".")
    plain = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(plain, "/")).otherwise(path)


def _resolved(target: Column, base: Column) -> Column:
    """A link's target as a url: relative ones against the base url; null for schemes without `://`, or without a host."""

    def relative(path: Column) -> Column:
        folder = F.when(path_of(base) == "", "/").otherwise(F.regexp_replace(path_of(base), r"[^/]*+$", ""))
        merged = F.when(path.startswith("/"), path).when(path == "", path_of(base)).otherwise(F.concat(folder, path))
        return F.when(host_of(base) != "", F.concat(F.lit("x://"), host_of(base), _let(merged, _without_dots), F.substring(target, F.length(path) + 1, F.length(target))))

    return (
        F.when(target == "", None).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+://"), target).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+:"), None)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target)).when(target.startswith("#"), base).otherwise(_let(F.regexp_extract(target, r"^([^?#]*)", 1), relative))
    )


def _first_tag(html: Column, name: str, needed: str) -> Column:
    """The first tag of a name that holds a pattern. What follows the last > is no tag; without it the search is linear."""
    closed = F.substring(html, F.lit(1), F.length(html) - F.length(F.substring_index(html, ">", -1)))
    return F.get(F.filter(F.regexp_extract_all(closed, F.lit(rf"(?i)<{name}\b[^>]*+>"), F.lit(0)), lambda x: x.rlike(f"(?i){needed}")), F.lit(0))


def _linked(html: Column, url: Column) -> Column:
    """(address, host, path) of what a page names as its own: the canonical link's target and the refresh redirect's."""
    value = r"\s*+=\s*+[\"']?"
    href, to = rf"(?i)\bhref{value}([^\"'\s>]+)", rf"(?i)\burl{value}([^\"'\s>]+)"
    link = F.regexp_extract(_first_tag(html, "link", rf"\brel{value}canonical\b"), href, 1)
    turn = F.regexp_extract(_first_tag(html, "meta", rf"\bhttp-equiv{value}refresh\b"), to, 1)
    own = F.regexp_extract(_first_tag(html, "base", rf"\bhref{value}"), href, 1)
    targets = F.filter(F.array(link, turn), lambda x: x != "")
    return F.transform(targets, lambda x: _let(_let(own, lambda b: F.coalesce(_resolved(b, url), url)), lambda b: _let(_resolved(x, b), lambda t: F.struct(address_of(t).alias("address"), host_of(t).alias("host"), path_of(t).alias("path")))))


_FIT = "struct<verdict:string,rule:string>"


def _longest(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits, as (verdict, rule), or null."""
    out = F.lit(None).cast(_FIT)
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[0] == "allow", x[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _joined(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, fit) of the distinct places that a rule fits. rules: verdict, rule."""
    own = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("own")).withColumn("start", F.expr("substring(rule, length(own) + 1)"))
    own = C.cut(own.groupBy("own", "start", "rule").agg(F.min("verdict").alias("verdict")).withColumn("n", F.length("start")), "rules")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wide = places.filter("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("own"))
    keyed = wide.join(own.select("own", "n").distinct(), "own").filter(F.length("path") >= F.col("n")).select("host", "path", "own", F.expr("substring(path, 1, n)").alias("start"))
    fit = F.max_by(F.struct("verdict", "rule"), F.struct(F.length("rule"), F.col("verdict") == "allow", "rule"))
    return keyed.join(own, ["own", "start"]).groupBy("host", "path").agg(fit.alias("fit"))


def _with_fit(rows: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """rows, which have host and path, with fit: (verdict, rule) or null."""
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        return rows.withColumn("fit", _longest(rules, F.col("host"), F.col("path")))
    table = rows.sparkSession.createDataFrame(rules, "verdict string, rule string") if isinstance(rules, list) else rules.select("verdict", "rule")
    return rows.join(_joined(rows, table), ["host", "path"], "left")


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict. rules: (verdict, host and path), as a list or a table of these names."""
    rules = RULES if rules is None else rules
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    targets = F.filter(F.coalesce(_linked(html, url), F.array()), lambda x: x["address"].isNotNull())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"), targets.alias("targets"))
    rows = C.cut(rows, "pages")
    judged = C.cut(_with_fit(rows.select("page_id", "host", "path"), rules), "judged")
    linked = rows.filter("page_id is not null").select("page_id", F.explode("targets").alias("t")).select("page_id", "t.*")
    keys = rows.filter("page_id is not null and address is not null").select("page_id", "address").unionByName(linked.select("page_id", "address")).distinct()
    first = keys.groupBy("address").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("address", "first")
    ties = keys.join(first, "address").filter("page_id <> first").select("page_id", "first")
    groups = connected_components(ties, "aliases").withColumnRenamed("node", "page_id")
    # a page without ties is its own component, so that no key gathers such pages
    decided = judged.filter("page_id is not null and fit is not null").select("page_id", "fit.verdict").unionByName(_with_fit(linked.select("page_id", "host", "path"), rules).filter("fit is not null").select("page_id", "fit.verdict"))
    component = F.coalesce("component", "page_id").alias("component")
    spread = decided.groupBy("page_id").agg(F.min("verdict").alias("verdict")).join(groups, "page_id", "left").groupBy(component).agg(F.min("verdict").alias("spread"))
    member = judged.join(groups, "page_id", "left").select("page_id", "host", "path", "fit", component)
    verdict = F.coalesce(F.col("fit.verdict"), "spread", F.lit("allow"))  # "allow" is the lesser of the two words, so it goes first
    return member.join(spread, "component", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
