"""File names as tokens: episodes, similarity, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_EPISODE = "^ep?([0-9]{1,4})$"
_DATE = "^([0-9]{6}|[0-9]{8})$"
# Least shares of stable tokens in common, with and without a leading title token.
LEADING_SHARE, SHARE = 0.40, 0.75


def dot_tokens(stem: Column) -> Column:
    return F.filter(F.transform(F.split(stem, r"\."), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def episode_at(tokens: Column) -> Column:
    """The place of the first episode token, from 0; null without one."""
    return F.get(F.filter(F.transform(tokens, lambda x, i: F.when(x.rlike(_EPISODE), i)), lambda i: i.isNotNull()), F.lit(0))


def episode(tokens: Column) -> Column:
    return F.regexp_extract(F.get(tokens, episode_at(tokens)), _EPISODE, 1).cast("int")


def stable_tokens(tokens: Column) -> Column:
    """All but the episode token and dates."""
    at = episode_at(tokens)
    return F.filter(tokens, lambda x, i: ~x.rlike(_DATE) & ~F.coalesce(i == at, F.lit(False)))


def common_tokens(a: Column, b: Column) -> Column:
    """Tokens in common, each as often as both have it."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0).cast("long"), lambda s, x: s + F.least(count(a, x), count(b, x)))


def leading_tokens(a: Column, b: Column) -> Column:
    """Tokens at the start that are equal, place by place."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("long")


def similarity(a: Column, b: Column, same_extension: Column) -> Column:
    """Score of two parsed files (tokens and stable tokens); null without a title token in common, or too few stable ones.

    With a leading title token in common, two stable tokens (or all, if fewer) and a share of 0.40; without, three and 0.75.
    """
    title = lambda f: F.slice(f["tokens"], 1, episode_at(f["tokens"]))
    leading, named = leading_tokens(title(a), title(b)), common_tokens(title(a), title(b))
    own, other = F.size(a["stable"]), F.size(b["stable"])
    common = common_tokens(a["stable"], b["stable"])
    share = F.coalesce(F.try_divide(common, F.greatest(own, other)), F.lit(0.0))
    enough = F.when(leading > 0, (common >= F.least(F.lit(2), own)) & (share >= LEADING_SHARE)).otherwise((common >= 3) & (share >= SHARE))
    # The weights of the score.
    score = leading * 10000 + F.round(share * 1000).cast("long") + common * 100 - F.abs(own - other) * 10 + F.when(same_extension, 5).otherwise(0)
    return F.when((own > 0) & (other > 0) & (named > 0) & enough, score)


def next_episodes(files: DataFrame) -> DataFrame:
    """(path, next_path): the best scored file of the same folder with the next episode number; of equals the first path. files: path."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parsed = files.select("path", F.regexp_replace("path", r"[^/\\]*$", "").alias("dir"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), dot_tokens(stem).alias("tokens"))
    parsed = parsed.withColumn("episode", episode(F.col("tokens"))).filter("episode is not null").select("path", "dir", "ext", "episode", F.struct("tokens", stable_tokens(F.col("tokens")).alias("stable")).alias("f"))
    other = parsed.select("dir", (F.col("episode") - 1).alias("episode"), F.col("path").alias("next_path"), F.col("ext").alias("ext2"), F.col("f").alias("g"))
    scored = parsed.join(other, ["dir", "episode"]).withColumn("score", similarity(F.col("f"), F.col("g"), F.col("ext") == F.col("ext2"))).filter("score >= 0")
    best = F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), F.lower("next_path"), "next_path"))
    return scored.withColumn("n", best).filter("n = 1").select("path", "next_path")


def sidecars(videos: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """(path, sidecar): of each video the first candidate, in the order of suffixes, that exists. Both: path."""
    stem = F.regexp_replace("path", r"\.[^./\\]*$", "")
    wanted = videos.select("path", F.posexplode(F.array(*[F.concat(stem, F.lit(s)) for s in suffixes])).alias("priority", "candidate")).withColumn("key", F.lower("candidate"))
    found = wanted.join(files.select(F.lower("path").alias("key"), F.col("path").alias("sidecar")), "key")
    return found.groupBy("path").agg(F.min(F.struct("priority", "sidecar")).alias("m")).select("path", "m.sidecar")
