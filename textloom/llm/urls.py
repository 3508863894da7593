"""URL rules by host-suffix and path-prefix expressions, hash-prefix join and digest confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, maybe_broadcast

#: Hex digits of the SHA-256 digest that serve as join key; the full digest is compared afterwards.
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """Text after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' without `://`."""
    at = F.instr(url, "://")
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substr(url, at + 3), "^([^/?#]*)", 1))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to `?`, `#` or the end; '' without `://`."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row of `pages`.

    `rules` has host, path and verdict. A rule fits its host and all subdomains when the URL's path
    starts with the rule's path; of the fitting rules the longest (host and path together) wins, then
    the longer host, then `block`. A URL that fits none gets a null rule and `default`.

    Each distinct (host, path) is expanded into host-suffix x path-prefix expressions, only with the
    label counts and path lengths that occur in the rules. They meet the rules in an equi-join on a
    short hash prefix, full digests then decide, and the best rule per (host, path) is found by a max that
    combines before the shuffle. Rules are broadcast only if measured small.

    A null URL or one without `://` has empty host and path and fits no rule that names a host; empty
    `pages` or `rules` give no rules matched; repeated rows and ids stay repeated; columns of `pages`
    named host, path, rule or verdict are replaced."""
    rules = checkpointed(rules.where("host is not null and path is not null and verdict is not null").select(
        ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ))
    shape = rules.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")
    ).first()
    digests = rules.select("*", F.concat("r_host", "r_path").alias("r_rule"), F.sha2(F.concat("r_host", "r_path"), 256).alias("r_digest"))
    digests = digests.withColumn("r_key", F.substring("r_digest", 1, PREFIX_HEX))
    base = pages.drop("host", "path", "rule", "verdict")
    # the columns of pages stay inside a struct, so that none clashes with a helper
    held = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))

    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffix = lambda k: F.when(n >= k, F.array_join(F.slice(labels, n - (k - 1), F.lit(k)), "."))
    prefix = lambda k: F.when(F.length("path") >= k, F.substring("path", 1, k))
    some = lambda f, ks: F.filter(F.array(*[f(k) for k in sorted(ks)]).cast("array<string>"), lambda x: x.isNotNull())
    asked = held.select("host", "path").where("host <> ''").distinct()
    expanded = (
        asked.select("host", "path", F.explode(some(suffix, shape["labels"])).alias("s"), some(prefix, shape["lengths"]).alias("ps"))
        .select("host", "path", F.explode("ps").alias("p"), "s")
        .select("host", "path", F.sha2(F.concat("s", "p"), 256).alias("digest"))
        .withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    )
    hits = expanded.join(maybe_broadcast(digests), F.col("key") == F.col("r_key"))  # the short prefix finds, the digest decides
    confirmed = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("digest") == F.col("r_digest"), F.struct(F.length("r_rule"), F.length("r_host"), F.col("r_verdict") == "block", "r_rule", "r_verdict"))).alias("best")
    )
    best = confirmed.where("best is not null").select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    joined = held.join(best, (F.when(F.col("host") != "", F.col("host")) == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in base.columns], "host", "path",
        F.col("best.r_rule").alias("rule"), F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
    )
