"""URL filters by hashed host-suffix and path-prefix expressions (operator 11).

A rule is a host and the beginning of a path.  It fits a URL of that host or a subdomain whose
path begins so; of several that fit, the longest decides.  Each distinct pair of host and path
is expanded into the expressions (suffix of the host, beginning of the path) whose shape some
rule has.  Expressions and rules meet on the first digits of their SHA-256 digests; the full
digest confirms a meeting, and precedence is one maximum per pair.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lookups import join_by_key

ALLOW, BLOCK = "allow", "block"
#: Hexadecimal digits of a digest on which expressions and rules meet.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower-case ASCII, and path; both empty for null and for URLs without ``://``."""
    url = F.coalesce(url, F.lit(""))
    parts = r"://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, parts, 2)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path) as a table that Spark knows to be small."""
    rows = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("verdict", "host", "path"), rule))) for rule in rules]
    made = spark.range(1).select(F.inline(F.array(*rows))) if rows else None
    return spark.createDataFrame([], "verdict string, host string, path string") if made is None else made


def _digest(host: Column, path: Column) -> Column:
    # The length keeps (a, b/) and (ab, /) apart, whatever a host may hold.
    return F.sha2(F.concat_ws(":", F.octet_length(host), F.concat(host, path)), 256)


def _hashed(df: DataFrame, digits: int) -> DataFrame:
    """Add the short prefix of the column ``digest`` as a number."""
    return df.withColumn("short", F.conv(F.substring("digest", 1, digits), 16, 10).cast("long"))


def prepared(rules: DataFrame) -> DataFrame:
    """Rows (rule_host, rule_path, blocked) without repeats; where verdicts differ ``block`` holds.

    Rules without a host, and null ones, fit nothing and are left out; a null path is the empty one.
    """
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    return (rules.filter("host <> '' AND verdict IS NOT NULL")
            .groupBy(host.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
            .agg(F.max(F.col("verdict") == BLOCK).alias("blocked")))


def expressions(pairs: DataFrame, shapes: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows (host, path, digest) of every expression of a pair that has one of the shapes: labels
    of the host's end, and characters of the path's beginning."""
    made = []
    for labels, length in shapes:
        # substring_index with too few dots gives the whole host: such a host has no such end.
        has = (F.size(F.split("host", r"\.")) >= labels) & (F.char_length("path") >= length)
        made.append(F.when(has, _digest(F.substring_index("host", ".", -labels),
                                        F.substring("path", 1, length))))
    return (pairs.select("host", "path", F.explode(F.array(*made)).alias("digest"))
            .filter("digest IS NOT NULL"))


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url: str = "url", *,
          default: str = ALLOW, prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each row of ``pages``.

    ``rules`` has columns host, path and verdict (``allow`` or ``block``).  The rule with the most
    characters decides; of equally long ones that with the longer host.  Where none fits, rule is
    null and the verdict is ``default``.  Null URLs, URLs without ``://`` and hosts without
    characters fit no rule.  Rows are never merged: repeated rows and ids each get their own, and
    other columns of the input are not looked at.  URLs of any length are used whole.

    The shapes of the rules, at most as many as there are rules, are all that the driver reads.
    """
    rules = prepared(rules)
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    shapes = sorted((r[0], r[1]) for r in rules.select(
        F.size(F.split("rule_host", r"\.")), F.char_length("rule_path")).distinct().collect())
    # Distinct pairs first: a URL that many rows share is one row from here on.
    pairs = urls.filter("host <> ''").select("host", "path").distinct()
    wanted = _hashed(rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))), prefix_digits)
    if shapes:
        found = expressions(pairs, shapes)
    else:
        found = pairs.select("host", "path", F.lit("").alias("digest")).limit(0)
    met = join_by_key(_hashed(found, prefix_digits), wanted.withColumnRenamed("digest", "full"), "short")
    met = met.filter(F.col("digest") == F.col("full"))
    rule = F.concat("rule_host", "rule_path")
    best = (met.groupBy("host", "path").agg(F.max(F.struct(
        F.char_length(rule).alias("n"), F.char_length("rule_host").alias("n_host"), rule.alias("rule"), "blocked"))
        .alias("best"))
        .select(F.xxhash64("host", "path").alias("pair"), F.col("host").alias("_host"), F.col("path").alias("_path"),
                F.col("best.rule").alias("rule"), F.col("best.blocked").alias("blocked")))
    # URLs without a host meet nothing; a hash of the row spreads them.
    pair = F.when(F.col("host") == "", F.xxhash64("id", "path")).otherwise(F.xxhash64("host", "path"))
    keyed = urls.withColumn("pair", pair)
    # The second hash gives the join a shuffle of its own on both sides, so that a hot pair is split.
    spread = F.pmod(F.xxhash64(F.col("pair")), F.lit(1 << 20))
    out = keyed.withColumn("_b", spread).join(
        best.withColumnRenamed("pair", "_pair").withColumn("_c", F.pmod(F.xxhash64("_pair"), F.lit(1 << 20))),
        (F.col("pair") == F.col("_pair")) & (F.col("_b") == F.col("_c")) & (F.col("host") == F.col("_host"))
        & (F.col("path") == F.col("_path")), "left")
    return out.select(
        F.col("id").alias(id_column), "host", "path", "rule",
        F.when(F.col("rule").isNull(), default).when(F.col("blocked"), BLOCK).otherwise(ALLOW).alias("verdict"))
