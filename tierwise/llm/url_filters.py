"""URL filters: hash-prefix lookup of host-suffix and path-prefix expressions.

A rule is a host, a path and a verdict. Each distinct (host, path) of the table is expanded into the
expressions that could be rules: host suffixes at label boundaries times path prefixes of the lengths that
rules have (a set no larger than the longest rule path, read once from the rules). Expressions meet rules on the first bytes of their SHA-256 only; the full
digest confirms, and the longest confirmed rule decides. All of it is DataFrame code.

Null URLs and URLs without ``://`` have empty host and path, fit no rule and get the default verdict.
Repeated rows get equal results. Rules are unique by (host, path); of two rules of equal length that
both fit, the one with the longer host wins. Hosts of rules are lower-cased (A-Z); a rule with a null host or path fits
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]; an empty host has none."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The prefixes of the given lengths that the path has."""
    return F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def url_filters(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: id, host, path, rule (host and path as one string, null if none fits), verdict.

    ``rules`` has columns host, path, verdict. Only the distinct (host, path) pairs are expanded; Spark broadcasts
    either side of a join only if it measures it below its own threshold.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host is not null and path is not null")
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    listed = rules.select(
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("full"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_len"),
        F.col("verdict").alias("said"),
    ).withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    # dealt by number, as little that comes in becomes much
    keys = rows.select("host", "path").filter("host <> ''").repartition(tasks, "host", "path").distinct()
    expanded = (
        keys.withColumn("h", F.explode(host_suffixes(F.col("host"))))
        .withColumn("p", F.explode(path_prefixes(F.col("path"), lengths)))
        .select("host", "path", digest(F.col("h"), F.col("p")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    best = (
        expanded.join(listed, "prefix")
        .filter("digest = full")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule", "said")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.said").alias("said"))
    )
    return rows.join(best, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
