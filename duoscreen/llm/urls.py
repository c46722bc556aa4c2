"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

Each distinct URL yields the expressions suffix/prefix that a rule could have: host suffixes at label borders, path
prefixes at slashes, the whole path, and prefixes of the lengths of rules that end elsewhere; none is longer than
the longest rule. Expressions and rules meet by an equi join on the first digits of their digest; the full digest
confirms, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hex digits of the digest that rules and expressions are joined on.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """A-Z lower-cased text after the first :// up to a slash, question mark, hash or the end; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict.

    pages: a column ``url``. rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if
    the path starts with the rule's. The longest fitting rule decides, of equally long ones that with the longer
    host, then block before allow. Without a rule the verdict is ``default``. A null url, or one without ://, has
    empty host and path. Columns of these names in ``pages`` are replaced; repeated rows stay.
    """
    known = rules.select("host", "path", "verdict", F.concat("host", "path").alias("rule")).withColumn("digest", _digest(F.col("rule")))
    known = known.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    open_end = F.when(~F.col("path").endswith("/"), F.length("path"))
    bounds = rules.agg(F.max(F.length("host")), F.max(F.length("path")), F.array_sort(F.collect_set(open_end))).first()
    longest_host, longest_path, lengths = bounds[0] or 0, bounds[1] or 0, bounds[2]

    urls = pages.select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    tail = F.expr(f"right(host, {longest_host + 1})")
    labels = F.split(tail, r"\.", -1)
    whole = F.length("host") <= longest_host
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    head = F.substring("path", 1, longest_path)
    parts = F.split(head, "/", -1)
    slashes = F.when(
        F.size("parts") > 1,
        F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.concat(F.array_join(F.slice("parts", 1, i), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    others = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>")
    prefixes = F.array_distinct(F.array_compact(F.concat(slashes, others)))
    expressions = (
        urls.withColumns({"labels": labels, "parts": parts})
        .withColumn("suffix", F.explode(F.when(whole, suffixes).otherwise(F.slice(suffixes, 2, F.size("labels") + 1))))
        .withColumn("prefix", F.explode(prefixes))
        .select("url", F.concat("suffix", "prefix").alias("expression"))
        .withColumn("digest", _digest(F.col("expression")))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    same = (expressions["short"] == known["short"]) & (expressions["digest"] == known["digest"])
    order = F.struct(F.length("rule"), F.length("host"), F.col("verdict") == "block", F.col("rule"), F.col("verdict"))
    decided = (
        expressions.join(known, same)
        .select("url", order.alias("o"))
        .groupBy("url")
        .agg(F.max("o").alias("o"))
        .select(F.col("url").alias("__url"), F.col("o.rule").alias("__rule"), F.col("o.verdict").alias("__verdict"))
    )
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    joined = pages.select(*names).join(decided, pages["url"] == decided["__url"], "left")
    return joined.select(
        *names, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"),
    )
