"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Sources share a budget of words by weight, no source more than a multiple of its size. Each source's target is cut
into blocks of equally many words, and its shards win the blocks by highest quotients (share divided by the odd
numbers). Inside a shard the documents lie in a seeded order as one stream of words; the shard's quota takes blocks
from its start, and from its start again once all is taken.

By default a source gets its target rounded to blocks. With ``whole`` the sources win their blocks by highest quotients
of their targets too, and what blocks leave, or limits keep from a shard, is dealt word by word over the shards of the
source, so each takes its target to the word, however small.

The number of shards follows the square root of the number of documents, so the shards of a source and the documents
of a shard are both small against the table at any size, whatever a source holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoscreen.llm.common import stage

WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, source and the number of words between ASCII blanks of each row (null text: 0), and a key to draw by.

    The key is the id. With ``whole`` rows without an id have the digest of their text instead, so that they don't
    all draw the same.
    """
    runs = F.size(F.split("text", r"[\x20\x09-\x0D]+", -1))
    ends = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(F.col("text").rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    size = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.greatest(runs - ends, F.lit(0)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))) if whole else F.lit(""))
    base = docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string"))
    return base.select("doc_id", "source", size.cast("long").alias("size"), key.alias("key"))


def targets(rows: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, source_docs and target of each source.

    Resharing the excess until no target is above its limit ends where every open source has the same words for a
    weight unit. Sources close in the order of limit by weight, so a running sum over that order finds the level.
    Both windows see one row for each source.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights)).cast("int") + 1).cast("long")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    level = (F.lit(share) * F.col("total") - F.col("closed")) / F.col("open")
    return (
        by.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("closed", F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.when(level * F.col("weight") < most * F.col("source_size"), level))
        .withColumn("level", F.max("level").over(every))
        .withColumn("limit", (most * F.col("source_size")).cast("double"))
        .withColumn("target", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), "limit"))
        .select("source", "source_size", "source_docs", "target")
    )


def apportion(parties: DataFrame, group: list[str], seats: str, votes: str, order: list[str]) -> DataFrame:
    """``parties`` and won: seats of each by highest quotients votes / (2 k + 1) in its group.

    A party's seats differ from its exact share by at most half a seat and share * parties / (2 * seats), so only
    the quotients in that range are ranked; those below it are won.
    """
    every = Window.partitionBy(*group)
    exact = F.col(seats) * F.col(votes) / F.col("__votes")
    slack = exact * F.col("__parties") / (2 * F.col(seats)) + 1
    ranked = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("__k") + 1)).desc(), *order, F.col("__k"))
    ranged = (
        parties.withColumn("__votes", F.sum(votes).over(every))
        .withColumn("__parties", F.count(F.lit(1)).over(every))
        .withColumn("__exact", F.when((F.col("__votes") > 0) & (F.col(seats) > 0), exact).otherwise(0.0))
        .withColumn("__slack", F.when((F.col("__votes") > 0) & (F.col(seats) > 0), slack).otherwise(0.0))
        .withColumn("__low", F.greatest(F.floor(F.col("__exact") - F.col("__slack")), F.lit(0)))
        .withColumn("__high", F.ceil(F.col("__exact") + F.col("__slack")))
        .withColumn("__left", F.when(F.col("__votes") > 0, F.col(seats)).otherwise(0) - F.sum("__low").over(every))
    )
    taken = F.sum(F.when(F.col("__k").isNotNull() & (F.col("__rank") <= F.col("__left")), 1).otherwise(0))
    return (
        ranged.withColumn("__k", F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low"), F.col("__high") - 1))))
        .withColumn("__rank", F.row_number().over(ranked))
        .groupBy(*parties.columns, "__low")
        .agg(taken.alias("__more"))
        .select(*parties.columns, (F.col("__low") + F.col("__more")).alias("won"))
    )


def _to_the_word(quotas: DataFrame) -> DataFrame:
    """Quotas of a source's shards, made up to or cut down to its rounded target along the shards."""
    every = Window.partitionBy("q_source")
    before = every.orderBy("q_shard").rowsBetween(Window.unboundedPreceding, -1)
    left = F.round("target").cast("long") - F.sum("quota").over(every)
    room = F.when(left > 0, F.col("limit") - F.col("quota")).otherwise(F.col("quota"))
    moved = F.least("room", F.greatest(F.abs("left") - F.coalesce(F.sum("room").over(before), F.lit(0)), F.lit(0)))
    filled = quotas.withColumn("left", left).withColumn("room", room).withColumn("moved", moved)
    return filled.withColumn("quota", F.col("quota") + F.signum("left").cast("long") * F.col("moved")).drop("left", "room", "moved")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, block: int = 64, seed: int = 7, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source).

    Null sources are a source of their own, the last; null and empty texts have size 0 and nothing is taken of them.
    Rows that repeat an id are taken apart; equal rows may swap their parts. An empty table gives an empty result,
    other columns are ignored. Each source takes its target to within half a block and what blocks leave at a limit, or with
    ``whole`` to the word. Copies of a row without an id stay in one shard.
    """
    rows = stage(sizes(docs, whole), "sizes")
    goals = targets(rows, share, most)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("long")
    total = F.broadcast(rows.agg(F.ceil(F.sqrt(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double"))).alias("width")))
    goals = goals.join(total).withColumn("shards", F.ceil(F.col("source_docs") / F.col("width")))
    if whole:
        # one group: a row for each source, like the windows of ``targets``
        goals = goals.withColumn("all", F.lit(1)).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
        goals = apportion(goals, ["all"], "blocks", "target", ["source"]).withColumnRenamed("won", "seats")
    else:
        goals = goals.withColumn("seats", F.round(F.col("target") / block).cast("long"))
    goals = stage(goals, "goals")
    dealt = rows.join(goals, rows["source"].eqNullSafe(goals["source"])).select(
        "doc_id", goals["source"], "size", "source_size", "target", "shards", "seats", draw.alias("draw")
    )
    dealt = stage(dealt.withColumn("shard", F.col("draw") % F.col("shards")), "dealt")
    shards = dealt.groupBy("source", "shard", "source_size", "target", "seats").agg(F.sum("size").alias("shard_size"))
    won = apportion(shards, ["source"], "seats", "shard_size", ["shard"])
    limit = most * F.col("shard_size")
    quota = won.select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", F.col("target").alias("q_target"),
        limit.alias("limit"), F.least(F.col("won") * block, limit).alias("quota"),
    )
    quota = _to_the_word(quota.withColumnRenamed("q_target", "target")).drop("target", "limit") if whole else quota.drop("q_target", "limit")
    stream = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("end") - F.col("size")
    passes = sum(
        (F.greatest(F.least("end", F.col("quota") - i * F.col("shard_size")) - begin, F.lit(0)) for i in range(most)),
        F.lit(0),
    )
    joined = placed.join(quota, placed["source"].eqNullSafe(F.col("q_source")) & (placed["shard"] == F.col("q_shard")))
    return joined.select("doc_id", "source", "size", "source_size", "target", passes.cast("long").alias("taken"))
