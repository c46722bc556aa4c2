"""Quotation linking in conversations, in DataFrame operations only.

Lines that start with quote marks (``>``) are quotes of the level that the number of marks says; neighbouring lines
of one level are a passage. Passages and their single lines are normalised and hashed, and joined to the earliest
message of the conversation that says the same in its own words; being the earliest, an original is one row however
often it is repeated, and an aggregate with partial sums finds it. The passages of the lowest linked level name the
parent. Roots of reply chains come from pointer doubling over linked messages only, in as many rounds as the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscreen.llm.common import stage

MARKS = r"^((?:[ \t]*>)+)[ \t]?"

KEYS = ["conv_id", "turn", "role", "text"]


def _joined(content: str, by: str, between: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(by, content)))
    return F.array_join(F.transform(rows, lambda x: x[content]), between)


def normal(text: Column) -> Column:
    """Lower case, blanks as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, msg, line, level and content of each line of each distinct message."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1)).alias("line", "raw")
    rows = messages.select("conv_id", "turn", "msg", split)
    level = F.length(F.regexp_replace(F.regexp_extract("raw", MARKS, 1), "[^>]", ""))
    return rows.select("conv_id", "turn", "msg", "line", level.alias("level"), F.regexp_replace("raw", MARKS, "").alias("content"))


def passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, msg, run, level, content and n_lines of each run of lines of one level; empty lines end none."""
    order = Window.partitionBy("conv_id", "turn", "msg").orderBy("line")
    new = F.when(F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1)), 1).otherwise(0)
    return (
        rows.withColumn("new", new)
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("conv_id", "turn", "msg", "run", "level")
        .agg(_joined("content", "line", "\n").alias("content"))
    )


def keys(rows: DataFrame) -> DataFrame:
    """Each passage's hash (whole) and, where it has several parts, those of its lines and paragraphs."""
    parts = F.concat(F.array(F.col("content")), F.split("content", "\n"), F.split("content", r"\n[ \t]*\n"))
    texts = F.filter(F.array_distinct(F.transform(parts, normal)), lambda x: x != "")
    exploded = rows.withColumn("whole", normal(F.col("content"))).select(
        "conv_id", "turn", "msg", "run", "level", "whole", F.explode(texts).alias("part")
    )
    return exploded.select(
        "conv_id", "turn", "msg", "run", "level", (F.col("part") == F.col("whole")).alias("whole"), F.md5(F.col("part")).alias("hash")
    )


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, msg, run, level and original (a turn, null if none) of each quoted passage.

    A passage links by its whole text to the earliest earlier message; failing that, to the message that most of its
    lines link to, the latest of several.
    """
    hashed = stage(keys(rows), "quote_keys")
    first = hashed.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quoted = hashed.filter("level > 0")
    found = quoted.join(first, ["conv_id", "hash"], "left").withColumn("original", F.expr("CASE WHEN original < turn THEN original END"))
    passage = ["conv_id", "turn", "msg", "run", "level"]
    votes = found.groupBy(*passage, "original").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"))
    best = F.max(F.when(F.col("original").isNotNull(), F.struct(F.col("whole").cast("int"), "n", "original")))
    return votes.groupBy(*passage).agg(best.getField("original").alias("original"))


def roots(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """conv_id, turn, root and depth of each row of ``parents`` (conv_id, turn, parent); parents lie earlier."""
    now = stage(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "roots")
    for _ in range(rounds):
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        step = now.join(up, ["conv_id", "root"], "left")
        if not step.filter("higher is not null").take(1):
            return now
        now = stage(
            step.select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "roots",
        )
    raise RuntimeError(f"a reply chain is longer than 2 ** {rounds}")


def threads(messages: DataFrame) -> DataFrame:
    """Messages without their quotes, in reply order: by conversation, root of the reply chain and turn.

    messages: conv_id, turn, role, text. Result: conv_id, turn, role, text (own words), n_quotes, n_linked, max_level,
    parent_turn, root_turn and depth. A message without a linked quote is its own root at depth 0; as a parent lies
    earlier than its replies, the order puts every reply after what it answers. The parent is the latest original
    quoted at the lowest level that has one. A null text is empty; a message with a null conversation or turn links
    to nothing; rows that repeat all four columns count once; an empty table gives an empty result; other columns are
    ignored.
    """
    distinct = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).distinct()
    distinct = distinct.withColumn("msg", F.xxhash64("role", "text", F.col("text").isNull()))
    runs = stage(passages(lines(distinct)), "passages")
    own = runs.withColumn("own", F.when(F.col("level") == 0, F.col("content"))).groupBy("conv_id", "turn", "msg").agg(
        _joined("own", "run", "\n").alias("own"),
        F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).alias("n_quotes"),
        F.max("level").alias("max_level"),
    )
    linked = stage(links(runs.filter("conv_id is not null and turn is not null")), "quotes").filter("original is not null")
    by_message = linked.groupBy("conv_id", "turn", "msg").agg(
        F.count(F.lit(1)).alias("n_linked"), F.max(F.struct(-F.col("level"), "original")).getField("original").alias("parent")
    )
    # Different messages of one turn are one node of the reply order.
    parents = by_message.groupBy("conv_id", "turn").agg(F.max("parent").alias("parent"))
    chains = roots(parents)
    names = ("conv_id", "turn", "msg")
    texts = own.withColumnsRenamed({c: f"o_{c}" for c in names})
    trimmed = F.regexp_replace("own", r"^\s+|\s+\z", "")
    return (
        distinct.drop("text")
        .join(texts, F.expr(" AND ".join(f"{c} <=> o_{c}" for c in names)))
        .join(by_message, ["conv_id", "turn", "msg"], "left")
        .join(chains, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", trimmed.alias("text"), F.col("n_quotes").cast("long"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.col("max_level").cast("long"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
        .orderBy("conv_id", "root_turn", "turn", "role", "text")
    )
