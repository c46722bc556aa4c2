"""A screen table derived from an order-line table.

Raw counts of the published screens are not redistributable, so the registered queries read the given star-schema
tables as a screen: part and supplier numbers name the genes at position 1 and 2, order and line numbers name
the guides, quantities are reads, ``l_linestatus`` is the cell line and ``l_returnflag`` the replicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscreen.screen import Layout

LINES = ["F", "O"]
REPLICATES = ["A", "N", "R"]
ESSENTIALS = ["G01", "G02"]

LAYOUT = Layout(
    samples={s: [f"{s}_{r}".lower() for r in REPLICATES] for s in LINES},
    t0="t0",
    control="CTRL",
)


def _gene(number) -> "F.Column":
    return F.when(number == 0, F.lit(LAYOUT.control)).otherwise(
        F.concat(F.lit("G"), F.lpad(number.cast("string"), 2, "0"))
    )


def screen_from_lineitem(
    spark: SparkSession, sf_dir: str, genes: tuple[int, int] = (12, 10), guides: tuple[int, int] = (6, 7)
) -> DataFrame:
    """One row per construct; ``guides`` is a parameter so that constructs can grow with the data.

    The reads are summed on four integers, with partial sums before the only shuffle; names are built after it.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    quantity = F.col("l_quantity")
    counts = [
        F.sum(
            F.when((F.col("l_linestatus") == s) & (F.col("l_returnflag") == r), quantity).otherwise(0.0)
        ).alias(f"{s}_{r}".lower())
        for s in LINES
        for r in REPLICATES
    ]
    summed = lines.groupBy(
        (F.col("l_partkey") % genes[0]).alias("_g1"),
        (F.col("l_suppkey") % genes[1]).alias("_g2"),
        (F.col("l_orderkey") % guides[0]).alias("_x1"),
        (F.col("l_linenumber") % guides[1]).alias("_x2"),
    ).agg(F.sum(quantity).alias("t0"), *counts)
    return (
        summed.withColumn("gene1", _gene(F.col("_g1")))
        .withColumn("gene2", _gene(F.col("_g2")))
        .select(
            "gene1",
            "gene2",
            F.concat_ws(".", "gene1", F.col("_x1").cast("string")).alias("guide1"),
            F.concat_ws(".", "gene2", F.col("_x2").cast("string")).alias("guide2"),
            "t0",
            *LAYOUT.late,
        )
    )


def expression_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression levels by gene, one column per cell line, from the part table."""
    number = F.col("p_partkey") % 12
    size = F.col("p_size").cast("double")
    odd_lot = F.floor(F.col("p_partkey") / 12) % 2 == 1
    return (
        spark.read.parquet(f"{sf_dir}/part.parquet")
        .groupBy(_gene(number).alias("gene"))
        .agg(F.avg(size).alias("F"), F.avg(F.when(odd_lot, size)).alias("O"))
        .where(F.col("gene") != LAYOUT.control)
    )
