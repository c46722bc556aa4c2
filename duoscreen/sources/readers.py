"""Readers of screen tables, gene lists, expression tables, alias tables and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A text that no file holds: "NA" and "None" are gene partners in some libraries and must stay strings.
_NEVER = "\u0000"


def screen_schema(ids: Sequence[str], counts: Sequence[str]) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in ids] + [T.StructField(c, T.DoubleType()) for c in counts]
    return T.StructType(fields)


def read_counts(
    spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = "\t", header: bool = True
) -> DataFrame:
    """Delimited or parquet screen counts (S1). Give a schema for delimited files: no inference pass is made.

    ``NA`` in a count column is NULL; in a string column it stays a name.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("sep", sep).option("header", header).option("nullValue", _NEVER)
    reader = reader.option("emptyValue", "").option("nanValue", "NA")
    if schema is None:
        return reader.csv(path)
    counts = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return reader.schema(schema).csv(path).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in counts})


def read_gene_list(spark: SparkSession, path: str, column: str, sep: str = "\t") -> DataFrame:
    """One column of a gene list."""
    return read_counts(spark, path, None, sep).select(F.trim(F.col(column)).alias("gene"))


def read_gene_list_all_columns(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All columns of a gene list as one (S3)."""
    table = read_counts(spark, path, None, sep)
    return flatten_columns(table)


def flatten_columns(table: DataFrame) -> DataFrame:
    values = F.explode(F.array(*[F.col(f"`{c}`") for c in table.columns])).alias("gene")
    return table.select(values).where(F.col("gene").isNotNull() & (F.col("gene") != "")).distinct()


def symbol_before_id(column: Column) -> Column:
    """``SYMBOL (number)`` to ``SYMBOL``."""
    return F.regexp_extract(column, r"^(.*?)\s*\(", 1)


def read_symbols_with_ids(spark: SparkSession, path: str, column: str = "Gene", sep: str = ",") -> DataFrame:
    """Gene list of ``SYMBOL (number)`` entries."""
    return read_counts(spark, path, None, sep).select(symbol_before_id(F.col(column)).alias("gene"))


def threshold_expression(table: DataFrame, gene: str, samples: Sequence[str], at_least: float) -> DataFrame:
    """Wide expression levels to ``(gene, sample, is_expressed)``."""
    long = table.unpivot([gene], list(samples), "sample", "level")
    return long.select(F.col(gene).alias("gene"), "sample", (F.col("level") >= at_least).alias("is_expressed"))


def expression_matrix(
    matrix: DataFrame, model: str, lines: dict[str, str], at_least: float
) -> DataFrame:
    """Models-by-genes matrix to long flags: gene suffix cut, model id renamed to cell line, threshold."""
    genes = [c for c in matrix.columns if c != model]
    name = F.create_map(*[x for pair in lines.items() for x in map(F.lit, pair)])
    return (
        matrix.where(F.col(model).isin(list(lines)))
        .withColumnsRenamed({g: g.replace(".", "\u0001") for g in genes})
        .unpivot([model], [g.replace(".", "\u0001") for g in genes], "gene", "level")
        .select(
            F.regexp_replace(F.translate("gene", "\u0001", "."), r"\.{2}.*$", "").alias("gene"),
            name[F.col(model)].alias("sample"),
            (F.col("level") >= at_least).alias("is_expressed"),
        )
    )


def alias_table(table: DataFrame, symbol: str, gene_id: str, previous: str, sep: str = ",") -> DataFrame:
    """One row per previous symbol; rows without an id are dropped, symbols without aliases stay."""
    return (
        table.where(F.col(gene_id).isNotNull() & (F.col(gene_id) != ""))
        .select(
            F.col(symbol).alias("symbol"),
            F.col(gene_id).alias("gene_id"),
            F.explode_outer(F.split(F.col(previous), sep)).alias("previous"),
        )
        .withColumn("previous", F.trim("previous"))
    )


def lookup_symbols(genes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Gene id by approved symbol, else by previous symbol.

    ``genes`` has one column ``gene``. Ambiguous symbols keep all their ids; an empty id among several is dropped.
    """
    approved = aliases.select(F.col("symbol").alias("gene"), "gene_id").distinct()
    first = genes.distinct().join(approved, "gene", "left")
    several = F.count(F.lit(1)).over(Window.partitionBy("gene")) > 1
    first = first.withColumn("_several", several).where(
        ~(F.col("_several") & (F.coalesce(F.col("gene_id"), F.lit("")) == ""))
    )
    known = first.where(F.col("gene_id").isNotNull()).select("gene", "gene_id")
    renamed = aliases.where(F.col("previous") != "").select(F.col("previous").alias("gene"), "gene_id")
    rest = first.where(F.col("gene_id").isNull()).select("gene").join(renamed, "gene", "left")
    return known.unionByName(rest.select("gene", "gene_id"))


def read_study_scores(
    spark: SparkSession, path: str, study: str, columns: Sequence[str], sep: str = ","
) -> DataFrame:
    """Rows of one study from a table of precomputed scores."""
    table = read_counts(spark, path, None, sep)
    return table.where(F.col("study_origin") == study).select(*columns)


def every_second_row(df: DataFrame, line_number: str, offset: int = 1) -> DataFrame:
    """Keep every second row of a file that alternates with filler rows.

    Files have no order once they are split, so the line number must be a column. Numbers without gaps need no sort.
    """
    return df.where(F.col(line_number) % 2 == offset)


def require_columns(df: DataFrame, needed: Sequence[str], table: str) -> DataFrame:
    """Fail early when a table lacks columns."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{table} table lacks columns: {', '.join(missing)}")
    return df
