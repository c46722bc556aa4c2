"""Queries of the readers and sinks: a given table is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duoscreen.catalog import scores  # noqa: F401  its subqueries are used below
from duoscreen.catalog.base import query
from duoscreen.catalog.screens import CONTROL, COUNTS, IDS, _screen
from duoscreen.catalog.studies import _scores_in
from duoscreen.functions.labels import columns_like
from duoscreen.functions.rows import row_mean
from duoscreen.plans import delta_lfc
from duoscreen.screen import CONSTRUCT, Layout
from duoscreen.session import shared_dir
from duoscreen.sources import readers, sinks
from duoscreen.sources.lineitem_screen import LAYOUT


def _path(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/duoscreen/{tag}-{uuid.uuid4().hex}"


_late = LAYOUT.late


@query(
    "delimited_counts",
    f"SELECT {IDS}, t0, {', '.join(f'nullif({c}, 0) AS {c}' for c in _late)}, "
    + f"(SELECT avg(nullif({_late[0]}, 0)) FROM screen) AS mean_first FROM screen",
    [*COUNTS, "mean_first"],
)
def delimited_counts(spark, d):
    """Counts written as text with NA for zero, and read back: NA is NULL, so a mean leaves it out."""
    path = _path(spark, "counts")
    text = {c: F.when(F.col(c) == 0, "NA").otherwise(F.col(c).cast("string")) for c in _late}
    sinks.write_scores(_screen(spark, d).withColumns(text).select(*CONSTRUCT, *COUNTS), path, "tsv")
    table = readers.read_counts(spark, path, readers.screen_schema(CONSTRUCT, COUNTS))
    mean = table.select(F.avg(_late[0]).alias("mean_first"))
    return table.withColumn("mean_first", mean.scalar())


@query("one_column_gene_list", "SELECT trim(p_brand) AS gene FROM part")
def one_column_gene_list(spark, d):
    """One column of a delimited table."""
    path = _path(spark, "genes")
    sinks.write_scores(spark.read.parquet(f"{d}/part.parquet").select("p_name", "p_brand"), path, "tsv")
    return readers.read_gene_list(spark, path, "p_brand")


@query("one_study_of_scores", "SELECT gene_1, gene_2, SL_score FROM study_scores_in", ["SL_score"])
def one_study_of_scores(spark, d):
    """The rows of one study out of a file with two."""
    path = _path(spark, "scores")
    own = _scores_in(spark, d).withColumn("study_origin", F.lit("lines"))
    sinks.write_scores(own.unionByName(own.withColumn("study_origin", F.lit("other"))), path)
    table = readers.read_study_scores(spark, path, "lines", ["gene_1", "gene_2", "SL_score"])
    return table.withColumn("SL_score", F.col("SL_score").cast("double"))


@query("written_scores", "SELECT gene_pair, sample, dlfc, zdlfc FROM zd", ["dlfc", "zdlfc"])
def written_scores(spark, d):
    """Scores written as parquet and read back."""
    path = _path(spark, "zdlfc") + ".parquet"
    sinks.write_scores(delta_lfc.zdlfc(_screen(spark, d), LAYOUT), path, "parquet")
    return readers.read_counts(spark, path)


@query(
    "columns_by_pattern",
    f"SELECT {IDS}, ({' + '.join(LAYOUT.samples['F'])}) / 3 AS f_mean, ({' + '.join(LAYOUT.samples['O'])}) / 3 AS o_mean FROM screen",
    ["f_mean", "o_mean"],
)
def columns_by_pattern(spark, d):
    """Replicates found by name patterns instead of a list."""
    df = _screen(spark, d)
    layout = Layout.by_token(columns_like(df, "^[fo]_"), ["f_", "o_"], "t0", CONTROL)
    return df.select(*CONSTRUCT, *[row_mean(cols).alias(f"{token}mean") for token, cols in layout.samples.items()])
