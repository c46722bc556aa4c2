"""Study preparation for export, and import of precomputed scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscreen.functions.labels import flip_sign, pair_key, upper_ids
from duoscreen.functions.packed import select_conditions, unpack
from duoscreen.operators.filters import drop_control_genes, drop_same_gene, keep_scored_genes, with_row
from duoscreen.operators.reshape import widen
from duoscreen.sources.readers import require_columns

# The column names that the three study tables must have.
SEQUENCE_COLUMNS = ["sgRNA_guide_name", "sgRNA_guide_seq", "sgRNA_target_name"]
COUNT_COLUMNS = [
    "guide_1", "guide_2", "gene_1", "gene_2", "count_replicates", "cell_line_origin", "study_origin", "study_conditions",
]
SCORE_COLUMNS = [
    "gene_1", "gene_2", "study_origin", "cell_line_origin",
    "SL_score", "SL_score_cutoff", "statistical_score", "statistical_score_cutoff",
]

Conditions = tuple[Sequence[str], Sequence[str]]


def first_cutoffs(scores: DataFrame) -> DataFrame:
    """Cut-offs of the first row, in the order of genes and cell line, as a one-row table."""
    cut = F.struct("SL_score_cutoff", "statistical_score_cutoff")
    order = F.struct("gene_1", "gene_2", "cell_line_origin")
    return scores.agg(F.min_by(cut, order).alias("c")).select(
        F.col("c.SL_score_cutoff").alias("score"), F.col("c.statistical_score_cutoff").alias("statistic")
    )


def label_lethal(scores: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """``SL`` or ``Not SL`` from the score, the statistic, or both; zero means that a cut-off is not used."""
    df = with_row(scores, cutoffs if cutoffs is not None else first_cutoffs(scores), "_cut")
    score, statistic = F.col("_cut.score"), F.col("_cut.statistic")
    by_score, by_statistic = F.col("SL_score") <= score, F.col("statistical_score") <= statistic
    hit = (
        F.when((score != 0) & (statistic != 0), by_score & by_statistic)
        .when(score != 0, by_score)
        .when(statistic != 0, by_statistic)
        .otherwise(F.lit(False))
    )
    return df.withColumn("SL_or_not", F.when(hit, "SL").otherwise("Not SL")).drop("_cut")


def prepare_scores(
    scores: DataFrame, controls: Sequence[str] | None = None, controls_as_substring: bool = True
) -> DataFrame:
    """Upper-case ids, pair key, no same-gene or control pairs, and the label."""
    df = require_columns(scores, SCORE_COLUMNS, "score").na.fill(0)
    df = upper_ids(df, ["gene_1", "gene_2", "cell_line_origin"])
    df = df.withColumn("gene_pair", pair_key(F.col("gene_1"), F.col("gene_2")))
    df = drop_same_gene(df, "gene_1", "gene_2")
    if controls:
        df = drop_control_genes(df, ["gene_1", "gene_2"], [c.upper() for c in controls], controls_as_substring)
    return label_lethal(df)


def common_conditions(counts: DataFrame) -> DataFrame:
    """Most frequent condition list per cell line (A19); the first in text order on a tie."""
    return counts.groupBy("cell_line_origin").agg(F.mode("study_conditions", True).alias("_conditions"))


def prepare_counts(
    counts: DataFrame, controls: Sequence[str] | None, conditions: dict[str, Conditions] | Conditions
) -> DataFrame:
    """Upper-case ids, arity, early and late counts by condition name, pair key and orientation."""
    listed = [c.upper() for c in controls or ()]
    df = upper_ids(
        require_columns(counts, COUNT_COLUMNS, "counts"), ["guide_1", "guide_2", "gene_1", "gene_2", "cell_line_origin"]
    )
    c1, c2 = F.col("gene_1").isin(listed), F.col("gene_2").isin(listed)
    df = df.withColumn(
        "target_type",
        F.when(~c1 & ~c2 & (F.col("gene_1") != F.col("gene_2")), "Dual").when(c1 & c2, "Control").otherwise("Single"),
    ).drop("Type", "Sequencing")
    df = df.join(common_conditions(df), "cell_line_origin", "left")
    names, values = F.split("_conditions", ";"), unpack(F.col("count_replicates"))

    def per_line(pick):
        if not isinstance(conditions, dict):
            return F.array(*map(F.lit, pick(conditions)))
        out = F.lit(None).cast("array<string>")
        for line, c in conditions.items():
            out = F.when(F.col("cell_line_origin") == line.upper(), F.array(*map(F.lit, pick(c)))).otherwise(out)
        return out

    for prefix, pick in (("T0", lambda c: c[0]), ("TEnd", lambda c: c[1])):
        wanted = per_line(pick)
        kept = F.transform(select_conditions(values, names, wanted), lambda v: v.cast("string"))
        df = df.withColumn(f"{prefix}_counts", F.array_join(kept, ";"))
        df = df.withColumn(f"{prefix}_replicate_names", F.array_join(wanted, ";"))
    ordered = F.col("gene_1") <= F.col("gene_2")
    return (
        df.withColumn("gene_pair", pair_key(F.col("gene_1"), F.col("gene_2"), "|"))
        .withColumn("gene_pair_orientation", F.when(ordered, "A_B").otherwise("B_A"))
        .drop("_conditions")
    )


def prepare_sequences(sequences: DataFrame, controls: Sequence[str] | None, study: str) -> DataFrame:
    """Upper-case ids, control targets named CONTROL, and the study id."""
    listed = [c.upper() for c in controls or ()]
    df = upper_ids(require_columns(sequences, SEQUENCE_COLUMNS, "sequence"), SEQUENCE_COLUMNS)
    hit = F.col("sgRNA_target_name").isin(listed) | F.col("sgRNA_guide_name").isin(listed)
    return df.withColumn(
        "sgRNA_target_name", F.when(hit, "CONTROL").otherwise(F.col("sgRNA_target_name"))
    ).withColumn("study_origin", F.lit(study))


def prepare_study(
    sequences: DataFrame,
    counts: DataFrame,
    scores: DataFrame,
    controls: Sequence[str] | None,
    conditions: dict[str, Conditions] | Conditions,
    study: str,
    controls_as_substring: bool = True,
    remove_unrelated: bool = False,
) -> dict[str, DataFrame]:
    """The three tables of a study, ready for export."""
    out_scores = prepare_scores(scores, controls, controls_as_substring)
    out_counts = prepare_counts(counts, controls, conditions)
    if remove_unrelated:
        listed = [c.upper() for c in controls or ()]
        out_counts = keep_scored_genes(out_counts, out_scores, "cell_line_origin", ("gene_1", "gene_2"), listed)
    return {"sequence": prepare_sequences(sequences, controls, study), "counts": out_counts, "score": out_scores}


def import_scores(
    table: DataFrame, study, lines: Sequence[str], score: str, flip: Sequence[str] = ()
) -> DataFrame:
    """One column per cell line from a table of precomputed scores, in this engine's sign and key.

    A pair that a table holds several times in a cell line, in one orientation or both, gets the mean of its scores.
    """
    one = flip_sign(table, flip).where(F.col("study_origin") == study)
    keyed = one.withColumn("gene_pair", pair_key(F.col("gene_1"), F.col("gene_2")))
    single = keyed.groupBy("gene_pair", "cell_line_origin").agg(F.avg(score).alias(score))
    return widen(single, ["gene_pair"], "cell_line_origin", lines, {"": score})
