"""Variational Bayesian effect model.

Taken from the published description of the model; its package is not part of what this engine was checked
against. For construct c with guides i and j of genes g and h in cell line l

    D_cl ~ Normal(x1_i y_gl + x2_j y_hl + xx_c s_ghl, 1 / tau_cl)

with Gaussian priors on x1, x2, xx, y, s and a Gamma prior on tau. Control genes have y = 0, pairs with a control
s = 0. One sweep updates x1, x2, y, s, then xx and tau; each update is a sum over rows, grouped by guide, by gene
or by pair. Constructs of two genes and constructs with a control are two tables, so no row takes part in a join on
something that it doesn't have. Rows carry the moments of their parameters, and an update refreshes only those that it
changed. Each sweep writes its tables and removes those of the sweep before.

A row finds the parameters of a position, x of its guide and y of its gene, in one table, so a sweep joins rows by
guide and not once more by gene. Once these are new, the rows are written in buckets of their pair: the sums of s, the
way back of s to the rows and the sums of xx then need no exchange. A pair with very many rows is dealt to
several parts, by construct, and its s is read once for each part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscreen.functions.labels import pair_key
from duoscreen.operators.normalize import median_normalised_fold_change, row_mean, to_long
from duoscreen.operators.ordered import exact_quantiles, grouped_median
from duoscreen.screen import CONSTRUCT, GENE1, GENE2, GUIDE1, GUIDE2, Layout
from duoscreen.session import discard, stage, stage_by

PAIR = ["gene_a", "gene_b", "sample"]
#: What the buckets of a sweep's rows go by, and how many rows of a pair are kept together.
BUCKET = ["gene_a", "gene_b", "part"]
PART_ROWS = 1 << 18


@dataclass(frozen=True)
class Priors:
    """rate: of the noise prior; None takes ``shape`` times the variance of a replicate mean in the cell line."""

    mean_x: float = 1.0
    sd_x: float = 1.0
    mean_xx: float = 1.0
    sd_xx: float = 1.0
    mean_y: float = 0.0
    sd_y: float = 10.0
    mean_s: float = 0.0
    sd_s: float = 10.0
    shape: float = 0.5
    rate: float | None = None


@dataclass
class Model:
    doubles: DataFrame  # constructs of two genes by cell line, with the moments of all their parameters
    singles: DataFrame  # constructs with a control: position, gene, guide and their moments
    first: DataFrame  # x1, by guide at position 1
    second: DataFrame  # x2, by guide at position 2
    genes: DataFrame  # y, by gene and cell line
    pairs: DataFrame  # s, by pair and cell line, and into how many parts a pair is dealt
    places: tuple[DataFrame, DataFrame]  # guides and genes that meet at position 1, at position 2
    errors: list[dict[str, float]]  # mean absolute error per cell line, after each sweep
    bounds: list[float]  # evidence bound up to a constant, after each sweep, if asked for
    changes: list[dict[str, float]]  # largest change of y and s against the largest of them, per cell line and sweep


def fold_changes(screen: DataFrame, layout: Layout, constant: float = 32.0) -> DataFrame:
    """Median-normalised fold change by construct and cell line, and the variance of that replicate mean."""
    df = median_normalised_fold_change(screen, layout, constant)

    def both(cols: Sequence[str]) -> Column:
        mean = row_mean(cols)
        n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
        squares = sum((F.coalesce(F.pow(F.col(c) - mean, 2), F.lit(0.0)) for c in cols), F.lit(0.0))
        return F.struct(mean.alias("d"), F.when(n > 1, squares / (n - 1) / n).alias("noise"))

    means = df.select(*CONSTRUCT, *[both(cols).alias(s) for s, cols in layout.samples.items()])
    long = to_long(means, CONSTRUCT, list(layout.samples), "sample", "m")
    return long.select(*CONSTRUCT, "sample", "m.d", "m.noise").where(F.col("d").isNotNull())


def initialise(long: DataFrame, control: str, priors: Priors = Priors(), part_rows: int = PART_ROWS) -> Model:
    """Starting values: x = xx = 1, y the median of a gene's control constructs, s the median pair remainder.

    long: construct, sample, d and, unless ``priors`` has a rate, noise. Noise of lines without replicates is 1.
    A pair is dealt to one part for each ``part_rows`` of its rows.
    """
    c1, c2 = F.col(GENE1) == control, F.col(GENE2) == control
    rows = long.where((F.col(GENE1) != F.col(GENE2)) & ~(c1 & c2))
    if priors.rate is None:
        spread = rows.groupBy("sample").agg((priors.shape * F.coalesce(F.avg("noise"), F.lit(1.0))).alias("rate"))
        rows = rows.join(F.broadcast(spread), "sample")
    else:
        rows = rows.withColumn("rate", F.lit(priors.rate))
    one = {c: F.lit(1.0) for c in ("x", "x2")}
    rows = stage(rows.select(*CONSTRUCT, "sample", "d", "rate").withColumn("tau", priors.shape / F.col("rate")), "rows")
    alone = rows.where(c1 | c2).select(
        "sample", "d", "rate", "tau", *CONSTRUCT, F.when(c1, 2).otherwise(1).alias("position"),
        F.when(c1, F.col(GENE2)).otherwise(F.col(GENE1)).alias("gene"), F.when(c1, F.col(GUIDE2)).otherwise(F.col(GUIDE1)).alias("guide"),
    )
    known = grouped_median(alone, ["gene", "sample"], "d", "y")
    every = rows.select(F.explode(F.array(GENE1, GENE2)).alias("gene"), "sample").distinct().where(F.col("gene") != control)
    genes = every.join(known, ["gene", "sample"], "left").withColumn("y", F.coalesce("y", F.lit(priors.mean_y)))
    genes = stage(genes.withColumn("y2", F.col("y") * F.col("y")), "genes")
    two = rows.where(~c1 & ~c2).withColumns({"gene_a": F.least(GENE1, GENE2), "gene_b": F.greatest(GENE1, GENE2)})
    sides = [
        stage(rows.where(~c).select(F.col(g).alias("guide")).distinct().withColumns(one), "x") for c, g in ((c1, GUIDE1), (c2, GUIDE2))
    ]
    places = tuple(
        stage(two.select(F.col(gene).alias("gene"), F.col(guide).alias("guide")).distinct(), "places")
        for gene, guide in ((GENE1, GUIDE1), (GENE2, GUIDE2))
    )
    two = _with_position(_with_position(two, places[0], sides[0], genes, 1), places[1], sides[1], genes, 2)
    two = two.withColumns({k: F.lit(1.0) for k in ("xx", "xx2")})
    left = two.withColumn("rest", F.col("d") - F.col("ya") - F.col("yb"))
    sizes = two.groupBy(*PAIR[:2]).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    medians = grouped_median(left, PAIR, "rest", "s").withColumn("s2", F.col("s") * F.col("s"))
    pairs = stage(medians.join(sizes, PAIR[:2]), "pairs")
    singles = alone.join(genes, ["gene", "sample"], "left").withColumns(one)
    part = F.pmod(F.xxhash64(*CONSTRUCT), F.col("parts")).cast("int")
    doubles = stage(two.join(pairs, PAIR).withColumn("part", part), "doubles")
    return Model(doubles, stage(singles, "singles"), *sides, genes, pairs, places, [], [], [])


def _with_guides(doubles: DataFrame, guides: DataFrame, position: int) -> DataFrame:
    """Rows with x of the guide at a position."""
    key, name = ((GUIDE1, "a"), (GUIDE2, "b"))[position - 1]
    side = guides.select(F.col("guide").alias(key), F.col("x").alias(name), F.col("x2").alias(f"{name}2"))
    return doubles.drop(name, f"{name}2").join(side, key)


def _with_position(doubles: DataFrame, place: DataFrame, guides: DataFrame, genes: DataFrame, position: int) -> DataFrame:
    """Rows with x of the guide and y of the gene at a position, by one join; y of all cell lines rides along."""
    gene, guide, x, y = ((GENE1, GUIDE1, "a", "ya"), (GENE2, GUIDE2, "b", "yb"))[position - 1]
    lines = F.map_from_entries(F.collect_list(F.struct("sample", F.struct("y", "y2"))))
    by_gene = genes.groupBy("gene").agg(lines.alias("_lines"))
    side = place.join(guides, "guide").join(by_gene, "gene")
    side = side.select(F.col("gene").alias(gene), F.col("guide").alias(guide), F.col("x").alias(x), F.col("x2").alias(f"{x}2"), "_lines")
    own = F.try_element_at("_lines", "sample")
    joined = doubles.drop(x, f"{x}2", y, f"{y}2").join(side, [gene, guide])
    return joined.withColumns({y: own["y"], f"{y}2": own["y2"]}).drop("_lines")


def pair_sums(bucketed: DataFrame, priors: Priors) -> DataFrame:
    """New s of every pair and cell line; only one row for each part of a pair is shuffled."""
    rest = F.col("d") - F.col("a") * F.col("ya") - F.col("b") * F.col("yb")
    parts = bucketed.groupBy(*BUCKET, "sample").agg(
        F.sum(F.col("tau") * F.col("xx2")).alias("w"), F.sum(F.col("tau") * F.col("xx") * rest).alias("r"), F.max("parts").alias("parts")
    )
    return _posterior(parts, PAIR, priors.mean_s, priors.sd_s, ("s", "s2"), F.max("parts").alias("parts"))


def with_pairs(bucketed: DataFrame, pairs: DataFrame, priors: Priors) -> DataFrame:
    """Rows with s of their pair and the xx that follows from it; the bucketed rows stay where they are."""
    lines = F.map_from_entries(F.collect_list(F.struct("sample", F.struct("s", "s2"))))
    slots = pairs.groupBy(*PAIR[:2]).agg(lines.alias("_lines"), F.max("parts").alias("_parts"))
    slots = slots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    own = F.try_element_at("_lines", "sample")
    doubles = bucketed.drop("s", "s2").join(slots, BUCKET).withColumns({"s": own["s"], "s2": own["s2"]}).drop("_lines")
    # A construct has one row per cell line, so this window is over a handful of rows.
    construct = Window.partitionBy(*BUCKET, *CONSTRUCT)
    rest = F.col("d") - F.col("a") * F.col("ya") - F.col("b") * F.col("yb")
    precision = F.lit(1.0 / priors.sd_xx**2) + F.sum(F.col("tau") * F.col("s2")).over(construct)
    remainder = F.lit(priors.mean_xx / priors.sd_xx**2) + F.sum(F.col("tau") * F.col("s") * rest).over(construct)
    doubles = doubles.withColumns({"_p": precision, "_m": remainder, "lines": F.count(F.lit(1)).over(construct)})
    xx = F.col("_m") / F.col("_p")
    return doubles.withColumns({"xx": xx, "xx2": xx * xx + F.lit(1.0) / F.col("_p")}).drop("_p", "_m")


def _posterior(parts: DataFrame, keys: Sequence[str], mean: float, sd: float, names: tuple[str, str], *more: Column) -> DataFrame:
    """Gaussian update from weights ``w`` and weighted remainders ``r``: mean and second moment, and ``more`` aggregates."""
    sums = parts.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("r").alias("r"), *more)
    precision = F.lit(1.0 / sd**2) + F.col("w")
    value = (F.lit(mean / sd**2) + F.col("r")) / precision
    moments = sums.withColumns({names[0]: value, names[1]: value * value + F.lit(1.0) / precision})
    return moments.drop("w", "r")


def evidence_bound(
    doubles: DataFrame, singles: DataFrame, first: DataFrame, second: DataFrame, genes: DataFrame, pairs: DataFrame, priors: Priors
) -> DataFrame:
    """What the updates raise, up to a constant: one row, right after the noise was updated.

    With the noise at its optimum a row adds the log of its precision; each Gaussian parameter takes its divergence
    from the prior. xx has one value for all cell lines of a construct, so each of its ``lines`` rows bears a share.
    """

    def noise(df: DataFrame) -> DataFrame:
        return df.select(((priors.shape + 0.5) * F.log("tau")).alias("part"))

    def prior(df: DataFrame, value: str, mean: float, sd: float, share: Column | float = 1.0) -> DataFrame:
        m = F.col(value)
        v = F.col(f"{value}2") - m * m
        cost = F.lit(-0.5) * F.log(v) + (v + (m - mean) * (m - mean)) / (2 * sd**2)
        return df.select((-cost * share).alias("part"))

    parts = [
        noise(doubles), noise(singles), prior(doubles, "xx", priors.mean_xx, priors.sd_xx, 1 / F.col("lines")),
        prior(first, "x", priors.mean_x, priors.sd_x), prior(second, "x", priors.mean_x, priors.sd_x),
        prior(genes, "y", priors.mean_y, priors.sd_y), prior(pairs, "s", priors.mean_s, priors.sd_s),
    ]
    return reduce(DataFrame.unionByName, parts).agg(F.sum("part").alias("value"))


def sweep(model: Model, priors: Priors = Priors(), evidence: bool = False) -> Model:
    """One round of updates; ``evidence`` adds the bound."""
    d, tau = F.col("d"), F.col("tau")
    one, two, both = F.col("a") * F.col("ya"), F.col("b") * F.col("yb"), F.col("xx") * F.col("s")
    doubles, singles = model.doubles, model.singles

    def guides(position: int, key: str, y: str, other: Column, rows: DataFrame = doubles) -> DataFrame:
        own = rows.select(F.col(key).alias("guide"), (tau * F.col(f"{y}2")).alias("w"), (tau * F.col(y) * (d - other - both)).alias("r"))
        alone = singles.where(F.col("position") == position).select("guide", (tau * F.col("y2")).alias("w"), (tau * F.col("y") * d).alias("r"))
        return stage(_posterior(own.unionByName(alone), ["guide"], priors.mean_x, priors.sd_x, ("x", "x2")), "x")

    first = guides(1, GUIDE1, "ya", two)
    second_of = _with_guides(doubles, first, 1)
    second = guides(2, GUIDE2, "yb", one, second_of)
    both_of = _with_guides(second_of, second, 2)
    numbered = first.withColumn("position", F.lit(1)).unionByName(second.withColumn("position", F.lit(2)))
    singles = singles.drop("x", "x2").join(numbered, ["position", "guide"])

    sides = F.array(
        F.struct(F.col(GENE1).alias("gene"), (tau * F.col("a2")).alias("w"), (tau * F.col("a") * (d - two - both)).alias("r")),
        F.struct(F.col(GENE2).alias("gene"), (tau * F.col("b2")).alias("w"), (tau * F.col("b") * (d - one - both)).alias("r")),
    )
    parts = both_of.select("sample", F.explode(sides).alias("p")).select("sample", "p.*")
    parts = parts.unionByName(singles.select("sample", "gene", (tau * F.col("x2")).alias("w"), (tau * F.col("x") * d).alias("r")))
    genes = stage(_posterior(parts, ["gene", "sample"], priors.mean_y, priors.sd_y, ("y", "y2")), "genes")
    singles = singles.drop("y", "y2").join(genes, ["gene", "sample"])

    placed = _with_position(_with_position(doubles, model.places[0], first, genes, 1), model.places[1], second, genes, 2)
    bucketed = stage_by(placed, "rows", BUCKET)
    pairs = stage(pair_sums(bucketed, priors), "pairs")
    doubles = with_pairs(bucketed, pairs, priors)

    def noise(df: DataFrame, fitted: Column, spread: Column) -> DataFrame:
        df = df.withColumn("error", d - fitted)
        square = F.col("error") * F.col("error") + spread
        return df.withColumn("tau", F.lit(priors.shape + 0.5) / (F.col("rate") + 0.5 * square))

    spread = (
        F.col("a2") * F.col("ya2") - one * one + F.col("b2") * F.col("yb2") - two * two + F.col("xx2") * F.col("s2") - both * both
    )
    alone = F.col("x") * F.col("y")
    doubles = stage(noise(doubles, one + two + both, spread), "doubles")
    singles = stage(noise(singles, alone, F.col("x2") * F.col("y2") - alone * alone), "singles")
    rest = doubles.select("sample", "error").unionByName(singles.select("sample", "error"))
    errors = rest.groupBy("sample").agg(F.avg(F.abs("error")).alias("value"))
    numbers = errors.withColumn("kind", F.lit("error"))
    numbers = numbers.unionByName(parameter_changes(model, genes, pairs).withColumn("kind", F.lit("change")))
    if evidence:
        bound = evidence_bound(doubles, singles, first, second, genes, pairs, priors)
        numbers = numbers.unionByName(bound.select(F.lit(None).cast("string").alias("sample"), "value", F.lit("bound").alias("kind")))
    numbers = numbers.collect()
    mae, change = ({r["sample"]: r["value"] for r in numbers if r["kind"] == k} for k in ("error", "change"))
    bounds = [r["value"] for r in numbers if r["kind"] == "bound"]
    for old in (bucketed, model.doubles, model.singles, model.first, model.second, model.genes, model.pairs):
        discard(old)
    return Model(
        doubles, singles, first, second, genes, pairs, model.places,
        [*model.errors, mae], [*model.bounds, *bounds], [*model.changes, change],
    )


def parameter_changes(before: Model, genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per cell line, the largest change of y and s since ``before``, as a share of the largest of them: ``(sample, value)``."""

    def values(genes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        y = genes.select("sample", F.col("gene").alias("gene_a"), F.lit("").alias("gene_b"), F.col("y").alias(name))
        return y.unionByName(pairs.select("sample", "gene_a", "gene_b", F.col("s").alias(name)))

    both = values(genes, pairs, "now").join(values(before.genes, before.pairs, "then"), PAIR)
    largest = both.groupBy("sample").agg(F.max(F.abs(F.col("now") - F.col("then"))).alias("change"), F.max(F.abs("now")).alias("size"))
    return largest.select("sample", F.coalesce(F.try_divide("change", "size"), F.lit(0.0)).alias("value"))


def infer(
    long: DataFrame,
    control: str,
    sweeps: int | None = None,
    priors: Priors = Priors(),
    tolerance: float = 1e-3,
    part_rows: int = PART_ROWS,
    evidence: bool = False,
) -> Model:
    """Fit the model until, in every cell line, a sweep changes no y or s by more than ``tolerance`` of the largest.

    ``sweeps`` ends it sooner; None sets no limit. This rule does not depend on the unit of the fold changes. The driver
    reads two numbers per cell line after each sweep and, with ``evidence``, the bound.
    """
    model = initialise(long, control, priors, part_rows)
    for _ in count() if sweeps is None else range(sweeps):
        model = sweep(model, priors, evidence)
        if not any(c > tolerance for c in model.changes[-1].values()):  # so a change that is not a number ends it too
            break
    return model


def convergence(model: Model) -> DataFrame:
    """Per cell line and sweep, the mean absolute error and the largest change of y and s."""
    pairs = enumerate(zip(model.errors, model.changes), start=1)
    rows = [(i, s, e, changes.get(s)) for i, (errors, changes) in pairs for s, e in errors.items()]
    return model.genes.sparkSession.createDataFrame(rows, "sweep int, sample string, mae double, change double")


def bounds(model: Model) -> DataFrame:
    """Evidence bound after each sweep of a fit with ``evidence``, up to a constant: ``(sweep, bound)``."""
    return model.genes.sparkSession.createDataFrame(list(enumerate(model.bounds, start=1)), "sweep int, bound double")


def effects(model: Model) -> DataFrame:
    """Fitted effects per pair and cell line: ``(gene_a, gene_b, pair, sample, s, y_a, y_b)``."""
    df = model.pairs
    for gene, name in (("gene_a", "y_a"), ("gene_b", "y_b")):
        side = model.genes.select(F.col("gene").alias(gene), "sample", F.col("y").alias(name))
        df = df.join(side, [gene, "sample"], "left")
    return df.select("gene_a", "gene_b", pair_key(F.col("gene_a"), F.col("gene_b")).alias("pair"), "sample", "s", "y_a", "y_b")


def positive_control_threshold(model: Model, genes: Sequence[str]) -> DataFrame:
    """Median effect of positive control genes, per cell line (G5 with ``pc_gene``)."""
    listed = model.genes.where(F.col("gene").isin(list(genes)))
    return exact_quantiles(listed, ["sample"], "y", {"threshold": 0.5}).drop("n")


def scores(fitted: DataFrame, threshold: DataFrame | float = float("-inf")) -> DataFrame:
    """Strong, sensitive-lethality and sensitive-recovery scores.

    Lethality is left out for pairs with a gene whose own effect is under the threshold. Recovery is given only
    for pairs with such a gene, so a threshold of minus infinity gives no recovery score at all.
    """
    if isinstance(threshold, DataFrame):
        df = fitted.join(F.broadcast(threshold), "sample", "left")
    else:
        df = fitted.withColumn("threshold", F.lit(float(threshold)))
    a, b, s = F.col("y_a"), F.col("y_b"), F.col("s")
    lowest, total = F.least(a, b), a + b + s
    under = lowest < F.col("threshold")
    return df.select(
        "pair",
        "sample",
        (F.abs(s) - F.greatest(F.abs(a), F.abs(b))).alias("strong"),
        F.when(~under, lowest - total).alias("sensitive_lethality"),
        F.when(under, total - lowest).alias("sensitive_recovery"),
    )
