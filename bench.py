"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from duoscreen.catalog import QUERIES

HEADLINE = [
    "screen_counts",
    "mean500_lfc",
    "low_guide_mask",
    "smf",
    "dlfc",
    "zdlfc",
    "kde_grid",
    "crispr_scores",
    "regression_pairs",
    "quadratic_pairs",
    "moderated_pairs",
    "variational_scores",
]


def trial(spark: SparkSession, constructs: int = 6_000_000) -> dict[str, float]:
    """Seconds of the scores over made-up constructs, one gene pair holding a third of them; not part of the total."""
    from pyspark.sql import functions as F

    from duoscreen.plans import delta_lfc, moderated_gi, quadratic_gi, regression_gi
    from duoscreen.session import stage
    from duoscreen.sources.lineitem_screen import LAYOUT

    def gene(column: str, n: int):
        number = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.pmod(F.xxhash64("id", F.lit(column)), F.lit(n)))
        return F.when(number == 0, F.lit(LAYOUT.control)).otherwise(F.concat(F.lit("G"), number.cast("string")))

    rows = spark.range(constructs).withColumns({"gene1": gene("a", 400), "gene2": gene("b", 300)})
    rows = rows.withColumns({f"guide{i}": F.concat_ws(".", f"gene{i}", (F.shiftright("id", 3 * i) % 40).cast("string")) for i in (1, 2)})
    counts = {c: (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(900)) + 20).cast("double") for c in [*LAYOUT.late, "t0"]}
    screen = stage(rows.withColumns(counts).drop("id"), "trial")
    genes = screen.select(F.explode(F.array("gene1", "gene2")).alias("gene")).distinct().where(F.col("gene") != LAYOUT.control)
    essentials = genes.where(F.xxhash64("gene") % 10 == 0)
    lines = F.explode(F.array(*map(F.lit, LAYOUT.samples)))
    expression = genes.select("gene", lines.alias("sample")).withColumn("is_expressed", F.xxhash64("gene") % 5 != 0)

    def regression(screen, layout):
        return regression_gi.regression_gi(screen, layout, essentials, expression)

    scores = {"zdlfc": delta_lfc.zdlfc, "regression": regression, "quadratic": quadratic_gi.quadratic_gi, "moderated": moderated_gi.moderated_gi}
    times = {}
    for name, score in scores.items():
        start = time.perf_counter()
        score(screen, LAYOUT).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
            | ({"trial": trial(spark)} if os.environ.get("BENCH_TRIAL") else {})
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
