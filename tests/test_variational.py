"""Stopping rule and data layout of the variational fit."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscreen.catalog import QUERIES
from duoscreen.catalog.check import connect
from duoscreen.plans import variational_gi as var
from duoscreen.session import stage

SCHEMA = "gene1 string, gene2 string, guide1 string, guide2 string, sample string, d double, noise double"


def rows(factor=1.0, hot=0):
    rng = np.random.default_rng(3)
    genes = ["CTRL", "A", "B", "C", "D"]
    out = []
    for g in genes:
        for h in genes:
            n = 3 + (hot if (g, h) == ("A", "B") else 0)
            for i in range(n):
                for j in range(3):
                    for line in ("K", "L"):
                        if g != h:
                            out.append((g, h, f"{g}{i}", f"{h}{j}", line, factor * float(rng.normal(-genes.index(g) - genes.index(h) / 2, 0.4)), factor**2 * 0.05))
    return out


def test_sweeps_do_not_depend_on_the_unit(spark):
    counts = []
    for factor in (1.0, 10.0):
        long = stage(spark.createDataFrame(rows(factor), SCHEMA), "long")
        priors = var.Priors(sd_y=10 * factor, sd_s=10 * factor)
        model = var.infer(long, "CTRL", 10, priors, tolerance=0.03)
        table = var.convergence(model).collect()
        assert len(table) == 2 * len(model.errors)
        last = max(r.sweep for r in table)
        assert all(r.change <= 0.03 for r in table if r.sweep == last)
        assert all(max(r.change for r in table if r.sweep == k) > 0.03 for k in range(1, last))
        counts.append(([round(r.change, 9) for r in sorted(table, key=lambda r: (r.sweep, r.sample))], last))
    assert counts[0] == counts[1] and 1 < counts[0][1] < 10


def test_parts_of_a_large_pair_give_the_same_fit(spark):
    long = stage(spark.createDataFrame(rows(hot=40), SCHEMA), "long")
    one, many = (var.infer(long, "CTRL", 2, tolerance=0.0, part_rows=n) for n in (1 << 20, 10))
    parts = many.doubles.groupBy("gene_a", "gene_b").agg(F.countDistinct("part").alias("n"), F.count(F.lit(1)).alias("rows"))
    by = {(r.gene_a, r.gene_b): r for r in parts.collect()}
    assert by["A", "B"].n > 10 and one.doubles.select("part").distinct().count() == 1
    assert many.doubles.groupBy("gene_a", "gene_b", "part").count().agg(F.max("count")).first()[0] < 40
    a, b = ({(r.pair, r["sample"]): (r.s, r.y_a, r.y_b) for r in var.effects(m).collect()} for m in (one, many))
    assert set(a) == set(b) and len(a) == 12
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


def exchanges_over_rows(df, name):
    """Exchanges of the plan that the rows of a table pass."""
    found, stack = 0, [(df._jdf.queryExecution().executedPlan(), 0)]
    while stack:
        node, above = stack.pop()
        kind = node.nodeName()
        if kind.startswith("AdaptiveSparkPlan"):
            stack.append((node.inputPlan(), above))
            continue
        if name in node.simpleString(2000) and node.children().isEmpty():
            found = max(found, above)
        above += kind == "Exchange"
        stack.extend((node.children().apply(i), above) for i in range(node.children().size()))
    return found


def test_bucketed_rows_meet_their_pairs_without_an_exchange(spark, monkeypatch):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    long = stage(session.createDataFrame(rows(), SCHEMA), "long")
    seen = {}
    with_pairs, pair_sums = var.with_pairs, var.pair_sums
    monkeypatch.setattr(var, "with_pairs", lambda *a: seen.setdefault("rows", with_pairs(*a)))
    monkeypatch.setattr(var, "pair_sums", lambda *a: seen.setdefault("sums", pair_sums(*a)))
    monkeypatch.setattr(var, "discard", lambda df: None)
    var.sweep(var.initialise(long, "CTRL"))
    # once for the partial sums of the parts, never for the rows themselves
    assert exchanges_over_rows(seen["rows"], "duoscreen_rows") == 0
    plan = seen["sums"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(gene_a" in plan
    aggregates = [x for x in plan.split("\n") if "HashAggregate" in x]
    assert len(aggregates) == 4  # by part within the bucket, then over the parts of a pair


SMALL = "/root/testdata/sf0.001"
SETTLED = ["variational_effects", "variational_scores", "variational_scores_unbounded"]


@pytest.mark.parametrize("name", SETTLED)
def test_queries_fit_until_settled(spark, monkeypatch, name):
    """No limit on the sweeps and 0.1 % as the last change, in the code and in the SQL."""
    asked = {}

    class Stop(Exception):
        pass

    def infer(*args, **options):
        asked.update(inspect.signature(fit).bind(*args, **options).arguments)
        raise Stop

    fit = var.infer
    monkeypatch.setattr(var, "infer", infer)
    with pytest.raises(Stop):
        QUERIES[name].run(spark, SMALL)
    default = {k: p.default for k, p in inspect.signature(fit).parameters.items()}
    assert (default | asked)["sweeps"] is None and (default | asked)["tolerance"] <= 1e-3
    # the SQL's last sweep moved nothing by more than that
    head, tail = QUERIES[name].sql.rsplit("\nSELECT * REPLACE", 1)
    sweeps, change = connect(SMALL).execute(head + "\nSELECT max(sweep), min(change) FROM gend").fetchone()
    assert "gend" in head and tail and sweeps > 20 and change <= 1e-3


def test_fit_settles_without_a_limit(monkeypatch):
    """Changes that shrink by a tenth: 66 sweeps until the largest is a thousandth; a change that is not a number ends the fit."""

    class Fit:
        changes = []

    def sweep(model, priors, evidence):
        after = Fit()
        after.changes = [*model.changes, step(len(model.changes) + 1)]
        return after

    monkeypatch.setattr(var, "initialise", lambda *a: Fit())
    monkeypatch.setattr(var, "sweep", sweep)
    step = lambda n: {"K": 0.9**n, "L": 0.5**n}
    assert len(var.infer(None, "CTRL").changes) == 66 and len(var.infer(None, "CTRL", 4).changes) == 4
    step = lambda n: {"K": float("nan")}
    assert len(var.infer(None, "CTRL").changes) == 1
