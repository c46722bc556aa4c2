import random
import statistics

import pytest
from pyspark.sql import functions as F

from duoscreen.operators import filters, normalize
from duoscreen.screen import Layout

LAYOUT = Layout(samples={"L": ["r1", "r2"]}, t0="t0")


def test_pool_filter(spark, constructs):
    total = constructs.agg(F.sum("t0")).first()[0]
    limit = 1e6 * 100 / total
    kept = filters.drop_low_pool(constructs, LAYOUT, limit)
    assert kept.count() == constructs.where("t0 >= 100").count()
    masked = filters.mask_low_pool(constructs, LAYOUT, limit)
    assert masked.count() == constructs.count()
    assert masked.where("r1 IS NOT NULL").count() == kept.count()


def test_zero_points(spark):
    layout = Layout(samples={"L": ["late"]}, t0="t0", mid={"late": "mid"})
    df = spark.createDataFrame([(0.0, 5.0), (5.0, 0.0), (None, 5.0), (2.0, 5.0)], "mid double, late double")
    assert [r.late for r in filters.mask_zero_points(df, layout).collect()] == [None, None, None, 5.0]


def test_low_guides(spark):
    rows = [("a1", "b1", 1.0, 50.0), ("a1", "b2", 2.0, 60.0), ("a2", "b1", 90.0, 70.0), ("a2", "b2", 80.0, 80.0)]
    df = spark.createDataFrame(rows, "guide1 string, guide2 string, r1 double, r2 double")
    low = {r.guide: r.reps for r in filters.low_count_guides(df, ["r1", "r2"], 35).collect()}
    assert low == {"a1": ["r1"]}
    masked = filters.mask_low_count_guides(df, ["r1", "r2"], 35)
    assert sorted((r.guide1, r.guide2, r.r1) for r in masked.collect())[:2] == [("a1", "b1", None), ("a1", "b2", None)]
    assert masked.where("r2 IS NULL").count() == 0
    assert filters.mask_low_count_guides(df, ["r1", "r2"], 0) is df


def test_guide_medians_of_hot_guides(spark):
    rows = [("hot", f"b{i % 7}", float(i % 50)) for i in range(300)] + [("cold", "b0", 3.0)]
    df = spark.createDataFrame(rows, "guide1 string, guide2 string, r1 double")
    got = {(r.position, r.guide): r.median_count for r in filters.guide_medians(df, ["r1"]).collect()}
    want = {(1, "hot"): 24.5, (1, "cold"): 3.0}
    for k in range(7):
        counts = [float(i % 50) for i in range(300) if i % 7 == k] + ([3.0] if k == 0 else [])
        want[2, f"b{k}"] = statistics.median(counts)
    assert got == want


def test_control_lists(spark):
    df = spark.createDataFrame([("A", "B"), ("CTRL.1", "B"), ("B", "TRL"), ("xSAFEx", "B"), ("A.B", "Z"), ("A_B", "Z")], "g1 string, g2 string")
    many = ["CTRL", "SAFE", "A.B", *[f"N{i}" for i in range(3000)]]
    both = {tuple(r) for r in filters.drop_control_genes(df, ["g1", "g2"], many).collect()}
    assert both == {("A_B", "Z")}
    part = {tuple(r) for r in filters.drop_control_genes(df, ["g1", "g2"], ["CTRL", "SAFE"], substring=False).collect()}
    assert part == {("CTRL.1", "B"), ("xSAFEx", "B"), ("A.B", "Z"), ("A_B", "Z")}


def test_early_pools_by_replicate(spark):
    df = spark.createDataFrame([(1.0, 50.0, 5.0, 6.0), (99.0, 50.0, 7.0, 8.0)], "e1 double, e2 double, r1 double, r2 double")
    paired = Layout({"L": ["r1", "r2"]}, {"L": ["e1", "e2"]})
    rows = filters.mask_low_pool(df, paired, 100_000.0).orderBy("e2", "r2").collect()
    assert sorted((r.r1, r.r2) for r in rows if r.r1 is None) == [(None, 6.0)]
    averaged = Layout({"L": ["r1", "r2"]}, {"L": ["e1", "e2"]}, pairing="averaged")
    kept = filters.mask_low_pool(df, averaged, 300_000.0).collect()
    assert sorted((r.r1 is None, r.r2 is None) for r in kept) == [(False, False), (True, True)]
    with pytest.raises(ValueError):
        Layout({"L": ["r1", "r2", "r3"]}, {"L": ["e1", "e2"]})


def test_audit_complements_filter(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (1.0, 1.0)], "a double, b double")
    kept, gone = filters.drop_missing(df, ["a", "b"]), filters.removed_rows(df, ["a", "b"])
    assert (kept.count(), gone.count()) == (1, 2)


def test_control_substrings(spark):
    df = spark.createDataFrame([("CTRL1", "A"), ("A", "TR"), ("A", "B")], "gene_1 string, gene_2 string")
    both = filters.drop_control_genes(df, ["gene_1", "gene_2"], ["CTRL"])
    one = filters.drop_control_genes(df, ["gene_1", "gene_2"], ["CTRL"], substring=False)
    assert [tuple(r) for r in both.collect()] == [("A", "B")]
    assert one.count() == 2


def test_empty_replicate_is_dropped(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert filters.drop_empty_replicates(df, ["a", "b"]).columns == ["a"]


def test_row_means(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "a double, b double")
    got = [tuple(r) for r in df.select(normalize.row_mean(["a", "b"]), normalize.row_mean_complete(["a", "b"])).collect()]
    assert got == [(1.0, None), (None, None), (2.0, 2.0)]


def test_mean_scaling(spark, constructs):
    scaled = normalize.mean_scaled(constructs, ["t0", "r1"])
    means = scaled.agg(F.avg("t0"), F.avg("r1")).first()
    assert means[0] == pytest.approx(500) and means[1] == pytest.approx(500)


def test_fold_change_of_zero_is_missing(spark):
    df = spark.createDataFrame([(8.0, 2.0), (0.0, 2.0), (8.0, 0.0)], "late double, early double")
    got = [r[0] for r in df.select(normalize.log_ratio(F.col("late"), F.col("early"))).collect()]
    assert got == [2.0, None, None]


def test_fitness_centres_controls(spark, constructs):
    control = (F.col("gene1") == "CTRL") & (F.col("gene2") == "CTRL")
    out = normalize.fitness_fold_change(constructs, LAYOUT, control)
    mid = out.where(control).agg(F.median("r1"), F.median("r2")).first()
    assert mid[0] == pytest.approx(0, abs=1e-12) and mid[1] == pytest.approx(0, abs=1e-12)


def test_ten_thousand_control_names(spark):
    rng = random.Random(4)
    names = [f"CT{i:05d}" for i in range(10_000)]
    genes = ["CT00017", "xCT00018y", "T0001", "", "CT", "A", "é", None, *[f"G{rng.randrange(10**6)}" for _ in range(50)]]
    df = spark.createDataFrame([(g, "B") for g in genes] + [("B", "00019")], "g1 string, g2 string")

    def plain(substring):
        hit = lambda g: any(g in n or (substring and n in g) for n in names)
        return sorted((a, b) for a, b in [*[(g, "B") for g in genes if g is not None], ("B", "00019")] if not hit(a) and not hit(b))

    sizes = []
    for substring in (True, False):
        got = filters.drop_control_genes(df, ["g1", "g2"], names, substring)
        assert sorted(map(tuple, got.collect())) == plain(substring)
        small = filters.drop_control_genes(df, ["g1", "g2"], names[:10], substring)
        sizes.append([len(x._jdf.queryExecution().optimizedPlan().toString().split("\n")) for x in (got, small)])
    assert all(a == b for a, b in sizes)
    assert filters.drop_control_genes(df, ["g1"], []).count() == df.count()
    assert filters.drop_control_genes(df, ["g1"], ["", "x"]).count() == 0
