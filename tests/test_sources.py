import pytest
from pyspark.sql import functions as F

from duoscreen.operators import reshape
from duoscreen.plans import study
from duoscreen.session import shared_dir, stage
from duoscreen.sources import readers
from duoscreen.sources.sinks import write_scores


def test_literal_na_stays_a_gene(spark, tmp_path):
    path = tmp_path / "counts.txt"
    path.write_text("id\tg1\tg2\tt0\tr1\nx\tA\tNA\t5\t7\ny\tNone\tB\t1\tNA\n")
    schema = readers.screen_schema(["id", "g1", "g2"], ["t0", "r1"])
    rows = readers.read_counts(spark, str(path), schema).orderBy("id").collect()
    assert (rows[0].g2, rows[0].t0, rows[1].g1) == ("NA", 5.0, "None")
    assert (rows[0].r1, rows[1].r1) == (7.0, None)
    assert readers.read_counts(spark, str(path), schema).agg(F.avg("r1")).first()[0] == 7.0


def test_scores_in_both_orientations_are_averaged(spark):
    rows = [("A", "B", "f", 1.0, "s"), ("B", "A", "f", 3.0, "s"), ("A", "C", "f", 5.0, "s"), ("A", "C", "o", 9.0, "t")]
    table = spark.createDataFrame(rows, "gene_1 string, gene_2 string, cell_line_origin string, x double, study_origin string")
    got = {r.gene_pair: (r.f, r.o) for r in study.import_scores(table, "s", ["f", "o"], "x").collect()}
    assert got == {"A_B": (2.0, None), "A_C": (5.0, None)}


def test_gene_lists(spark, tmp_path):
    table = tmp_path / "species.txt"
    table.write_text("Human\tMouse\nAARS\tAars\nRPL3\tRpl3\n")
    assert [r.gene for r in readers.read_gene_list(spark, str(table), "Human").collect()] == ["AARS", "RPL3"]
    every = {r.gene for r in readers.read_gene_list_all_columns(spark, str(table)).collect()}
    assert every == {"AARS", "Aars", "RPL3", "Rpl3"}
    ids = tmp_path / "ids.csv"
    ids.write_bytes(b"Gene\r\nAAMP (14)\r\nAARS1 (16)\r\n")
    assert [r.gene for r in readers.read_symbols_with_ids(spark, str(ids)).collect()] == ["AAMP", "AARS1"]


def test_expression_matrix(spark):
    df = spark.createDataFrame([("M1", 2.0, 0.1), ("M2", 1.0, 3.0), ("M9", 9.0, 9.0)], "X string, `TP53..7157.` double, `KRAS..3845.` double")
    rows = readers.expression_matrix(df, "X", {"M1": "L1", "M2": "L2"}, 1.5).collect()
    assert {(r.gene, r.sample, r.is_expressed) for r in rows} == {
        ("TP53", "L1", True), ("TP53", "L2", False), ("KRAS", "L1", False), ("KRAS", "L2", True),
    }


def test_alias_lookup(spark):
    table = spark.createDataFrame(
        [("A", "E1", "OLD1, OLD2"), ("B", "E2", None), ("C", "E3", "OLD2"), ("D", "", "OLD4")], "s string, i string, p string"
    )
    aliases = readers.alias_table(table, "s", "i", "p")
    genes = spark.createDataFrame([("A",), ("OLD1",), ("OLD2",), ("OLD4",), ("B",)], "gene string")
    got = {(r.gene, r.gene_id) for r in readers.lookup_symbols(genes, aliases).collect()}
    assert got == {("A", "E1"), ("B", "E2"), ("OLD1", "E1"), ("OLD2", "E1"), ("OLD2", "E3"), ("OLD4", None)}


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="score table lacks columns: SL_score"):
        study.prepare_scores(spark.range(1).select(*[F.lit("x").alias(c) for c in study.SCORE_COLUMNS if c != "SL_score"]))


def test_label_branches(spark):
    df = spark.createDataFrame([("a", "b", "l", -2.0, 0.01), ("a", "c", "l", -2.0, 0.5), ("b", "c", "l", 0.0, 0.01)],
                               "gene_1 string, gene_2 string, cell_line_origin string, SL_score double, statistical_score double")

    def labels(score, stat):
        cut = spark.createDataFrame([(score, stat)], "score double, statistic double")
        return [r.SL_or_not for r in study.label_lethal(df, cut).orderBy("gene_1", "gene_2").collect()]

    assert labels(-1.0, 0.05) == ["SL", "Not SL", "Not SL"]
    assert labels(-1.0, 0.0) == ["SL", "SL", "Not SL"]
    assert labels(0.0, 0.05) == ["SL", "Not SL", "SL"]
    assert labels(0.0, 0.0) == ["Not SL"] * 3


def test_prepare_study(spark):
    counts = spark.createDataFrame(
        [("g1", "g2", "a", "b", "5;6;7", "l", "s", "T0;E1;E2"), ("g1", "g3", "a", "nt", "5;6", "l", "s", "T0;E1;E2"),
         ("g3", "g4", "nt", "nt", "1;2;3", "l", "s", "T0;E1;E2"), ("g5", "g6", "z", "y", "1;2;3", "l", "s", "T0;E1;E2")],
        ", ".join(f"{c} string" for c in study.COUNT_COLUMNS),
    )
    scores = spark.createDataFrame(
        [("a", "b", "s", "l", -2.0, -1.0, 0.0, 0.0), ("a", "a", "s", "l", -9.0, -1.0, 0.0, 0.0)],
        "gene_1 string, gene_2 string, study_origin string, cell_line_origin string, SL_score double, SL_score_cutoff double, statistical_score double, statistical_score_cutoff double",
    )
    sequences = spark.createDataFrame([("g1", "acgt", "a"), ("g3", "ttt", "nt")], "sgRNA_guide_name string, sgRNA_guide_seq string, sgRNA_target_name string")
    out = study.prepare_study(sequences, counts, scores, ["nt"], (["T0"], ["E1", "E2"]), "s", remove_unrelated=True)
    rows = {r.guide_2: r for r in out["counts"].collect()}
    assert set(rows) == {"G2", "G3", "G4"}
    assert (rows["G2"].T0_counts, rows["G2"].TEnd_counts, rows["G2"].target_type) == ("5.0", "6.0;7.0", "Dual")
    assert (rows["G3"].TEnd_counts, rows["G3"].target_type, rows["G4"].target_type) == ("6.0", "Single", "Control")
    assert [(r.gene_pair, r.SL_or_not) for r in out["score"].collect()] == [("A_B", "SL")]
    assert {r.sgRNA_target_name for r in out["sequence"].collect()} == {"A", "CONTROL"}


def test_reshape_round_trip(spark):
    df = spark.createDataFrame([("p", "x", 1.0), ("p", "y", 2.0), ("q", "x", 3.0)], "k string, s string, v double")
    wide = {r.k: (r.v_x, r.v_y) for r in reshape.widen(df, ["k"], "s", ["x", "y"], {"v": "v"}).collect()}
    assert wide == {"p": (1.0, 2.0), "q": (3.0, None)}
    first = reshape.keep_first(df, ["k"], ["v"])
    assert {(r.k, r.s) for r in first.collect()} == {("p", "x"), ("q", "x")}
    both = reshape.full_outer({"x": df.where("s = 'x'"), "y": df.where("s = 'y'")}, "k", "v")
    assert {tuple(r) for r in both.collect()} == {("p", 1.0, 2.0), ("q", 3.0, None)}


@pytest.mark.parametrize("fmt", ["csv", "tsv", "parquet"])
def test_sink(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a_b", 0.5)], "gene_pair string, z double")
    write_scores(df, str(tmp_path / fmt), fmt)
    if fmt == "parquet":
        back = spark.read.parquet(str(tmp_path / fmt))
    else:
        back = spark.read.schema(df.schema).csv(str(tmp_path / fmt), header=True, sep="\t" if fmt == "tsv" else ",")
    assert [tuple(r) for r in back.collect()] == [("a_b", 0.5)]


def test_stage_uses_the_session_folder(spark):
    folder = shared_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured
    df = stage(spark.range(3).toDF("x"), "test")
    assert df.count() == 3 and folder in df.inputFiles()[0]
