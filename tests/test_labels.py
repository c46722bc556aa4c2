from pyspark.sql import functions as F

from duoscreen.functions import labels, packed

SCHEMA = "gene1 string, gene2 string, guide1 string, guide2 string"
ROWS = [("B", "A", "b1", "a1"), ("A", "A", "a1", "a2"), ("NT", "A", "n1", "a1"), ("A", "NT", "a1", "n2"), ("NT", "NT", "n1", "n2")]


def test_split_keeps_rest(spark):
    df = spark.createDataFrame([("g1_x_g2_y_z",), ("a",)], "id string")
    rows = labels.split_into(df, "id", "_", ["a", "b", "c", "d"]).collect()
    assert tuple(rows[0])[1:] == ("g1", "x", "g2", "y_z")
    assert tuple(rows[1])[1:] == ("a", None, None, None)


def test_sort_moves_guides(spark):
    df = labels.sort_positions(spark.createDataFrame(ROWS[:1], SCHEMA))
    assert tuple(df.first()) == ("A", "B", "a1", "b1")


def test_classes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    essential = [F.col(c) == "A" for c in ("gene1", "gene2")]
    got = [r[0] for r in df.select(labels.target_class("NT", *essential)).collect()]
    assert got == ["DT", "ST", "PC", "PC", "NC"]
    assert [r[0] for r in df.select(labels.target_arity("NT")).collect()] == ["Dual", "Single", "Single", "Single", "Control"]
    moved = df.select(labels.same_gene_is_dual(labels.target_arity("NT"))).collect()
    assert moved[1][0] == "Dual"


def test_single_guides(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = df.select(labels.targeting_guide("NT"), labels.control_guide("NT")).collect()
    assert [tuple(r) for r in got[2:4]] == [("a1", "n1"), ("a1", "n2")]
    assert tuple(got[0]) == (None, None)


def test_orientations_are_opposite_for_unequal_genes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).where("gene1 <> gene2")
    rows = df.select(labels.orientation(True).alias("a"), labels.orientation(False).alias("b")).collect()
    assert all(r.a != r.b for r in rows)


def test_relabel(spark):
    df = spark.createDataFrame([("nt1",), ("NTpg3",), ("NA",), ("TP53",), (None,)], "g string")
    got = [r[0] for r in df.select(labels.relabel(F.col("g"), "NT", ["NA"], ["^nt[0-9]$"], prefixes=["NTpg"])).collect()]
    assert got == ["NT", "NT", "NT", "TP53", None]


def test_mirror_doubles_rows(spark):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    assert {tuple(r) for r in labels.mirror(df).collect()} == {("B", "A", "b1", "a1"), ("A", "B", "a1", "b1")}


def test_ids_are_dense_and_stable(spark):
    df = spark.range(500).select(
        F.lit("x").alias("gene1"), F.lit("y").alias("gene2"), F.col("id").cast("string").alias("guide1"), F.lit("z").alias("guide2")
    )
    one = {r.guide1: r.pg_id for r in labels.construct_ids(df).collect()}
    two = {r.guide1: r.pg_id for r in labels.construct_ids(df.repartition(7)).collect()}
    assert sorted(one.values()) == list(range(1, 501)) and one == two


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([(1.0, None, 3.0)], "a double, b double, c double")
    text = df.select(packed.pack(["a", "b", "c"]).alias("p"))
    assert text.first().p == "1.0;nan;3.0"
    assert tuple(packed.unpack_columns(text, "p", ["x", "y", "z"]).drop("p").first()) == (1.0, None, 3.0)
    assert tuple(packed.unpack_columns(text, "p", ["x", "y", "z"], 0.0).drop("p").first()) == (1.0, 0.0, 3.0)
    names = F.array(*[F.lit(n) for n in ("T0", "E1", "E2", "E3")])
    picked = packed.select_conditions(packed.unpack(F.col("p")), names, F.array(F.lit("E2"), F.lit("E3")))
    assert text.select(picked.alias("v")).first().v == [3.0]


def test_columns_by_name(spark):
    from duoscreen.screen import Layout

    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "`A549.T2A` double, `A549.T2B` double, `HT29.T2A` double, `T0.A549` double")
    layout = Layout.by_token(df.columns, ["A549", "HT29"], "T0.A549")
    assert layout.samples == {"A549": ["A549.T2A", "A549.T2B"], "HT29": ["HT29.T2A"]}
    assert labels.columns_like(df, "T2A$") == ["A549.T2A", "HT29.T2A"]
