import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def constructs(spark):
    """24 genes-by-guides constructs with controls, one cell line with two replicates."""
    import random

    rng = random.Random(5)
    genes = ["CTRL", "A", "B", "C"]
    rows = []
    for g1 in genes:
        for g2 in genes:
            for i in range(2):
                for j in range(2):
                    early = rng.randint(50, 150)
                    rows.append((g1, g2, f"{g1}.{i}", f"{g2}.{j}", float(early), *[float(rng.randint(5, 200)) for _ in range(2)]))
    return spark.createDataFrame(rows, "gene1 string, gene2 string, guide1 string, guide2 string, t0 double, r1 double, r2 double")
