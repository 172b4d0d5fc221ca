import pytest
from pyspark.sql import SparkSession, functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("spanguard-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from {path: text}, or from rows (repo, scan_id, path, text)."""
    from spanguard.sources.tables import load_documents

    def build(files, repo="r", scan_id=1):
        rows = [(repo, scan_id, p, t) for p, t in files.items()] if isinstance(files, dict) else files
        raw = spark.createDataFrame(rows, "repo string, scan_id bigint, path string, body string")
        return load_documents(raw, F.col("repo"), F.col("scan_id"), F.col("path"), F.col("body"))

    return build


@pytest.fixture(scope="session")
def values(spark):
    """Apply a column function to a list of values."""
    def run(function, items, kind="string"):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
        return [r[1] for r in df.select("i", function(F.col("v"))).orderBy("i").collect()]

    return run
