import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Rows of a query and of its SQL in DuckDB, over the same tables."""
    import duckdb

    def run(spark, query, sql, sf_dir, tmp_path):
        con = duckdb.connect()
        for name in sorted(os.listdir(sf_dir)):
            if name.endswith(".parquet"):
                con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
        out = str(tmp_path / "out")
        query(spark, sf_dir).write.parquet(out)
        con.execute(f"CREATE VIEW got AS SELECT * FROM '{out}/*.parquet'")
        con.execute(f"CREATE TABLE want AS {sql}")
        names = sorted(r[0] for r in con.execute("DESCRIBE got").fetchall())
        assert names == sorted(r[0] for r in con.execute("DESCRIBE want").fetchall())
        columns = ", ".join(f'"{c}"' for c in names)
        for a, b in (("got", "want"), ("want", "got")):
            extra = con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall()
            assert not extra, f"only in {a}: {extra}"

    return run
