"""Session and table helpers shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read lazily so that filters and columns are pushed down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "quillmark", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    build = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g").config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for k, v in conf.items():
        build = build.config(k, v)
    return build.getOrCreate()
