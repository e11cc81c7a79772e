"""Session settings the engine is designed for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution coalesces and splits shuffle partitions at run time. Rows that
# carry whole series arrays go to Python in small Arrow batches.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # recording a Python call site per column operation slows the building of large plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "tideloom", memory: str = "8g", **extra) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    b = b.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    b = b.config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false")
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parallelism(spark: SparkSession) -> int:
    """Partitions for compute-heavy stages: all cores, or more when the session asks for more."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions", "1"))  # 1 where it is not set
    return max(spark.sparkContext.defaultParallelism, asked)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; where it names none, one in the warehouse.

    Both are storage that the driver and all executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tideloom-work"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    path = f"{shared_folder(df.sparkSession)}/tideloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
