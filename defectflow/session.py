"""Session helpers: a tuned local session and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("defectflow")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors see.

    A machine-local folder is used only in local mode with the setting unset;
    anywhere else a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> None:
    """Write Parquet files, and delete the shuffle files of that write once it has ended.

    Spark would keep them until the driver's JVM happens to collect the plan.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)


def write_and_reread(df, purpose: str):
    """Cut lineage through a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, purpose)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a freshly read input over the cores when it has too few splits.

    Text cleaning and vector work are CPU-bound, and a small file is read as
    one split. Inputs with at least one split per core are returned unchanged,
    so large tables are never shuffled here. Apply to scans only.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if splits >= cores else scan.repartition(cores)
