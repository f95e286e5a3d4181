"""Sessions, and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The least engine settings; a cluster's own values win where they are set before.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(app: str = "noteloom", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session, for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.appName(app).master(f"local[{cores}]").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder of its own; on a cluster a machine's own
    folder would be lost with the machine, so a missing setting is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        # local and local[n] are one process; local-cluster is several
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(spark, "_noteloom_dir", None)
        if path is None:
            folder = tempfile.mkdtemp(prefix="noteloom-")
            atexit.register(shutil.rmtree, folder, True)
            path = spark._noteloom_dir = f"file://{folder}"
    return path


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below the application's own."""
    return f"{shared_dir(spark).rstrip('/')}/noteloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that outlives any executor."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """One of the supplied tables.

    heavy: for work that costs far more than moving the rows. A file that can't be split would leave most cores idle,
    so a scan of no more than half as many partitions as there are cores is spread over them; larger scans, which are
    all that matter at scale, stay as they are.
    """
    d = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(cores) if heavy and 2 * d.rdd.getNumPartitions() <= cores else d


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote between its steps; no plan that reads it may be run afterwards.

    Plans are lazy, so only the caller knows when a result was used up: between two jobs, or before it stops.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/noteloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
