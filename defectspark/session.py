"""Session helpers shared by the benchmark, the tests and the iterative operators."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "defectspark") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    shuffle = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


@functools.cache
def _own_folder() -> str:
    """One temporary folder per process, gone when it ends."""
    path = tempfile.mkdtemp(prefix="defectspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables between steps, below ``spark.checkpoint.dir`` and there below one folder per application.

    Only a single-machine session (a test) that leaves the setting out gets a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/run-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: later steps and lost executors start from the files."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
