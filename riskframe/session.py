"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches: the cluster's checkpoint folder.

    Only where none is named, as in local tests, a temporary one is set.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a shared folder")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="riskframe-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def local_session(cores: int = 8, name: str = "riskframe", memory: str = "8g") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
