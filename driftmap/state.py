"""Where state is kept between writes: the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (tests) is a folder of our own set where the session names none.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="driftmap-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage is cut and lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
