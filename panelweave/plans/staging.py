"""Where a plan is cut: staged tables in the shared folder.

``stage`` writes a frame that several branches of a plan read, so that the expensive part runs once, and
an executor loss costs a re-read instead of a recomputation. How a join runs is left to adaptive execution, which
knows the bytes of both sides.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local master without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="panelweave-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)  # made here, gone with the process
    return _local_roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and file sizes are known."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a large table that some keys ask for. Spark measures the keys when it has them: a few are sent to where the
    table lies, many are shuffled."""
    return big.join(keys.select(*on).distinct(), on, "left_semi")
