"""Sessions, and the package on the workers' import path."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "evidra", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, unless their PYTHONPATH already has it."""
    sc, top = spark.sparkContext, Path(__file__).resolve().parent.parent
    if str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_evidra_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="evidra-")) / "evidra.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((top / "evidra").rglob("*.py")):
            z.write(f, f.relative_to(top))
    sc.addPyFile(str(path))
    sc._evidra_shipped = True


def _shared(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, set if it wasn't; a local session without one gets its own."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="evidra-")
        spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off its lineage in the session's shared checkpoint folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df cut off its lineage as Parquet in the shared checkpoint folder, where it is much smaller than a checkpoint."""
    path = f"{_shared(df.sparkSession)}/evidra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
