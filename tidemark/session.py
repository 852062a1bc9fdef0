"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings this package expects: UTC and adaptive execution."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, for functions that run in Python workers there."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shared", False):
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    sc.addPyFile(str(path))
    sc._tidemark_shared = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, an own temporary one in local mode, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: used again without being computed again, and still there when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
