"""Sessions: local ones for development, and the object-store settings."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the engine's results rely on.
NEEDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",  # base64 without line breaks
    "spark.speculation": "false",  # a second copy of a task would call a paid model again
    "spark.sql.adaptive.enabled": "true",
}


def s3_options(endpoint: str | None = None, access_key: str | None = None, secret_key: str | None = None, path_style: bool = True) -> dict[str, str]:
    """Hadoop settings of an S3-compatible store. Keys go into the session's settings only, never into a plan."""
    pre = "spark.hadoop.fs.s3a"
    out = {f"{pre}.path.style.access": str(path_style).lower(), f"{pre}.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem"}
    if endpoint:
        out |= {f"{pre}.endpoint": endpoint, f"{pre}.connection.ssl.enabled": str(endpoint.startswith("https")).lower()}
    if access_key and secret_key:
        out |= {
            f"{pre}.access.key": access_key,
            f"{pre}.secret.key": secret_key,
            f"{pre}.aws.credentials.provider": "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider",
        }
    return out


def get_spark(
    app_name: str = "pagelake", cores: str = "*", memory: str = "4g", shuffle_partitions: int = 8, batch_size: int | None = None, delta: bool = False, s3: dict[str, str] | None = None
) -> SparkSession:
    """A local session. `batch_size`: rows an Arrow batch; `delta`: the table format's extension, whose jars must be at hand."""
    conf = NEEDED | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.pyspark.python": sys.executable, "spark.pyspark.driver.python": sys.executable}
    if batch_size:
        conf["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_size)
    if delta:
        conf |= {"spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension", "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog"}
    conf |= s3 or {}
    return SparkSession.builder.master(f"local[{cores}]").appName(app_name).config("spark.driver.memory", memory).config(map=conf).getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Puts the package's folder on the Python workers' path, for sessions that were started elsewhere on this machine.

    On a cluster the package comes by --py-files, and a path that a worker doesn't have does no harm."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def prepare(spark: SparkSession) -> SparkSession:
    """Sets what the results rely on where the session allows it."""
    share_package(spark)
    for key in ("spark.sql.session.timeZone", "spark.sql.chunkBase64String.enabled"):
        spark.conf.set(key, NEEDED[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without: it gets an own one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pagelake-")
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{os.path.abspath(at)}"
