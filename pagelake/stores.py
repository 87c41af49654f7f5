"""Files that tasks read and write by themselves, on the stores that Spark's own paths name.

Arrow knows local files, hdfs, s3, gs and abfss by their URIs. Hadoop's names of S3 (s3a, s3n) are mapped here, with the endpoint, region and keys of the
session's `fs.s3a.` settings, those of one bucket (`fs.s3a.bucket.NAME.`) before the general ones. Settings go to tasks inside the function, not into a plan.
Without keys the machines' own credentials are used; keys in Hadoop's credential files aren't read."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession

PREFIX = "fs.s3a."


class Stores:
    """Opens URIs in tasks; made on the driver by `of`."""

    def __init__(self, settings: dict[str, str]):
        self.settings = settings

    @classmethod
    def of(cls, spark: SparkSession) -> Stores:
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        return cls({k: conf.get(PREFIX + k) for k in conf.getPropsWithPrefix(PREFIX)})

    def setting(self, bucket: str, key: str) -> str | None:
        return self.settings.get(f"bucket.{bucket}.{key}") or self.settings.get(key) or None

    def s3_options(self, bucket: str) -> dict:
        """What Arrow's S3 file system is made with for one bucket."""
        get = lambda key: self.setting(bucket, key)
        out = {"access_key": get("access.key"), "secret_key": get("secret.key"), "session_token": get("session.token"), "region": get("endpoint.region")}
        endpoint = get("endpoint")
        if endpoint:
            scheme, _, host = endpoint.rpartition("://")
            out |= {"endpoint_override": host, "scheme": scheme or ("http" if get("connection.ssl.enabled") == "false" else "https")}
            out |= {"region": out["region"] or "us-east-1", "force_virtual_addressing": get("path.style.access") == "false"}
        if "Anonymous" in (get("aws.credentials.provider") or ""):
            out["anonymous"] = True
        return {k: v for k, v in out.items() if v is not None}

    def at(self, uri: str) -> tuple[fs.FileSystem, str]:
        """The file system and the path in it."""
        scheme, _, rest = uri.partition("://")
        if scheme in ("s3a", "s3n"):
            return fs.S3FileSystem(**self.s3_options(rest.split("/", 1)[0])), rest
        return fs.FileSystem.from_uri(uri)
