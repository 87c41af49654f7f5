"""What the operators of this subpackage share: tables, the cluster's shared folder, materialised cuts."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import share_package, shared_dir

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The folders that `written` has made since the innermost open scope began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


#: Of this Python worker: which operator holds large tables, and how they are let go.
_holders: dict[str, Callable[[], None]] = {}


def claim(holder: str, clear: Callable[[], None]) -> None:
    """Called in a worker by an operator that keeps tables from task to task: those of all other operators go, as workers serve one after the other.

    The memory goes back to the system, too, where the C library can do that."""
    others = [x for x in _holders if x != holder]
    for other in others:
        _holders.pop(other)()
    _holders[holder] = clear
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; any path that Spark can read."""
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(typed: list[tuple[str, T.DataType]], rest: str = "") -> T.StructType:
    """A schema of columns of given types, and of others as DDL text. Types that the caller's tables bring aren't written as text: their fields may have any names."""
    return T.StructType([*(T.StructField(name, kind) for name, kind in typed), *(T.StructType.fromDDL(rest).fields if rest else ())])


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


#: Places of a bitmap that is broadcast: 16 MB in rows of 4 KB, whatever the input.
BITS = 1 << 27


def marked(rows: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """Adds `maybe` to rows, by a bitmap of the hashes in `members`' one column: where it is false, `key` isn't among them.

    A few others are taken for members; what needs certainty joins the rows that are left."""
    place = F.pmod(F.xxhash64(members.columns[0]), F.lit(BITS))
    bits = members.select(place.alias("_x")).groupBy(F.bitmap_bucket_number("_x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("_bitmap"))
    found = rows.withColumn("_x", F.pmod(F.xxhash64(key), F.lit(BITS))).join(F.broadcast(bits), F.bitmap_bucket_number("_x") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(F.bitmap_bit_position("_x") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = found.withColumn("_byte", byte).withColumn("maybe", F.coalesce(F.expr("shiftright(_byte, cast(bitmap_bit_position(_x) % 8 as int)) & 1") == 1, F.lit(False)))
    return found.drop("_x", "_bucket", "_bitmap", "_byte")


#: A key is hot if one row in so many has it, so there are at most as many hot keys.
HOT_SHARE = 1000


def with_found(rows: DataFrame, keys: list[str], found: DataFrame, n: str) -> DataFrame:
    """Left join of rows to `found` (one row a key; `n`: how many of `rows` have that key). Both are written tables.

    Hot keys are met by a broadcast of at most HOT_SHARE rows, whatever the input; of any other key less than 1 / HOT_SHARE of all rows are dealt to one task."""
    total = rows.count()
    hot = F.col(n) * HOT_SHARE >= total
    renamed = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    drop = [f"_{k}" for k in keys]
    top = F.broadcast(renamed.where(hot))
    met = rows.join(top, same, "inner").drop(*drop)
    rest = rows.join(F.broadcast(renamed.where(hot).select(*drop)), same, "left_anti").join(renamed.where(~hot), same, "left").drop(*drop)
    return met.unionByName(rest)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows by keys to all of the session's shuffle partitions: a given number isn't coalesced by bytes, of which joins take few and much time for each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 2 << 20) -> Iterator[None]:
    """Arrow batches by bytes, not by ten thousand texts, for what runs inside: Python workers and their batches share an executor's memory."""
    share_package(spark)
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(most_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it again: the lineage is cut, and a lost executor loses nothing.

    The folder goes with the innermost `scratch`; outside one it stays, as the table that is returned reads it."""
    path = fresh(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes the folders made inside when it ends, but for those that the tables put into the yielded list read.

    These belong to the scope around it from then on."""
    outer, own, kept = _made.get(), [], []
    token = _made.set(own)
    try:
        yield kept
    finally:
        _made.reset(token)
        files = [f for df in kept for f in df.inputFiles()]
        held = {path for path in own if any(path.rsplit("/", 1)[1] in f for f in files)}
        if outer is not None:
            outer += held
        removed(spark, [path for path in own if path not in held])


def removed(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
