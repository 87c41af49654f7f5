"""Storage of silver and bronze tables: snapshots with a pointer, upserts, resume, the cost ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class AmbiguousMerge(ValueError):
    """A target row is matched by more than one source row."""


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The table at `path`: its current snapshot if it has any."""
    current = pointer(spark, path)
    return spark.read.format(fmt).load(f"{path}/{current}" if current else path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema("name string, n long").json(f"{path}/_pointer") if there(spark, f"{path}/_pointer") else None


def pointer(spark: SparkSession, path: str) -> str | None:
    """The current snapshot's folder name."""
    known = _pointers(spark, path)
    row = known.orderBy(F.col("n").desc()).first() if known is not None else None
    return row["name"] if row else None


def exists(spark: SparkSession, path: str) -> bool:
    return pointer(spark, path) is not None


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """A new snapshot beside the old ones; readers see it once the pointer names it. One writer at a time."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options or {}).save(f"{path}/{name}")
    known = _pointers(spark, path)
    n = known.agg(F.max("n")).first()[0] if known is not None else None
    spark.createDataFrame([(name, (n or 0) + 1)], "name string, n long").coalesce(1).write.mode("append").json(f"{path}/_pointer")
    return spark.read.format(fmt).load(f"{path}/{name}")


def check_single(target: DataFrame, source: DataFrame, keys: list[str]) -> None:
    """Two source rows that match one target row are an error, as in MERGE; the check costs one aggregate over the keys."""
    several = source.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").join(target.select(*keys), keys, "left_semi")
    if not several.isEmpty():
        raise AmbiguousMerge(f"more than one source row for the same {', '.join(keys)}")


def upserted(target: DataFrame, source: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Target rows without a source row of the same keys, and all source rows. Null keys match nothing, so such rows are added."""
    if check:
        check_single(target, source, keys)
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def write_silver(df: DataFrame, path: str, merge_keys: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Without keys, or without a table yet: the new rows are the table. With both: an upsert."""
    if merge_keys and exists(df.sparkSession, path):
        df = upserted(read_table(df.sparkSession, path, fmt), df, merge_keys)
    return write_snapshot(df, path, fmt)


def observed(df: DataFrame, name: str = "silver") -> tuple[DataFrame, Observation]:
    """Silver rows that count themselves while they are written: pages, cost_usd, errors, failed (errors with a text), prompt and completion tokens.

    `observation.get` has them after the first action, without a second job over the rows; empty tables give zeros."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    usd = F.coalesce(F.sum("cost_usd"), F.lit(0).cast(df.schema["cost_usd"].dataType))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    failed = F.count(F.when(F.col("error").isNotNull() & (F.col("error") != ""), 1)).alias("failed")
    return df.observe(seen, F.count(F.lit(1)).alias("pages"), usd.alias("cost_usd"), F.count("error").alias("errors"), failed, *sums), seen


def write_observed(df: DataFrame, path: str, merge_keys: list[str] | None = None, fmt: str = "parquet") -> tuple[DataFrame, dict]:
    """write_silver, and what the new rows came to, from the one job that writes them. A task that runs again after a loss may be counted twice."""
    rows, seen = observed(df)
    if merge_keys and exists(df.sparkSession, path):
        target = read_table(df.sparkSession, path, fmt)
        check_single(target, df, merge_keys)  # over keys alone; the observed rows are used once
        rows = target.join(df.select(*merge_keys).distinct(), merge_keys, "left_anti").unionByName(rows)
    return write_snapshot(rows, path, fmt), seen.get


# ---------------------------------------------------------------- tables in hash buckets of their key

BUCKET = "_bucket"


def bucket_of(keys: list[str], n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")


def bucket_layout(spark: SparkSession, path: str) -> tuple[list[str], int] | None:
    """The keys and the number of buckets of the table at `path`; None if there is no such table."""
    row = spark.read.schema("keys array<string>, n_buckets int").json(f"{path}/_layout").first() if there(spark, f"{path}/_layout") else None
    return (row["keys"], row["n_buckets"]) if row else None


def _write_buckets(df: DataFrame, path: str, keys: list[str], n_buckets: int, files: int) -> None:
    """Replaces the buckets that `df` has rows of, and no others."""
    rows = df.withColumn(BUCKET, bucket_of(keys, n_buckets))
    part = F.pmod(F.xxhash64(F.lit(BUCKET), *keys), F.lit(files))
    rows = rows.repartition(BUCKET) if files == 1 else rows.repartition(F.col(BUCKET), part)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def write_buckets(df: DataFrame, path: str, keys: list[str], n_buckets: int = 64, files: int = 1) -> DataFrame:
    """A new table in `n_buckets` folders by a hash of its keys, up to `files` files in each. Choose them by the table's size: an upsert rewrites whole buckets."""
    if bucket_layout(df.sparkSession, path) is not None:
        raise ValueError(f"there is a table at {path}")
    _write_buckets(df, path, keys, n_buckets, files)
    df.sparkSession.createDataFrame([(keys, n_buckets)], "keys array<string>, n_buckets int").coalesce(1).write.json(f"{path}/_layout")
    return read_buckets(df.sparkSession, path, df.schema)


def read_buckets(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table's rows. A condition on all keys by `only_key` reads one bucket."""
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())]))
    return reader.parquet(path).drop(BUCKET)


def only_key(spark: SparkSession, path: str, values: dict) -> DataFrame:
    """The rows of one key: their bucket alone is read."""
    keys, n_buckets = bucket_layout(spark, path)
    if set(values) != set(keys):
        raise ValueError(f"give all of {', '.join(keys)}")
    table = spark.read.parquet(path)
    same = [F.lit(values[k]).cast(table.schema[k].dataType) for k in keys]
    number = spark.range(1).select(F.pmod(F.xxhash64(*same), F.lit(n_buckets))).first()[0]
    found = table.where(F.col(BUCKET) == number)
    for k, v in zip(keys, same, strict=True):
        found = found.where(F.col(k) == v)
    return found.drop(BUCKET)


def upsert_buckets(source: DataFrame, path: str, files: int = 1, check: bool = True) -> list[int]:
    """Source rows replace the table's rows of the same keys and are added where there are none; the buckets that it touches are returned.

    Only these are read (as partitions) and written (by dynamic partition overwrite); the files of all others stay. At most one number a bucket goes through the
    driver. The new files are complete before any old one goes; one writer at a time. Null keys match nothing, so such rows are added."""
    spark = source.sparkSession
    layout = bucket_layout(spark, path)
    if layout is None:
        raise ValueError(f"there is no table at {path}")
    keys, n_buckets = layout
    touched = sorted(r[0] for r in source.select(bucket_of(keys, n_buckets)).distinct().collect())
    if touched:
        table = spark.read.parquet(path)
        rows = source.select(*(F.col(f.name).cast(f.dataType) for f in table.schema if f.name != BUCKET))
        target = table.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        _write_buckets(upserted(target, rows, keys, check), path, keys, n_buckets, files)
    return touched


def save_table(df: DataFrame, name: str) -> None:
    """A catalogue table, replaced together with its schema."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)


def save_bucketed(df: DataFrame, name: str, keys: list[str], n_buckets: int = 64, path: str | None = None) -> DataFrame:
    """A catalogue table whose files are dealt and sorted by `keys`: joins and aggregates over the keys of two such tables (of as many buckets) move no rows.

    Rows are dealt by the same hash first, so that each bucket is one file, already sorted. With a path the table's files lie there."""
    writer = df.repartition(n_buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(n_buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_clustered(df: DataFrame, path: str, keys: tuple[str, ...] = ("path", "page_num"), files: int | None = None, row_group_bytes: int | None = None) -> DataFrame:
    """A snapshot whose files are ranges of the keys' order, sorted inside: Parquet's statistics leave out all but the row groups that a lookup asks for.

    Names of pages that follow each other also compress better so. `row_group_bytes`: smaller groups prune finer and cost more footers."""
    spark = df.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    options = {} if row_group_bytes is None else {"parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": "2000"}
    return write_snapshot(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys), path, options=options)


def as_view(df: DataFrame, name: str = "silver") -> DataFrame:
    """A temporary view, for SQL over silver rows."""
    df.createOrReplaceTempView(name)
    return df


def write_bronze(pages: DataFrame, path: str, extracted_at: str | None = None) -> DataFrame:
    """Rendered pages with the time of extraction, so that a retry needn't render again."""
    ts = F.current_timestamp() if extracted_at is None else F.lit(extracted_at).cast("timestamp")
    return write_snapshot(pages.withColumn("extracted_at", ts), path)


def pending(pages: DataFrame, silver: DataFrame, keys: tuple[str, ...] = ("path", "page_num"), retry_failed: bool = True) -> DataFrame:
    """Pages without a result yet (or without a good one)."""
    done = silver.where("error IS NULL") if retry_failed else silver
    return pages.join(done.select(*keys).distinct(), list(keys), "left_anti")


def latest(attempts: DataFrame, keys: tuple[str, ...] = ("path", "page_num"), at: str = "processed_at") -> DataFrame:
    """The last attempt for each key: an aggregate, which sums up before it shuffles."""
    rest = [c for c in attempts.columns if c not in keys]
    best = attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(attempts.columns)


def ledger_rows(silver: DataFrame, at: str | None = None) -> DataFrame:
    """ts, model, pages, cost_usd: what a silver table has cost by model."""
    ts = F.date_format(F.current_timestamp() if at is None else F.lit(at).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return silver.groupBy("model").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("cost_usd"), F.lit(0).cast(silver.schema["cost_usd"].dataType)).alias("cost_usd")).select(ts.alias("ts"), "model", "pages", "cost_usd")


def record_costs(silver: DataFrame, path: str, at: str | None = None) -> DataFrame:
    """Appends to the ledger table and returns all of it."""
    ledger_rows(silver, at).coalesce(1).write.mode("append").parquet(path)
    return silver.sparkSession.read.parquet(path)
