"""Spending: estimates before, admission in page order, the check after."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagelake.operators.store import observed, there

WAVE = "wave long, pages long, cost_usd decimal(38,12), errors long"


class BudgetExceeded(RuntimeError):
    """The pages' cost is, or would be, more than the cap."""


def zero_of(df: DataFrame, cost: str) -> Column:
    """0 in the type of a cost column: decimals stay exact."""
    return F.lit(0).cast(df.schema[cost].dataType)


def total_cost(silver: DataFrame) -> float | Decimal:
    """A Decimal if the costs are."""
    return silver.agg(F.coalesce(F.sum("cost_usd"), zero_of(silver, "cost_usd"))).first()[0]


def check_cap(cost: float | Decimal, cap: float | Decimal | None, when: str = "the run") -> None:
    """A cost equal to the cap is within it. A decimal cost is compared with the cap as it is written."""
    if cap is not None and cost > (Decimal(str(cap)) if isinstance(cost, Decimal) else cap):
        raise BudgetExceeded(f"{when} costs ${cost:.4f}, more than ${cap:.4f}")


def running_cost(pages: DataFrame, cost: str = "cost_usd", doc: str = "path", page: str = "page_num", ranges: int = 256) -> DataFrame:
    """Adds running_usd, the sum over all pages up to this one in the order of documents and pages (a null cost is 0).

    No window holds all pages: documents are dealt into `ranges` ranges by cut points; only the ranges' sums pass through one task,
    documents are summed inside their range and pages inside their document."""
    kind = pages.schema[doc].dataType
    zero = zero_of(pages, cost)
    usd = F.coalesce(F.col(cost), zero)
    docs = pages.groupBy(doc).agg(F.sum(usd).alias("_doc_usd"))
    if kind.typeName() in ("long", "integer", "short", "byte"):
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.agg(F.percentile_approx(doc, shares, 100 * ranges).alias("c")).first()["c"] or []))
        part = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < F.col(doc))) if cuts else F.lit(0)
    else:
        cuts = [r[0] for r in docs.select(doc).sample(False, min(1.0, 64.0 * ranges / max(1, docs.count())), seed=7).orderBy(doc).collect()]  # bounded by the rate
        cuts = cuts[:: max(1, len(cuts) // ranges)]
        part = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(doc))) if cuts else F.lit(0)
    docs = docs.withColumn("_part", part)
    before_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = docs.groupBy("_part").agg(F.sum("_doc_usd").alias("_part_usd")).withColumn("_before_part", F.coalesce(F.sum("_part_usd").over(before_part), zero))
    before_doc = Window.partitionBy("_part").orderBy(doc).rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("_before_doc", F.coalesce(F.sum("_doc_usd").over(before_doc), zero)).join(F.broadcast(parts), "_part")
    starts = placed.select(F.col(doc).alias("_doc"), (F.col("_before_part") + F.col("_before_doc")).alias("_start"))
    inside = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    summed = pages.withColumn("_inside", F.sum(usd).over(inside))
    return summed.join(starts, F.col(doc).eqNullSafe(F.col("_doc"))).withColumn("running_usd", F.col("_start") + F.col("_inside")).drop("_doc", "_start", "_inside")


def in_waves(pages: DataFrame, wave_usd: float, cost: str = "planned_usd", doc: str = "path", page: str = "page_num") -> DataFrame:
    """Adds wave, from 0: pages in the order of documents and pages, cut where their planned cost has come to another `wave_usd`."""
    if not wave_usd > 0:
        raise ValueError("a wave must have room for some cost")
    placed = running_cost(pages, cost, doc, page)
    before = (F.col("running_usd") - F.coalesce(F.col(cost), zero_of(pages, cost))).cast("double")
    return placed.withColumn("wave", F.floor(before / wave_usd + 1e-9).cast("long")).drop("running_usd")


def run_in_waves(pages: DataFrame, call: Callable[[DataFrame], DataFrame], folder: str, cap: float, wave_usd: float, cost: str = "planned_usd", doc: str = "path", page: str = "page_num") -> tuple[DataFrame, list[dict]]:
    """Calls the model wave by wave as long as the true cost so far is within the cap: (silver with `wave`, a record a wave).

    Each wave is one job over its pages, which writes them below `folder`; its true cost is observed while it is written. A wave is let go only if the waves before it
    have cost no more than the cap, so the spend is beyond the cap by less than one wave's true cost, however wrong the plan is. `call` takes pages (without `wave`) and
    returns silver rows. Waves follow each other on the driver, their number is planned cost / wave_usd. Pages are written once, in the order of waves, in as many files as
    the session has shuffle partitions, however many waves there are: a wave reads the files that hold it, and of these the row groups. The driver knows the first and the
    last wave of each file. A run that was stopped goes on where it ended: waves whose record is in `folder` aren't called again."""
    spark = pages.sparkSession
    at = f"{folder}/pages"
    if not there(spark, f"{at}/_SUCCESS"):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        in_waves(pages, wave_usd, cost, doc, page).repartitionByRange(n, "wave", doc, page).sortWithinPartitions("wave").write.parquet(at)
    schema = StructType([*pages.schema.fields, StructField("wave", LongType())])
    rows = spark.read.schema(schema).parquet(at)
    files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("wave").alias("first"), F.max("wave").alias("last")).collect()
    done = {r["wave"]: r.asDict() for r in spark.read.schema(WAVE).json(f"{folder}/records").collect()} if there(spark, f"{folder}/records") else {}
    records, spent = [], Decimal(0)
    wave = min((f["first"] for f in files), default=None)
    while wave is not None and spent <= Decimal(str(cap)):
        held = [f["file"] for f in files if f["first"] <= wave <= f["last"]]
        record = done.get(wave)
        if record is None:
            own = spark.read.schema(schema).parquet(*held).where(F.col("wave") == wave).drop("wave")
            silver, seen = observed(call(own), "wave")
            silver.write.mode("overwrite").parquet(f"{folder}/silver/wave={wave}")
            record = {"wave": wave, "pages": seen.get["pages"], "cost_usd": round(Decimal(str(seen.get["cost_usd"])), 12), "errors": seen.get["errors"]}
            spark.createDataFrame([record], WAVE).coalesce(1).write.mode("append").json(f"{folder}/records")
        records.append(record)
        spent += record["cost_usd"]
        wave = _next_wave(spark, files, schema, wave)
    written = [f"{folder}/silver/wave={r['wave']}" for r in records]
    if not written:
        return call(rows.drop("wave")).withColumn("wave", F.lit(0).cast("long")).where("false"), records
    return spark.read.option("basePath", f"{folder}/silver").parquet(*written).withColumn("wave", F.col("wave").cast("long")), records


def _next_wave(spark: SparkSession, files: list, schema: StructType, wave: int) -> int | None:
    """The least wave after this one that has pages: a page that costs more than a wave leaves the next ones empty."""
    later = [f for f in files if f["last"] > wave]
    if not later:
        return None
    first = min(max(f["first"], wave + 1) for f in later)
    if any(f["first"] == first for f in later):
        return first
    inside = [f["file"] for f in later if f["first"] <= wave]  # at most the files that hold this wave and go on
    after = min((f["first"] for f in later if f["first"] > wave), default=None)
    found = spark.read.schema(schema).parquet(*inside).where(F.col("wave") > wave).agg(F.min("wave")).first()[0]
    return found if after is None else min(found, after)


def admit(pages: DataFrame, cap: float | Decimal, cost: str = "cost_usd", doc: str = "path", page: str = "page_num") -> DataFrame:
    """The pages whose running cost stays within the cap."""
    return running_cost(pages, cost, doc, page).where(F.col("running_usd") <= _cap_of(pages, cap, cost)).drop("running_usd")


def _cap_of(pages: DataFrame, cap: float | Decimal, cost: str) -> Column:
    return F.lit(Decimal(str(cap))) if pages.schema[cost].dataType.typeName() == "decimal" else F.lit(float(cap))


def preflight(pages: DataFrame, usd_per_page: float, cap: float | None) -> float:
    """The planned cost of all pages; BudgetExceeded if that is beyond the cap, before any call is made."""
    planned = pages.count() * usd_per_page
    check_cap(planned, cap, "the plan")
    return planned


def calibrated_page_cost(silver: DataFrame, fallback: float) -> float:
    """USD a page as earlier good pages came to, or the fallback."""
    seen = silver.where("error IS NULL").agg(F.avg("cost_usd")).first()[0]
    return fallback if seen is None else float(seen)
