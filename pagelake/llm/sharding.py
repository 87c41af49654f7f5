"""Sharding (7, native): fixed virtual slots with a versioned slot-to-shard map.

Every record is hashed into one of `n_slots` virtual slots, which never change. Bytes and rows are summed per slot (a
table of at most `n_slots` rows, whatever the input), and a map from all slots to shards is stored. Version 1 gives
each shard an equal run of slots. Rebalancing edits it into the next version: taken from the heaviest slot down, a slot stays at
home while its shard keeps within the mean size, and the slots left over go to the lightest shard each. Records are never
hashed anew. Each version lies in a folder of its own, so that earlier ones stay readable.

A map has every slot, those without rows too, so any version can place any table: no row is lost when the table has grown. A
record's place in its shard is the number of rows of the table at hand in the shard's earlier slots plus its rank inside its
own slot, so no task ever sees more than one slot.

Rows that are equal in id and text are counted before they are dealt; each run of `REPEATS` of them is hashed on its own, so
copies of one row are spread over the slots and make no slot hot.

Defined results: null text counts as empty (size 1, crc32 0); rows with equal ids, texts and sizes get places of their own;
a null id is hashed like any value; an empty table gives an empty table; a map without the slot of some row is an error; other
columns are left aside.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.llm.common import col

N_SLOTS, REPEATS = 4096, 16
MAP = "vslot int, bytes long, rows long, shard int, version int"


def slot_of(n_slots: int) -> Column:
    """The virtual slot of a run of equal rows; the text's checksum also counts, so that rows that share an id are spread."""
    return F.pmod(F.xxhash64("_id", "text_crc32", "size", "_run"), F.lit(n_slots)).cast("int")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """_id, size, text_crc32, _n, _run, vslot of runs of `_n` equal rows; texts go no further."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = df.select(col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    equal = rows.groupBy("_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_rows"))
    runs = equal.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / REPEATS))))
    runs = runs.withColumn("_n", F.least(F.lit(REPEATS).cast("long"), F.col("_rows") - F.col("_run") * REPEATS)).drop("_rows")
    return runs.withColumn("vslot", slot_of(n_slots))


def slot_sizes(runs: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has any."""
    return runs.groupBy("vslot").agg(F.sum(F.col("size") * F.col("_n")).alias("bytes"), F.sum("_n").alias("rows"))


def whole(spark: SparkSession, sizes: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """The sizes of all slots, 0 for those without rows."""
    every = spark.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(sizes), "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def first_map(sizes: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: equal runs of slots, whatever they hold."""
    return whole(sizes.sparkSession, sizes, n_slots).select("vslot", "bytes", "rows", F.floor(F.col("vslot") * n_shards / n_slots).cast("int").alias("shard"), F.lit(1).alias("version"))


def resized(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """A stored map with the sizes of a table as it is now; shards and version stay."""
    now = sizes.select(F.col("vslot").alias("_slot"), F.col("bytes").alias("_bytes"), F.col("rows").alias("_rows"))
    joined = slot_map.join(F.broadcast(now), F.col("vslot") == F.col("_slot"), "left")
    return joined.select("vslot", F.coalesce("_bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("_rows", F.lit(0)).cast("long").alias("rows"), "shard", "version")


def rebalanced(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map: moves as few bytes as the equal sizes need. One row of at most n_slots entries is folded."""
    one = slot_map.agg(
        F.expr("array_sort(collect_list(struct(-bytes AS neg, vslot, bytes, rows, shard)))").alias("slots"),
        F.ceil(F.sum("bytes") / n_shards).alias("target"),
        F.max("version").alias("version"),
    )
    # the folds carry loads and shard numbers, nothing else: what they append to is copied at each step
    loads = f"transform(sequence(0, {n_shards - 1}), i -> 0L)"
    add = "transform(acc.loads, (v, i) -> if(i = {to}, v + x.bytes, v))"
    stay = f"x.shard < {n_shards} AND acc.loads[x.shard] + x.bytes <= target"
    none = "CAST(array() AS ARRAY<INT>)"
    at_home = f"""aggregate(slots, named_struct('loads', {loads}, 'to', {none}), (acc, x) -> CASE WHEN {stay}
        THEN named_struct('loads', {add.format(to="x.shard")}, 'to', array_append(acc.to, x.shard)) ELSE named_struct('loads', acc.loads, 'to', array_append(acc.to, -1)) END)"""
    lightest = "CAST(array_position(acc.loads, array_min(acc.loads)) - 1 AS INT)"
    over = "filter(slots, (x, i) -> home.to[i] = -1)"
    moved = f"aggregate({over}, named_struct('loads', home.loads, 'to', {none}), (acc, x) -> named_struct('loads', {add.format(to=lightest)}, 'to', array_append(acc.to, {lightest}))).to"
    placed = one.withColumn("home", F.expr(at_home)).withColumn("moved", F.expr(f"map_from_arrays(transform({over}, x -> x.vslot), {moved})"))
    rows = placed.select(F.posexplode("slots").alias("i", "x"), "home.to", "moved", (F.col("version") + 1).alias("version"))
    return rows.select("x.vslot", "x.bytes", "x.rows", F.coalesce(F.try_element_at("moved", F.col("x.vslot")), F.get("to", F.col("i"))).alias("shard"), "version")


def store_map(slot_map: DataFrame, folder: str, version: int | None = None) -> int:
    """Keeps a version of the map in its own folder and returns its number; a version that is there already is an error. Without the number the map is worked out once more for it."""
    version = slot_map.agg(F.max("version")).first()[0] if version is None else version
    slot_map.coalesce(1).write.parquet(f"{folder}/version-{version}")
    return version


def stored_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A version of the map, as it was stored."""
    try:
        return spark.read.schema(MAP).parquet(f"{folder}/version-{version}")
    except AnalysisException as e:
        raise ValueError(f"no version {version} of the map in {folder}") from e


def shard_rows(df: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Every row's shard and its place there, by a map of at most `n_slots` rows (the bound that allows the broadcasts).

    Places are counted in the table at hand, whatever table the map was made for."""
    runs = measured(df, id_col, text_col, n_slots)
    shards = slot_map.select(F.col("vslot").alias("_slot"), "shard", F.col("version").alias("map_version"))
    counts = slot_sizes(runs).join(F.broadcast(shards), F.col("vslot") == F.col("_slot"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("_slot", "shard", "map_version", before.alias("_before"))  # sums of at most n_slots rows
    earlier = F.sum("_n").over(Window.partitionBy("vslot").orderBy("_id", "text_crc32", "size", "_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_inside", F.coalesce(earlier, F.lit(0)))
    found = runs.join(F.broadcast(placed), F.col("vslot") == F.col("_slot"), "left")
    found = found.withColumn("shard", F.when(F.col("shard").isNull(), F.raise_error(F.concat(F.lit("the map has no slot "), F.col("vslot").cast("string"))).cast("int")).otherwise(F.col("shard")))
    rows = found.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return rows.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_inside") + F.col("_copy")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )
