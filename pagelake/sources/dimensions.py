"""Dimension tables: ground truth, anchors, canned results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.text import base_name
from pagelake.operators.store import there
from pagelake.schema import OCR_SCHEMA, OCROutput
from pagelake.sources.files import write_files


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, page_num, gt) of a folder of Markdown files: <stem>_p<N>.md for a page, <stem>.md for a whole document.

    A file named like a page also counts as the document of that full name."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.regexp_replace(base_name(F.input_file_name()), r"\.md$", "").alias("name"), F.col("value").alias("gt"))
    page = F.regexp_extract("name", r"^(.+)_p(\d+)$", 2)
    by_page = files.where(page != "").select(F.regexp_extract("name", r"^(.+)_p(\d+)$", 1).alias("stem"), page.cast("int").alias("page_num"), "gt")
    return by_page.unionByName(files.select(F.col("name").alias("stem"), F.lit(None).cast("int").alias("page_num"), "gt"))


#: What Spark has for null in a partition's folder, and the characters that it writes there as %XX.
NO_VALUE, ESCAPED = "__HIVE_DEFAULT_PARTITION__", "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^"


def folder_value(value: Column) -> Column:
    """A value as Spark's partitionBy names its folder."""
    text = value.cast("string")
    for c in ESCAPED:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(text.isNull() | (text == ""), NO_VALUE).otherwise(text)


def write_ground_truth(truth: DataFrame, folder: str) -> None:
    """Truths (stem, page_num or null, gt) as text files in folders of their stem and page, as Spark's partitionBy lays them out, but written by tasks without a
    commit for each. Several truths of one page share a file, a line each."""
    if there(truth.sparkSession, folder):
        raise FileExistsError(f"there is something at {folder}")
    pages = truth.groupBy("stem", "page_num").agg(F.array_sort(F.collect_list(F.coalesce("gt", F.lit("")))).alias("gt"))
    name = F.concat(F.lit("stem="), folder_value(F.col("stem")), F.lit("/page_num="), folder_value(F.col("page_num")), F.lit("/part-0.txt"))
    write_files(pages.select(name.alias("name"), F.encode(F.concat(F.array_join("gt", "\n"), F.lit("\n")), "UTF-8").alias("body")), folder)


def ground_truth_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, page_num, gt) of what write_ground_truth has written. Files of other names than Spark's are left out."""
    reader = spark.read.schema("value string, stem string, page_num int").option("pathGlobFilter", "part-*.txt")
    found = reader.text(folder, wholetext=True)
    return found.select("stem", "page_num", F.left("value", F.greatest(F.length("value") - 1, F.lit(0))).alias("gt"))


def with_ground_truth(pages: DataFrame, truth: DataFrame, stem: str = "stem", page_num: str = "page_num") -> DataFrame:
    """Adds gt: the page's own text, else the document's, else null."""
    own = truth.where("page_num IS NOT NULL").select(F.col("stem").alias("_s"), F.col("page_num").alias("_p"), F.col("gt").alias("_own"))
    whole = truth.where("page_num IS NULL").select(F.col("stem").alias("_d"), F.col("gt").alias("_whole"))
    joined = pages.join(own, (F.col(stem) == F.col("_s")) & (F.col(page_num) == F.col("_p")), "left").join(whole, F.col(stem) == F.col("_d"), "left")
    return joined.withColumn("gt", F.coalesce("_own", "_whole")).drop("_s", "_p", "_own", "_d", "_whole")


def anchors(spark: SparkSession, by_stem: dict[str, list[str]]) -> DataFrame:
    """(stem, anchors) of a dictionary. It is the driver's, so it is broadcast: many pages of one stem aren't sent to one task for it."""
    return F.broadcast(spark.createDataFrame(list(by_stem.items()), "stem string, anchors array<string>"))


def with_anchors(pages: DataFrame, table: DataFrame, stem: str = "stem") -> DataFrame:
    """Adds anchors, empty where a document has none."""
    named = table.select(F.col("stem").alias("_a"), F.col("anchors").alias("_anchors"))
    return pages.join(named, F.col(stem) == F.col("_a"), "left").withColumn("anchors", F.coalesce("_anchors", F.array().cast("array<string>"))).drop("_a", "_anchors")


def canned_results(spark: SparkSession, by_sha: dict[str, OCROutput]) -> DataFrame:
    """(sha256, ocr) from a dictionary."""
    return spark.createDataFrame([(k, tuple(v.as_dict().values())) for k, v in by_sha.items()], f"sha256 string, ocr {OCR_SCHEMA.simpleString()}")


def with_canned(pages: DataFrame, canned: DataFrame, default: OCROutput, model: str, content: str = "page_png") -> DataFrame:
    """Adds ocr: the canned result of the page's SHA-256, else the default, with the model's name put in."""
    values = default.as_dict()
    fallback = F.struct(*(F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in OCR_SCHEMA))
    found = canned.select(F.col("sha256").alias("_sha"), F.col("ocr").alias("_ocr"))
    joined = pages.join(found, F.sha2(F.col(content), 256) == F.col("_sha"), "left")
    return joined.withColumn("ocr", F.coalesce("_ocr", fallback).withField("model", F.lit(model))).drop("_sha", "_ocr")


#: Places of the bitmap of canned digests: eight for each digest, within bounds.
LEAST_PLACES, MOST_PLACES = 1 << 15, 1 << 27


def maybe_among(rows: DataFrame, digest: str, known: DataFrame, name: str = "maybe") -> DataFrame:
    """Adds a boolean: false where the digest (a hexadecimal text) surely isn't among `known` (one column); about one in eight others is true as well.

    The bitmap of hashes is summed up by tasks and broadcast, at most 16 MB whatever the tables are; beyond some 10^8 digests it fills up and says true more often."""
    n = known.count()
    places = LEAST_PLACES
    while places < min(8 * n, MOST_PLACES):
        places *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(places))
    bits = known.select(place(known.columns[0]).alias("_x")).groupBy(F.bitmap_bucket_number("_x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("_bitmap"))
    found = rows.withColumn("_x", place(digest)).join(F.broadcast(bits), F.bitmap_bucket_number("_x") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(F.bitmap_bit_position("_x") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(bitmap_bit_position(_x) % 8 as int)) & 1") == 1
    return found.withColumn("_byte", byte).withColumn(name, F.coalesce(bit, F.lit(False))).drop("_x", "_bucket", "_bitmap", "_byte")


def canned_silver(pages: DataFrame, canned: DataFrame, default: OCROutput, model: str, content: str = "page_png") -> DataFrame:
    """Like with_canned, but for the results alone: the pages' other columns and `ocr`, without their bytes, which never leave the task that reads them.

    Digests are made there; pages that the bitmap rules out get the default where they are, and only slim rows (the other columns and a digest) of the others are joined."""
    keys = [c for c in pages.columns if c != content]
    slim = pages.select(*keys, F.sha2(F.col(content), 256).alias("_digest"))
    told = maybe_among(slim, "_digest", canned.select("sha256"), "_maybe")
    values = default.as_dict()
    fallback = F.struct(*(F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in OCR_SCHEMA))
    rest = told.where("NOT _maybe").select(*keys, fallback.withField("model", F.lit(model)).alias("ocr"))
    found = canned.select(F.col("sha256").alias("_sha"), F.col("ocr").alias("_ocr"))
    joined = told.where("_maybe").join(found, F.col("_digest") == F.col("_sha"), "left")
    return joined.select(*keys, F.coalesce("_ocr", fallback).withField("model", F.lit(model)).alias("ocr")).unionByName(rest)
