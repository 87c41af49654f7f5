"""Secret scans (3, native): an incremental ledger of content-addressed blobs.

Every historical version of a file is addressed by the SHA-256 of its text. A ledger says which blobs have been
scanned with which version of the rules, which is the digest of the rules themselves; only unseen pairs are scanned, each once
however many paths, versions and repeated rows hold the blob. Findings are then joined back to all paths.

The ledger is a folder with one Parquet table (blob, rule_version, spans) a scan, which has every blob of that scan, also those
without findings. Only tables that were ended (Spark's _SUCCESS) are read, so a scan that failed leaves no trace. Texts are dealt
by id (one row a blob is chosen), never by their copies, and repeated rows are combined before the shuffle; a bitmap of the chosen
rows' hashes, 16 MB whatever the input, keeps all other texts where they are. A hot blob meets its findings in a join of two
written tables, which Spark can split.

Positions come from splitting a text by the same pattern: the parts' and the matches' lengths add up to each match's
start. Lengths are code points.

Defined results: a null text counts as empty and has no findings; repeated rows each get the blob's findings; a null id
is kept; spans of different kinds may overlap and all stay; an empty table gives an empty table; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import col, fresh, marked, scratch, written



@dataclass(frozen=True)
class Rule:
    """`min_length` holds for the whole match or, if `group` is set, for that group; shorter matches are dropped, not sought again."""

    kind: str
    pattern: str
    group: int
    min_length: int


#: Kinds in their order, patterns and least lengths.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so asking for 32 at once drops the same ones
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """Rules that differ in anything, their order too, have different versions."""
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:32]


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """One rule's spans. Between the parts that a split leaves stand the matches, in order."""
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.char_length).alias("width"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length).alias("size"),
    )

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["width"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.min_length, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPANS)
    matches = F.filter(lengths, lambda x: x["width"].isNotNull())
    found = F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans as array<struct<start, rank, end, kind>>, by start, then by the kinds' order; native functions only."""
    return F.array_sort(F.concat(*(_spans(text, rank, rule) for rank, rule in enumerate(rules))))


LEDGER = f"blob string, rule_version string, spans {SPANS}"


def ended_scans(spark: SparkSession, ledger: str) -> list[str]:
    """The ledger's tables of scans that came to their end."""
    top = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [x.getPath() for x in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """All that the ledger holds, empty if nothing has been scanned."""
    scans = ended_scans(spark, ledger)
    return spark.read.schema(LEDGER).parquet(*scans) if scans else spark.createDataFrame([], LEDGER)


def addressed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    return df.select(col(id_col).alias("path"), text.alias("text")).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))


def scan_unseen(df: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the blobs that the ledger doesn't have under these rules, adds them to it, and returns the versions (path, blob)."""
    spark, version = df.sparkSession, version_of(rules)
    rows = addressed(df, id_col, text_col)
    with scratch(spark) as kept:
        versions = written(rows.select("path", "blob"), "versions")
        kept.append(versions)
        seen = ledger_rows(spark, ledger).where(F.col("rule_version") == version).select("blob")
        chosen = versions.groupBy("blob").agg(F.min(F.xxhash64("path")).alias("_at")).join(seen, "blob", "left_anti")
        chosen = written(chosen.select(F.col("blob").alias("_blob"), "_at"), "unseen")
        if chosen.isEmpty():
            return versions
        rows = marked(rows.withColumn("_h", F.xxhash64("path")), F.xxhash64("_h", "blob"), chosen.select(F.xxhash64("_at", "_blob"))).where("maybe")
        once = rows.groupBy("_h", "blob").agg(F.first("text").alias("text"))  # partial sums first: a task sends each repeated row once
        texts = once.join(chosen.hint("shuffle_hash"), (F.col("_h") == F.col("_at")) & (F.col("blob") == F.col("_blob")))
        found = texts.select("blob", F.lit(version).alias("rule_version"), spans_of(F.col("text"), rules).alias("spans"))  # no filter: it would move below the join, to all rows
        found.write.parquet(f"{ledger}/scan-{uuid.uuid4().hex}")
    return versions


def findings_of(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, spans of every version, by the ledger. A blob that two scans at once have added counts once."""
    found = ledger_rows(versions.sparkSession, ledger).where((F.col("rule_version") == version_of(rules)) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")
    return versions.join(written(found, "findings"), "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secret_scan(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`id_col`, blob, spans of every row; `ledger`: the folder of earlier scans, or a new one."""
    ledger = ledger or fresh(df.sparkSession, "ledger")
    return findings_of(scan_unseen(df, ledger, id_col, text_col, rules), ledger, rules).withColumnRenamed("path", id_col)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping ones as one, replaced by `mark`."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(
        spans,
        state,
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)
