"""A corpus made ready for training: five stages, each one of the operators of pagelake.llm, each on all that the one before kept.

language_id rejects texts without a letter; near_duplicates keeps one document of each group;
decontamination drops documents with a benchmark passage; secret_scan redacts secrets inside the texts; packing cuts and packs
the tokens of what is left. All but the last return the columns of documents.

Defined results: a null or empty text has no letter and goes in the first stage; stages called by themselves keep such rows (they are no duplicates, hold no passage and
no secret, and are packed as one end token). Null ids, languages and sources pass. Texts of any length are read whole. Of equal rows, and of near duplicates, one stays: the one
with the least id, one of them if that ties. An empty table stays empty. Further columns of any name and type pass; `n_chars` follows a redacted text where there is such a column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import decontamination, language_id, near_duplicates, packing, secret_scan
from pagelake.llm.common import col, marked, removed, scratch, table, written


def boxed(docs: DataFrame, *named: str) -> DataFrame:
    """All columns as one, `row`, and copies of some of them by their names: whatever else a table has can't clash with an operator's columns."""
    return docs.select(F.struct(*map(col, docs.columns)).alias("row"), *map(col, named))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = docs.toDF(*(c if c in ("doc_id", "text", "lang") else f"column_{i}" for i, c in enumerate(docs.columns)))
    found = language_id.language_id(plain, keep=plain.columns)
    # no least score: for a short text the best cosine lies within the noise; texts with letters are und only where no language could be learned
    kept = found.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")).select(*plain.columns)
    return kept.toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs, near_duplicates.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    plain = docs.select(F.struct(*(col(c).alias(f"column_{i}") for i, c in enumerate(rest))).alias("row"), "text")
    found = decontamination.decontaminate(plain, table(spark, sf_dir, "benchmark"), id_col="row", keep_text=True).where("NOT contaminated")
    place = {c: F.col(f"row.column_{i}") for i, c in enumerate(rest)} | {"text": F.col("text")}
    return found.select(*(place[c].alias(c) for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scratch(spark) as kept:
        found = secret_scan.secret_scan(docs).where(F.size("spans") > 0)
        found = written(found.groupBy(F.col("blob").alias("found")).agg(F.first("spans").alias("spans")), "secrets")
        kept.append(found)
    blob = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    rows = boxed(docs, "text").withColumn("blob", blob)
    rows = marked(rows, F.xxhash64("blob"), found.select(F.xxhash64("found")))  # only texts that may hold secrets are dealt
    joined = rows.where("maybe").join(found.hint("shuffle_hash"), F.col("blob") == F.col("found"), "left")
    joined = joined.select("row", F.when(F.col("spans").isNotNull(), secret_scan.redacted(F.col("text"), F.col("spans"))).alias("clean"))
    rows = joined.unionByName(rows.where("NOT maybe").select("row", F.lit(None).cast("string").alias("clean")))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean")}
    old = lambda c: F.col("row").getField(c)
    return rows.select(*((F.when(F.col("clean").isNotNull(), changed[c].cast(docs.schema[c].dataType)).otherwise(old(c)) if c in changed else old(c)).alias(c) for c in docs.columns))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers that have served the stages before keep less for the words than they could alone
    return packing.packed(docs, public_tokenizers.path(packing.TOKENIZER), most_words=200_000, run_chars=1 << 19)


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_tokens),
]
#: SQL has no hypervectors, tries or packing rules: tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again as the next one's. What a stage has written goes once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        removed(spark, before)
        before = sorted({path.rsplit("/", 1)[0] for path in docs.inputFiles()})
    return STAGES[-1][1](spark, docs, sf_dir)
