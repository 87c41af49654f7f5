"""Scores against ground truth, distributed: two left joins, four expressions, one aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import text as X
from pagelake.functions.distance import edit_distance as long_distance
from pagelake.operators.alignment import N, passages
from pagelake.sources.dimensions import anchors as anchor_table
from pagelake.sources.dimensions import ground_truth, ground_truth_folders, with_anchors, with_ground_truth

METRICS = ("edit_distance", "exact_token_recall", "table_f1", "reading_order_ed")


def scores_of(text: str, gt: str, distance: Callable[[Column, Column], Column] = X.edit_distance) -> list[Column]:
    """The four scores of a text against its truth; `anchors` is a column."""
    return [
        X.normalized_edit_distance(text, gt, distance).alias("edit_distance"), X.anchor_recall(text, "anchors").alias("exact_token_recall"),
        X.table_cell_f1(text, gt).alias("table_f1"), X.reading_order_distance(text, gt).alias("reading_order_ed"),
    ]


def spread(rows: DataFrame) -> DataFrame:
    """Deals pages to all of the session's shuffle partitions: joins leave few tasks, by bytes, while a distance takes the product of two texts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "filename", "page_num")


def score_pages(silver: DataFrame, truth: DataFrame, anchors: DataFrame, distance: Callable[[Column, Column], Column] = long_distance) -> DataFrame:
    """Four scores of every page that has a ground truth; the others are left out. A null text counts as empty."""
    pages = with_ground_truth(silver.withColumn("stem", X.stem("filename")), truth).where("gt IS NOT NULL")
    pages = with_anchors(pages, anchors).select("filename", "page_num", F.coalesce("markdown", F.lit("")).alias("_text"), "gt", "anchors")
    return spread(pages).select("filename", "page_num", *scores_of("_text", "gt", distance))


def score_documents(silver: DataFrame, truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """The same with a document's pages joined in order, for ground truths of whole documents; texts of any length, by the distance of long texts."""
    whole = silver.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("markdown", F.lit("")).alias("t")))).alias("p"))
    whole = whole.select("filename", F.lit(None).cast("int").alias("page_num"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("markdown"))
    return score_pages(whole, truth, anchors)


def score_passages(silver: DataFrame, truth: DataFrame, anchors: DataFrame, n: int = N) -> DataFrame:
    """Scores of every page against the passage of its document's truth (stem, gt) that it shows, with `matches`, the n-grams that tell the passage."""
    pages = passages(silver.select("filename", "page_num", F.coalesce("markdown", F.lit("")).alias("_text"), X.stem("filename").alias("stem")), truth.select("stem", "gt"), n, text="_text")
    pages = with_anchors(pages, anchors).select("filename", "page_num", "_text", "passage", "anchors", "matches", "begins", "ends")
    return spread(pages).select("filename", "page_num", *scores_of("_text", "passage", long_distance), "matches", "begins", "ends")


def summarize(scores: DataFrame) -> DataFrame:
    """One row: the mean of each score (0.0 without pages) and n_pages_scored."""
    return scores.agg(*(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS), F.count(F.lit(1)).alias("n_pages_scored"))


class Evaluator:
    """Ground truth from a folder of Markdown files (or, with `folders`, of write_ground_truth), anchors from a dictionary; score_df returns a dictionary.

    `by="page"` scores pages against their own truth or the whole document's, "passage" against the passage of the document's truth, "document" whole documents."""

    def __init__(self, ground_truth_dir: str, anchors_by_doc: dict[str, list[str]] | None = None, folders: bool = False, by: str = "page"):
        if by not in ("page", "passage", "document"):
            raise ValueError("by is page, passage or document")
        self.folder, self.anchors, self.folders, self.by = str(ground_truth_dir), anchors_by_doc or {}, folders, by

    def score_pages(self, silver: DataFrame) -> DataFrame:
        spark: SparkSession = silver.sparkSession
        truth = ground_truth_folders(spark, self.folder) if self.folders else ground_truth(spark, self.folder)
        if self.by != "page":
            truth = truth.where("page_num IS NULL")
        score = {"page": score_pages, "passage": score_passages, "document": score_documents}[self.by]
        return score(silver, truth, anchor_table(spark, self.anchors))

    def score_df(self, silver: DataFrame) -> dict[str, float]:
        return summarize(self.score_pages(silver)).first().asDict()

    @staticmethod
    def log_to_mlflow(metrics: dict, run_name: str = "eval") -> bool:
        """Logs the numbers if mlflow is installed; says whether it did."""
        try:
            import mlflow
        except ImportError:
            return False
        with mlflow.start_run(run_name=run_name):
            for name, value in metrics.items():
                if isinstance(value, (int, float)):
                    mlflow.log_metric(name, float(value))
        return True


def append_metrics(spark: SparkSession, metrics: dict, path: str, run_name: str = "eval") -> DataFrame:
    """The numbers as rows (run_name, name, value) of a JSON table, where there is no tracking server."""
    rows = [(run_name, k, float(v)) for k, v in metrics.items() if isinstance(v, (int, float))]
    spark.createDataFrame(rows, "run_name string, name string, value double").coalesce(1).write.mode("append").json(path)
    return spark.read.schema("run_name string, name string, value double").json(path)


def assert_golden(actual: str, golden: str, tolerance: float = 0.05, spark: SparkSession | None = None) -> float:
    """The normalised edit distance, which must not be beyond the tolerance."""
    spark = spark or SparkSession.getActiveSession()
    distance = spark.createDataFrame([(actual, golden)], "a string, b string").select(X.normalized_edit_distance("a", "b")).first()[0]
    assert distance <= tolerance, f"edit distance {distance:.3f} is beyond {tolerance}"
    return distance
