"""Distributed prefix sums: running sums and XORs over all rows in a global order, also within groups, without a window that holds a group.

Rows are dealt into ranges of the order, each range is scanned by itself, and the totals of the ranges (one row a task) are added up on the driver; what a
range starts with is broadcast back. A group may reach over any number of ranges: its first rows in a range continue from the ranges before.
Repeated rows are told apart by their place in the input table, so they are dealt to several ranges as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import written

ADD = {"sum": np.cumsum, "xor": np.bitwise_xor.accumulate}


def changes(columns: list[pa.Array], before: list[pa.Scalar] | None) -> np.ndarray:
    """Where a row's group isn't the row's before; nulls are equal. The first row of all counts as no change."""
    n = len(columns[0])
    changed = np.zeros(n, dtype=bool)
    for i, column in enumerate(columns):
        first = pa.array([before[i].as_py() if before else column[0].as_py()], column.type)
        prior = pa.concat_arrays([first, column.slice(0, n - 1)])
        same = pc.if_else(pc.and_(column.is_null(), prior.is_null()), True, pc.fill_null(pc.equal(column, prior), False))
        changed |= ~same.to_numpy(zero_copy_only=False)
    return changed


def scanned(df: DataFrame, order: list[str], group: list[str], within: dict[str, tuple[str, str]], overall: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds running values: {new column: ("sum" or "xor", long column)}, inclusive, in the order of columns (nulls first); `within` starts anew with each group.

    `df` is a written table, or a projection of one, as it is read twice; `group` is the beginning of `order`."""
    spark = df.sparkSession
    overall = overall or {}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    old = list(df.columns)
    at = {name: i for i, name in enumerate(old)}
    news = [*within, *overall]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, open_, last = TaskContext.get().partitionId(), 0, True, None
        carry = dict.fromkeys(news, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in range(len(at))]
            changed = changes([columns[at[g]] for g in group], last) if group else np.zeros(batch.num_rows, dtype=bool)
            last = [columns[at[g]][batch.num_rows - 1] for g in group]
            starts = np.flatnonzero(changed)
            run = np.cumsum(changed)
            out = []
            for name in news:
                op, source = within[name] if name in within else overall[name]
                running = ADD[op](columns[at[source]].fill_null(0).to_numpy(zero_copy_only=False))
                base = np.zeros(1 + len(starts), dtype=np.int64)  # what stands before each run, as this batch counts
                if name in within:
                    base[1:] = running[starts - 1] * (starts > 0)
                if op == "sum":
                    base[0] = -carry[name]
                    value = running - (base[run] if name in within else base[0])
                else:
                    base[0] = carry[name]
                    value = running ^ (base[run] if name in within else base[0])
                carry[name] = int(value[-1])
                out.append(pa.array(value))
            still = (run == 0) & open_
            open_ = bool(still[-1])
            out += [pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(n + np.arange(batch.num_rows)), pa.array(still)]
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*columns[:-1], *out], names=[*old, *news, "_part", "_at", "_open"])

    longs = [T.StructField(x, T.LongType()) for x in news]
    schema = T.StructType([*df.schema.fields, *longs, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_open", T.BooleanType())])
    at["_tie"] = len(at)
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    local = written(rows.repartitionByRange(tasks, *order, "_tie").sortWithinPartitions(*order, "_tie").mapInArrow(work, schema), "scan")

    key = F.struct(*group) if group else F.struct(F.lit(0))
    ends = local.groupBy("_part").agg(F.min_by(key, "_at").alias("first"), F.max_by(F.struct(key.alias("k"), *news, "_open"), "_at").alias("last")).orderBy("_part").collect()  # a row a task
    carries, before, sums = [], None, dict.fromkeys(news, 0)
    for r in ends:
        goes_on = before is not None and r["first"] == before
        start = {x: sums[x] if x in overall or goes_on else 0 for x in news}
        carries.append((r["_part"], *start.values()))
        for x in news:
            op = (within.get(x) or overall[x])[0]
            own, earlier = r["last"][x], start[x] if x in overall or r["last"]["_open"] else 0
            sums[x] = own + earlier if op == "sum" else own ^ earlier
        before = r["last"]["k"]
    table = spark.createDataFrame(carries, T.StructType([T.StructField("_of", T.IntegerType()), *(T.StructField(f"_{x}", T.LongType()) for x in news)]))
    joined = local.join(F.broadcast(table), F.col("_part") == F.col("_of"))

    def final(x: str):
        op, earlier = (within.get(x) or overall[x])[0], F.col(f"_{x}")
        earlier = F.when(F.col("_open"), earlier).otherwise(F.lit(0).cast("long")) if x in within else earlier
        return (F.col(x) + earlier if op == "sum" else F.col(x).bitwiseXOR(earlier)).alias(x)

    return joined.select(*df.columns, *map(final, news))
