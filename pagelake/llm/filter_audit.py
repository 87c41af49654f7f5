"""Filter interaction audit (11): what each filter removes in each order of the filters, by packed bitmaps.

Each task turns its rows into bitsets of 64-bit words: one for each filter (set where a row fails it) and one for each label. The rows of a part
(a language, say) lie together and begin with a whole word, so a part is a run of words. Rows that survive a set of filters are the AND-NOT
of the survivors of one filter less, so 2^k sets take 2^k steps for k filters; popcounts, added up over a part's words, give a row
(part, set, survivors, good survivors, toxic survivors). Their sums over all tasks hold everything that the k! orders ask for: whatever stands before
a step is a set. Nothing but these sums is shuffled for the counts.

`measured` reads each text once and leaves a slim row (id, part, bits of filters A to D, 128-bit digest of the text). Filter E asks whether the same text has a
smaller id: the least id of each digest that occurs several times is joined back, hot digests by a broadcast (`with_found`), so that no group of copies meets in one task.

Defined results: a null text counts as empty, a null part as the empty string; all empty texts are identical; a row with a null id has no smaller id and
is none; rows that share an id aren't smaller than each other; of several labels of an id each counts (any good one makes it good); null labels and
documents without one are neither good nor toxic; repeated rows count each; a table without rows has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import col, scratch, with_found, written

#: A short, B repetitive, C upper case, D symbols, E a copy.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
UPPER, SYMBOLS, SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20
#: Rows of a chunk of bitsets, and parts whose sums a task holds before it hands them on.
CHUNK, MOST_PARTS = 1 << 18, 1 << 12


def word_counts(text: bytes) -> tuple[int, int]:
    """Words, and distinct ones; long texts by pieces that end at white space."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, start = 0, set(), 0
    while start < len(text):
        space = SPACE.search(text, start + PIECE)
        end = space.start() if space else len(text)
        words = text[start:end].split()
        n += len(words)
        seen.update(words)
        start = end
    return n, len(seen)


def failed(text: bytes, n_chars: int) -> int:
    """Bits of filters A to D."""
    n, distinct = word_counts(text)
    upper = len(text) - len(text.translate(None, UPPER))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return (n < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * n) << 1 | (100 * upper > MOST_UPPER * n_chars) << 2 | symbols << 3


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, fails (bits of A to D), digest of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).fill_null("")
            data = texts.cast(pa.binary()).to_pylist()
            fails = [failed(text, n) for text, n in zip(data, pc.utf8_length(texts).to_pylist(), strict=True)]
            digests = [hashlib.blake2b(text, digest_size=16).digest() for text in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "fails", "digest"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("fails", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    rows = df.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), col(text_col).alias("text"))
    return written(rows.mapInArrow(work, schema), "measured")


def with_copies(rows: DataFrame, bit: int = 4) -> DataFrame:
    """Sets a bit of `fails` where a smaller id has the same digest."""
    firsts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    found = with_found(rows, ["digest"], written(firsts, "copies"), "n")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return found.select("id", "part", F.col("fails").bitwiseOR(F.when(copy, F.lit(1 << bit)).otherwise(0)).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, fails, good, toxic."""
    is_one = lambda c: F.coalesce(F.max(col(c) == 1), F.lit(False))
    known = labels.groupBy(col(id_col).alias("_id")).agg(is_one(good_col).alias("_good"), is_one(toxic_col).alias("_toxic"))
    joined = rows.join(known, F.col("id") == F.col("_id"), "left")
    return joined.select("part", "fails", F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"))


class Bitmaps:
    """The bitsets of one chunk: a bit for each row, parts on whole words."""

    def __init__(self, parts: np.ndarray, n_parts: int, fails: np.ndarray, marks: list[np.ndarray], k: int):
        order = np.argsort(parts, kind="stable")
        sizes = np.bincount(parts, minlength=n_parts)
        words = -(-sizes // 64)
        self.starts = np.concatenate([[0], np.cumsum(words)[:-1]])
        first = np.cumsum(sizes) - sizes
        self.place = np.empty(len(parts), dtype=np.int64)
        self.place[order] = (self.starts * 64)[parts[order]] + np.arange(len(parts)) - first[parts[order]]
        self.n_words = int(words.sum())
        self.rows = self.bitset(np.ones(len(parts), dtype=bool))
        self.filters = [self.bitset((fails >> i & 1).astype(bool)) for i in range(k)]
        self.marks = [self.bitset(mark) for mark in marks]

    def bitset(self, flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.n_words * 64, dtype=bool)
        bits[self.place] = flags
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def counts(self) -> np.ndarray:
        """By part, set of filters and (all, each mark): the rows that fail none of the set."""
        left = [self.rows]
        for mask in range(1, 1 << len(self.filters)):
            low = mask & -mask
            left.append(left[mask ^ low] & ~self.filters[low.bit_length() - 1])
        counted = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts)
        return np.array([[counted(bits), *(counted(bits & mark) for mark in self.marks)] for bits in left]).transpose(2, 0, 1)


def subset_counts(rows: DataFrame, k: int = len(FILTERS), marks: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, subset (bits of filters), n, and one column for each mark: the rows (part, fails, marks) that fail none of the subset, summed over all tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows_of() -> pa.RecordBatch:
            table = np.concatenate(list(sums.values())) if sums else np.zeros((0, 1 + len(marks)), dtype=np.int64)
            masks = np.tile(np.arange(1 << k, dtype=np.int32), len(sums))
            parts = pa.array([part for part in sums for _ in range(1 << k)], pa.string())
            return pa.RecordBatch.from_arrays([parts, pa.array(masks), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["part", "subset", "n", *marks])

        def add(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            coded = table.column(0).combine_chunks().dictionary_encode()
            column = lambda i: table.column(i).to_numpy()
            found = Bitmaps(coded.indices.to_numpy(), len(coded.dictionary), column(1), [column(2 + i).astype(bool) for i in range(len(marks))], k).counts()
            for part, own in zip(coded.dictionary.to_pylist(), found, strict=True):
                sums[part] = sums[part] + own if part in sums else own

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                add(held)
                held, n = [], 0
                if len(sums) > MOST_PARTS:
                    yield rows_of()
                    sums = {}
        if n:
            add(held)
        yield rows_of()

    found = rows.select("part", "fails", *marks).mapInArrow(work, ", ".join(["part string, subset int, n long", *(f"{m} long" for m in marks)]))
    return found.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", *marks)))


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the sums of `subset_counts`. A part has 2^k sums, so its row is small."""
    k, every = len(filters), " ".join("".join(p) for p in permutations(filters))
    of_part = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("c"))
    weights = ", ".join(f"{factorial(i) * factorial(k - 1 - i)}L" for i in range(k))  # of so many orders a set of i filters is what stands before
    rows = of_part.select("part", "c", F.explode(F.split(F.lit(every), " ")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda at: f"shiftleft(1, instr('{filters}', substr(filter_order, {at}, 1)) - 1)"
    rows = rows.select("*", F.expr(bit("step")).alias("f"), F.expr(f"aggregate(if(step = 1, cast(array() as array<int>), sequence(1, step - 1)), 0, (m, i) -> m | {bit('i')})").alias("before"))
    whole = (1 << k) - 1
    lost = lambda c: f"c[before].{c} - c[before | f].{c}"
    shares = f"aggregate(filter(sequence(0, {whole}), s -> s & f = 0), 0L, (a, s) -> a + array({weights})[bit_count(s)] * (c[s].n - c[s | f].n))"
    return rows.select(
        "part", "filter_order", "step", F.expr("c[before | f].n").alias("kept"), F.expr(lost("n")).alias("removed"), F.expr(f"c[0].n - c[f].n - ({lost('n')})").alias("redundant"),
        F.expr(f"c[{whole} ^ f].n - c[{whole}].n").alias("unique_fails"), F.expr(lost("good")).alias("good_lost"), F.expr(lost("toxic")).alias("toxic_lost"), F.expr(shares).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of filters A to E over all documents."""
    with scratch(docs.sparkSession) as kept:
        rows = with_labels(with_copies(measured(docs, id_col, text_col, part_col)), labels, id_col)
        counts = written(subset_counts(rows), "subset-counts")
        kept.append(counts)
    return orders(counts)
