"""Which passage of a whole document's truth a page shows: chains of shared word n-grams.

A truth often covers a document, while results come by pages. Scored against all of it, a page of two lacks half the text by construction. Here each
page is aligned with its passage first:

1. Words are runs of anything but white space, compared without case. Of the n-grams of n words those count that occur once in the page and once in
   the truth; both are found inside their own row, so only (document, n-gram, place) is shuffled, and each page's n-gram meets one place at most.
2. A page's matches, in the order of the page, are chained: the longest increasing subsequence of their places in the truth, of several the one that ends first.
   Matches elsewhere (a heading that another page repeats) don't fit the chain and fall away.
3. The passage reaches from the chain's first to its last match, and beyond both by the words that the page has before and after them.
4. Passages are cut where the truth's row is: its words are told apart once, and a page gets its passage, never the whole text.

Defined results: a page that shares no n-gram has an empty passage and 0 matches; a null text counts as empty; of several truths of one stem each is a truth by itself;
a page whose stem has no truth isn't returned; repeated pages are aligned each.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

N = 3
WORD, WORDS = r"[\s\x1C-\x1F]*[^\s\x1C-\x1F]+", r"(?U)[\s\x1C-\x1F]*[^\s\x1C-\x1F]+"


def words(text: Column) -> Column:
    """The words of a text, each with the white space in front of it, so that they join to the text again."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def single_grams(found: Column, n: int = N) -> Column:
    """array<struct<gram, at>>: the digests of n words that occur once, with their places from 0, in the order of digests."""
    none = F.array().cast("array<struct<gram:bigint,at:int>>")

    def grams(plain: Column) -> Column:
        gram = lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(plain, i + k) for k in range(n))))
        return F.when(F.size(plain) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(plain) - n, F.lit(0))), lambda i: F.struct(gram(i).alias("gram"), i.alias("at")))).otherwise(none)

    # each step is bound once: an expression inside a lambda would be worked out again for every element
    plain = F.transform(found, lambda w: F.lower(F.regexp_replace(w, r"(?U)\A[\s\x1C-\x1F]+", "")))
    ordered = F.array_sort(F.transform(F.array(plain), grams)[0])
    other = lambda g, i: F.try_element_at(g, i)["gram"]

    def single(g: Column) -> Column:
        before = lambda x, i: F.when(i > 0, other(g, F.greatest(i, F.lit(1))).eqNullSafe(x["gram"])).otherwise(F.lit(False))
        return F.filter(g, lambda x, i: ~other(g, i + 2).eqNullSafe(x["gram"]) & ~before(x, i))

    return F.transform(F.array(ordered), single)[0]


def chained(matches: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """(matches of the chain, first place in page and truth, last place in page and truth) of matches in the order of the page; zeros without any.

    Piles by length: each holds the least place that a chain of its length can end with, and where that chain began."""
    ends: list[int] = []
    chains: list[tuple[int, int, int, int]] = []
    for page, truth in matches:
        k = bisect_left(ends, truth)
        first = chains[k - 1][:2] if k else (page, truth)
        if k == len(ends):
            ends.append(truth)
            chains.append((*first, page, truth))
        else:
            ends[k], chains[k] = truth, (*first, page, truth)
    return (len(ends), *chains[-1]) if ends else (0, 0, 0, 0, 0)


CHAIN = StructType([StructField(name, IntegerType()) for name in ("n", "page_first", "first", "page_last", "last")])


def chain(matches: pa.Array) -> pa.Array:
    """CHAIN of each list of (page, at). The places stay arrays of numbers; only one row's are Python's at a time."""
    ends = np.cumsum(matches.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    places = matches.flatten()
    page, at = (places.field(name).to_numpy(zero_copy_only=False) for name in ("page", "at"))
    found = np.zeros((len(matches), len(CHAIN)), dtype=np.int32)
    begin = 0
    for i, end in enumerate(ends):
        found[i] = chained(list(zip(page[begin:end].tolist(), at[begin:end].tolist(), strict=True)))
        begin = end
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(CHAIN))], names=CHAIN.fieldNames())


def passages(pages: DataFrame, truth: DataFrame, n: int = N, stem: str = "stem", text: str = "markdown", gt: str = "gt") -> DataFrame:
    """The columns of pages with `passage`, `begins`, `ends` (words of the truth, the end exclusive) and `matches`, for pages (stem, ..., text) and truths (stem, gt)."""
    key = [F.col(stem), F.coalesce(F.col(text), F.lit(""))]
    rows = pages.withColumn("_row", F.concat(F.hex(F.xxhash64(*key)), F.hex(F.xxhash64(F.lit(1), *key))))
    shown = rows.select("_row", F.col(stem).alias("_stem"), single_grams(words(F.col(text)), n).alias("_g"))
    whole = truth.select(F.col(stem).alias("_stem"), words(F.col(gt)).alias("_words")).withColumn("_doc", F.xxhash64("_stem", "_words"))
    of_page = shown.select("_row", "_stem", F.explode("_g").alias("x")).select("_row", "_stem", F.col("x.gram").alias("gram"), F.col("x.at").alias("page"))
    of_truth = whole.select("_doc", "_stem", F.explode(single_grams(F.col("_words"), n)).alias("x")).select("_doc", "_stem", F.col("x.gram").alias("gram"), "x.at")
    matches = of_page.join(of_truth, ["_stem", "gram"]).groupBy("_row", "_doc").agg(F.array_sort(F.collect_list(F.struct("page", "at"))).alias("m"))
    chains = matches.select("_row", F.struct(F.col("_doc").alias("doc"), F.arrow_udf(chain, CHAIN)("m").alias("c")).alias("x")).groupBy(F.col("_row").alias("_r")).agg(F.collect_list("x").alias("_chains"))

    # pages meet their chains first, then their document's truth: of its words only the passage goes on
    joined = rows.join(chains, F.col("_row") == F.col("_r"), "left").withColumn("_n", F.size(words(F.col(text)))).join(whole, F.col(stem) == F.col("_stem"))
    own = F.try_element_at(F.filter(F.coalesce("_chains", F.array()), lambda x: x["doc"] == F.col("_doc")), F.lit(1))["c"]
    cut = joined.withColumn("_c", own).withColumn("matches", F.coalesce("_c.n", F.lit(0)))
    begins = F.when(F.col("matches") > 0, F.greatest(F.col("_c.first") - F.col("_c.page_first"), F.lit(0))).otherwise(F.lit(0))
    ends = F.when(F.col("matches") > 0, F.least(F.col("_c.last") + F.col("_n") - F.col("_c.page_last"), F.size("_words"))).otherwise(F.lit(0))
    passage = F.array_join(F.slice("_words", F.col("begins") + 1, F.greatest(F.col("ends") - F.col("begins"), F.lit(0))), "")
    return cut.withColumn("begins", begins).withColumn("ends", ends).withColumn("passage", passage).select(*pages.columns, "passage", "begins", "ends", "matches")
