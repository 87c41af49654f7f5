"""Benchmark decontamination (9): Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of each benchmark item (an item of fewer words is one pattern).
The search looks at blocks of two words: a shift table says how far the search may move when the block at its end
stands in no pattern there; where the shift is 0, the block's suffix bucket is narrowed by a hash of the words before it (the
prefix table), and a direct comparison of all words confirms each pattern left. Patterns shorter than a window have tables of
their own, one for each length, so that they don't shorten the others' shifts.

Tables are flat arrays: a shift is one byte at a place that the block's checksum gives (blocks that share a place have the least
of their shifts, which is safe), and a pattern is 20 bytes: its key (suffix and prefix checksums, sorted), its place in the benchmark's
words, and its item. The benchmark is dealt by hash into blocks of about `block_bytes` of text; one task a block builds its tables and leaves them
as a file in the shared folder. Nothing of the benchmark goes through the driver but the files' names, nothing is broadcast, and a worker keeps one block's
tables from task to task.

The texts are searched where they are. With one block that is one pass over them; each further block is one more pass, of which only texts with hits come
out, as digests of the text with its hits. These are merged and meet the rows by digests, hot ones by a bounded broadcast; a text is never dealt unless it has hits
and is kept. So memory doesn't grow with the benchmark, and time does: passes are the product of texts and blocks. The input is read once a
pass, so let it be a table.

Defined results: null or empty texts have no words, no hits and the digest of the empty list; an item that is null
or has no words matches nothing; items with equal texts all count; items that share an id count once; repeated rows
are searched each; an empty benchmark finds nothing; other columns of the input are left aside.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import claim, col, fields, fresh, marked, scratch, with_found, written
from pagelake.llm.stores import Stores

BLOCK_BYTES = 16 << 20
#: Passes over the texts that are one job.
PASSES = 16

#: Letters A-Z in lower case; every other ASCII character but digits and a-z parts words; all bytes of other characters are kept.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def place_of(block: list[bytes]) -> int:
    return zlib.crc32(block[-1], zlib.crc32(block[0]) if len(block) > 1 else 0)


class Patterns:
    """Wu-Manber tables for patterns of one length in words."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.texts, self.size = [], 0
        self.places: list[np.ndarray] = []  # of blocks, with their shifts
        self.shifts: list[np.ndarray] = []
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, words: list[bytes], item: int) -> None:
        """All windows of an item's words."""
        length, block, n = self.length, self.block, len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = self.size + np.cumsum(lengths + 1) - lengths - 1
        self.texts.append(b" ".join(words))
        self.size += int(lengths.sum()) + n
        blocks = np.fromiter((place_of(words[i : i + block]) for i in range(n - block + 1)), np.uint32, n - block + 1)
        at, windows = np.arange(n - block + 1), n - length + 1
        self.places.append(blocks)
        # a block may end at any place of a window up to its end; the least distance to a window's end counts
        self.shifts.append(np.clip(length - block - at, 0, 255).astype(np.uint8))
        before = np.fromiter((zlib.crc32(b" ".join(words[i : i + length - block])) for i in range(windows)), np.uint64, windows)
        keys = blocks[length - block :].astype(np.uint64) << np.uint64(32) | before
        self.rows.append((keys, starts[:windows].astype(np.uint32), (starts + lengths)[length - 1 :].astype(np.uint32), np.full(windows, item, np.uint32)))

    def close(self) -> Patterns:
        places, shifts = np.concatenate(self.places), np.concatenate(self.shifts)
        self.bits = min(26, max(12, int(len(places)).bit_length() + 4))
        most = np.full(1 << self.bits, min(255, self.length - self.block + 1), np.uint8)
        np.minimum.at(most, places >> np.uint32(32 - self.bits), shifts)
        self.shift = most.tobytes()
        keys = np.concatenate([row[0] for row in self.rows])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order].tobytes()
        self.starts, self.ends, self.items = (np.concatenate([row[k] for row in self.rows])[order].tobytes() for k in (1, 2, 3))
        self.blob = b" ".join(self.texts)
        del self.texts, self.places, self.shifts, self.rows
        return self

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, number of an item) of each occurrence."""
        length, block, shift, crc, down = self.length, self.block, self.shift, zlib.crc32, 32 - self.bits
        keys, starts, ends, items = (memoryview(x).cast(kind) for x, kind in ((self.keys, "Q"), (self.starts, "I"), (self.ends, "I"), (self.items, "I")))
        blob, n, end, known = self.blob, len(words), length, len(keys)
        while end <= n:
            suffix = crc(words[end - 1], crc(words[end - 2])) if block == 2 else crc(words[end - 1])
            step = shift[suffix >> down]
            if step:
                end += step
                continue
            key = suffix << 32 | crc(b" ".join(words[end - length : end - block]))
            k = bisect_left(keys, key)
            if k < known and keys[k] == key:
                own = b" ".join(words[end - length : end])
                while k < known and keys[k] == key:
                    if blob[starts[k] : ends[k]] == own:
                        yield end - length, items[k]
                    k += 1
            end += 1


def build(items: list[tuple[str, str]], window: int) -> tuple[list[str], list[Patterns]]:
    """The items' ids and the tables of one block of the benchmark."""
    tables: dict[int, Patterns] = {}
    for i, (_, text) in enumerate(items):
        words = words_of(text)
        if words:
            length = min(window, len(words))
            if length not in tables:
                tables[length] = Patterns(length)
            tables[length].add(words, i)
    return [item for item, _ in items], [t.close() for t in tables.values()]


def built(benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """The files of the benchmark's tables, one a block of about `block_bytes` of text (a longer item is a block's own), each built by one task.

    A task that runs again writes a file of its own; the names that Spark has taken decide."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = items.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-total // block_bytes)))))
    stores, folder = Stores.of(benchmark.sparkSession), fresh(benchmark.sparkSession, "wu-manber")

    def tables(own: pa.Table) -> pa.Table:
        claim("decontamination", _held.clear)
        made = build([(item.as_py(), text.as_py()) for item, text in zip(own.column("item"), own.column("text"), strict=True)], window)
        store, top = stores.at(folder)
        store.create_dir(top, recursive=True)
        name = f"block-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{top}/{name}") as out:
            pickle.dump(made, out, protocol=pickle.HIGHEST_PROTOCOL)
        return pa.table({"path": [f"{folder}/{name}"]})

    return sorted(r.path for r in written(blocks.groupBy("block").applyInArrow(tables, "path string"), "wu-manber-files").collect())


#: Of this Python worker: the tables of one block, by their file.
_held: dict[str, tuple[list[str], list[Patterns]]] = {}


def held(stores: Stores, path: str | None) -> tuple[list[str], list[Patterns]]:
    claim("decontamination", _held.clear)
    if path is None:
        return [], []
    if path not in _held:
        _held.clear()
        store, at = stores.at(path)
        with store.open_input_file(at) as file:
            _held[path] = pickle.loads(file.read())
    return _held[path]


HITS = "hits array<int>, items array<string>"


def searched(rows: DataFrame, path: str | None, kind: T.DataType | None = None, keep_text: bool = False) -> DataFrame:
    """id, text (null unless it is kept), n_words, hits and items by one block of every row of (id, text). Without the id's type: of texts with hits their digests, hits and items."""
    stores = Stores.of(rows.sparkSession)
    schema = fields([], "h1 long, h2 long, " + HITS) if kind is None else fields([("id", kind)], "text string, n_words long, " + HITS)
    n_first = 2 if kind is None else 1  # columns before the text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables = held(stores, path)
        for batch in batches:
            counts, hits, names = [], [], []
            for value in batch.column(n_first):
                words, ranges, occurring = words_of(value.as_py()), [], set()
                for patterns in tables:
                    for start, item in patterns.search(words):
                        ranges += (start, start + patterns.length)
                        occurring.add(item)
                counts.append(len(words))
                hits.append(merged(ranges))
                names.append(sorted({ids[x] for x in occurring}))
            found = [pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
            if kind is None:
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["h1", "h2", "hits", "items"])
                yield out.filter(pa.array([bool(x) for x in hits], pa.bool_()))
            else:
                texts = batch.column(1) if keep_text else pa.nulls(len(counts), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(counts, pa.int64()), *found], names=["id", "text", "n_words", "hits", "items"])

    return rows.mapInArrow(scan, schema)


def digests() -> list[Column]:
    """128 bits of a text: texts with equal ones have equal hits."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(9), "text").alias("h2")]


def searched_by_all(rows: DataFrame, paths: list[str], kind: T.DataType, keep_text: bool) -> DataFrame:
    """As `searched`, by several blocks."""
    keyed = rows.select(F.struct("id", *digests()).alias("id"), "text")
    boxed = keyed.schema["id"].dataType
    first = written(searched(keyed, paths[0], boxed, keep_text), "first-block")
    first = first.select("id.*", *first.columns[1:])
    texts = rows.select(*digests(), "text")
    jobs = []
    for k in range(1, len(paths), PASSES):
        passes = [searched(texts, path).withColumn("pass", F.lit(i)) for i, path in enumerate(paths[k : k + PASSES])]
        # copies of a text have the same hits: one of them a pass
        once = reduce(DataFrame.unionByName, passes).groupBy("h1", "h2", "pass").agg(F.first(F.struct("hits", "items")).alias("x"))
        jobs.append(written(once.groupBy("h1", "h2").agg(F.collect_list("x").alias("more")), "further-blocks"))
    more = reduce(DataFrame.unionByName, jobs).groupBy("h1", "h2").agg(F.flatten(F.collect_list("more")).alias("more"))
    sizes = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    more = written(more.join(sizes, ["h1", "h2"]), "more-hits")
    dealt = marked(first, F.xxhash64("h1", "h2"), more.select(F.xxhash64("h1", "h2")))  # rows that no further block hits stay where they are
    met = with_found(dealt.where("maybe").drop("maybe"), ["h1", "h2"], more, "n")
    out = ["id", "text", "n_words", "hits", "items"]
    own = F.expr("struct(hits, items)")
    united = met.select("id", "text", "n_words", F.concat(F.array(own), F.coalesce("more", F.expr("array()").cast(more.schema["more"].dataType))).alias("all"))
    ranges = F.pandas_udf(lambda x: x.map(lambda lists: merged([n for own in lists for n in own])), "array<int>")
    united = united.select("id", "text", "n_words", ranges("all.hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten("all.items"))).alias("items"))
    return united.select(out).unionByName(dealt.where("NOT maybe").select(out))


def decontaminate(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, spans: bool = False, keep_text: bool = False
) -> DataFrame:
    """`id_col`, n_words, n_hit, n_items, items_sha256, contaminated of every row, with `spans` the hit ranges of words and the items, and with `keep_text` the text."""
    rows, kind = df.select(col(id_col).alias("id"), col(text_col).alias("text")), df.schema[id_col].dataType
    with scratch(df.sparkSession) as keeps:
        paths = built(benchmark, window, block_bytes)
        found = searched_by_all(rows, paths, kind, keep_text) if len(paths) > 1 else searched(rows, paths[0] if paths else None, kind, keep_text)
        n_hit = F.expr("cast(aggregate(sequence(0, size(hits) - 2, 2), 0L, (acc, i) -> acc + hits[i + 1] - hits[i]) as long)")
        out = found.select(
            F.col("id").alias(id_col), "n_words", F.when(F.size("hits") == 0, F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "hits", "items", "text",
        )
        out = written(out.drop(*([] if spans else ["hits", "items"]), *([] if keep_text else ["text"])), "decontaminated")
        keeps.append(out)
    return out


def merged(ranges: list[int]) -> list[int]:
    """Flat [start, end, ...] ranges as disjoint ones in order."""
    out: list[int] = []
    for start, end in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out
