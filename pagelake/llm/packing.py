"""Best-fit packing (8): the sum-of-squares rule.

A document's tokens and its end token are cut into pieces of at most `length` tokens. Pieces go to sequences one by one: with N(g)
open sequences of residual gap g, a piece of size s goes where the sum of N(g)^2 becomes smallest, that is to the gap
g >= s (or to a new sequence) for which N(g - s) - N(g) is least; a sequence without gap is closed and counts no more.

Pieces are dealt into blocks of about `block_pieces` by a hash of the piece and its place in the written table (so that repeated
rows are spread) and each block is packed by itself;
the rule works on a stream of mixed sizes, so a block's order is that of the pieces' checksums, the
smallest quarter last. A block leaves a few
sequences open, a fraction of a percent, and no task grows with the input.

Tokenizing: no piece of the tokenizer's pattern holds white space, and words between white space repeat, so each worker
keeps a bounded table from word to ids. That way is taken
for texts of characters below U+0250 without control characters (other than tab, newline and carriage return) and
without special strings, where lower-casing and the pattern are the same in all libraries; every other text is encoded by the
tokenizer itself, split in front of spaces where it is long.

Defined results: a null or empty text is one piece, the end token; repeated rows and rows that share an id are packed
each; a null id is kept; an empty table gives an empty table; other columns of the input are left aside.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import claim, col, fields, scratch, written
from pagelake.llm.token_counts import load_tokenizer, safe_pieces

TOKENIZER, LENGTH, END = "word_bpe_49k.json", 4096, 1
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u024f]*")
#: The tokenizer's own pattern, as its file gives it.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MOST_WORDS, RUN_CHARS = 900_000, 2 << 20


class WordIds(dict):
    """Word between white space -> its ids as bytes; holds `most` and those of one run at most."""

    def __init__(self, tokenizer, most: int | None = None):
        self.tokenizer, self.most = tokenizer, most or MOST_WORDS
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end one of the tokenizer's own pieces
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the missing words in one call; ids that end a piece tell the pieces, and the pattern how many a word has."""
        missing = [x for x in words if x not in self]
        if not missing:
            return
        if len(self) >= self.most:
            first = list(islice(self.items(), self.most * 3 // 4))  # those met first are the common ones
            self.clear()
            self.update(first)
            missing = [x for x in words if x not in self]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, dtype="<u4")
        pieces = np.append(0, np.flatnonzero(self.ends[ids]) + 1) * 4
        upto = np.cumsum([1 if x.isalpha() else len(PIECE.findall(x)) for x in missing])
        if upto[-1] != len(pieces) - 1 or pieces[-1] != 4 * len(ids):  # some word has other pieces than the pattern says: one by one
            self.update((x, self.ids(x)) for x in missing)
            return
        raw, cuts = ids.tobytes(), pieces[np.append(0, upto)].tolist()
        self.update(zip(missing, (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))


@lru_cache(maxsize=2)
def known_words(path: str, most: int) -> WordIds:
    """One table a worker, kept from task to task."""
    return WordIds(load_tokenizer(path), most)


def forget() -> None:
    known_words.cache_clear()
    load_tokenizer.cache_clear()


def id_bytes(texts: list[str], known: WordIds) -> list[bytes]:
    """The ids of each text, little-endian unsigned 32-bit, as the tokenizer gives them."""
    words = [x.lower().split() if PLAIN.fullmatch(x) and "<|" not in x else None for x in texts]
    known.learn(set().union(*(x for x in words if x)))
    return [b"".join(map(known.__getitem__, w)) if w is not None else b"".join(map(known.ids, safe_pieces(x, 1 << 16))) for x, w in zip(texts, words, strict=True)]


def runs_of(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about `most` characters."""
    held, size, first = [], 0, 0
    for i, value in enumerate(texts):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def pieces_of(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, most_words: int = MOST_WORDS, run_chars: int = RUN_CHARS) -> DataFrame:
    """id, piece, start, length, ids_crc32: all pieces of all rows; `path`: the tokenizer's file on every worker. A worker's table holds `most_words`
    and the words of a run of texts of `run_chars`: more take memory, fewer take time."""
    schema = fields([("id", df.schema[id_col].dataType)], "piece int, start long, length long, ids_crc32 long")
    tail = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", forget)
        known = known_words(path, most_words)
        for batch in batches:
            rows, columns = [], ([], [], [], [])
            for i, ids in ((first + i, x + tail) for first, texts in runs_of(batch.column(1), run_chars) for i, x in enumerate(id_bytes(texts, known))):
                for k in range(0, len(ids), 4 * length):
                    part = ids[k : k + 4 * length]
                    rows.append(i)
                    for column, x in zip(columns, (k // 4 // length, k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32"])

    return df.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(cut, schema)


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the given order."""
    open_at: list[list[int]] = [[] for _ in range(length + 1)]  # by gap
    count = np.zeros(length + 1, dtype=np.int64)
    sequence, offset, n = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        if size == length:
            sequence[i], offset[i], n = n, 0, n + 1
            continue
        # cost[r]: what the sum gains if the gap becomes r; 2 (N(r) - N(r + size)) + 2, but closing (r = 0) and opening (r = length - size) touch one count only
        before, after = count[size:], count[: length + 1 - size]
        cost = np.where(before > 0, 2 * (after - before) + 2, never)
        if before[0] > 0:
            cost[0] = 1 - 2 * before[0]
        cost[length - size] = 2 * after[length - size] + 1
        gap = int(cost.argmin()) + size
        if gap == length:
            place, n = n, n + 1
        else:
            place = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = place, length - gap
        if gap > size:
            open_at[gap - size].append(place)
            count[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, length: int = LENGTH, block_pieces: int = 1 << 16) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    n_blocks = max(1, round(pieces.count() / block_pieces))
    block = F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group["_small"] = group["length"] <= group["length"].quantile(0.25)  # the rule wants a mixed order; the small ones fill what is left
        group = group.sort_values(["_small", "ids_crc32", "length", "id", "piece"], kind="stable", ignore_index=True).drop(columns="_small")
        sequence, offset = sum_of_squares(group["length"].to_numpy(), length)
        group["sequence_id"] = sequence + (group["block"].astype("int64") * (1 << 32))
        group["offset"] = offset
        return group.drop(columns="block")

    schema = fields([(f.name, f.dataType) for f in pieces.schema], "sequence_id long, offset long")
    return pieces.withColumn("block", block).groupBy("block").applyInPandas(place, schema)


def packed(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_words: int = MOST_WORDS, run_chars: int = RUN_CHARS) -> DataFrame:
    """Cut and pack all rows; tokenizing happens once."""
    with scratch(df.sparkSession) as kept:
        pieces = written(pieces_of(df, path, id_col, text_col, length, END, most_words, run_chars), "pieces")
        out = written(pack(pieces, length), "packed")
        kept.append(out)
    return out.withColumnRenamed("id", id_col)
