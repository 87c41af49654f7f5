"""Token counts (1): batch encoding in Arrow functions that return lengths only.

Batches are balanced by UTF-8 bytes, and long texts are split at safe boundaries: a cut is made only in front of an ASCII
space or newline that follows a character that isn't white space. No piece of the byte-level pattern
(`'s|'t|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`) reaches across such a place, the pattern never looks
back, and the special strings hold no white space; so the lengths of the parts add up to the length of the whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text without a safe boundary is encoded whole;
repeated rows are counted each; an empty table gives an empty table; other columns of the input are left aside.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelake.llm.common import claim, col, written

TOKENIZER = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """One tokenizer a worker; its own threads stay off, as each core has a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def safe_pieces(text: str, most: int) -> list[str]:
    """Parts of `text` of about `most` characters, cut at safe boundaries; longer ones only where there is none."""
    if len(text) <= most:
        return [text]
    parts, start, n = [], 0, len(text)
    while n - start > most:
        at = start + most
        while at < n and not (text[at] in " \n" and not text[at - 1].isspace()):
            at += 1
        parts.append(text[start:at])
        start = at
    if start < n:
        parts.append(text[start:])
    return parts


def byte_batches(pieces: list[tuple[int, str]], batch_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Runs of pieces whose UTF-8 bytes add up to `batch_bytes` or a little more."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += n_bytes(piece[1])
        if size >= batch_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def token_counts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_bytes: int = 1 << 18, piece_chars: int = 1 << 16
) -> DataFrame:
    """`id_col`, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; `path`: a tokenizers .json file on every worker."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", load_tokenizer.cache_clear)
        tokenizer = load_tokenizer(path)
        for batch in batches:
            texts = batch.column(1)
            sizes, counts, pieces, held = [], [0] * len(texts), [], 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                sizes.append(n_bytes(text))
                held += sizes[-1]
                pieces += [(i, x) for x in safe_pieces(text, piece_chars) if x]
                if held >= batch_bytes or i == len(texts) - 1:
                    for part in byte_batches(pieces, batch_bytes):
                        for (k, _), got in zip(part, tokenizer.encode_batch_fast([x for _, x in part], add_special_tokens=False), strict=True):
                            counts[k] += len(got)
                    pieces, held = [], 0
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens", "over_limit"])

    counted = df.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(count, schema)
    return written(counted, "token-counts").withColumnRenamed("id", id_col)
