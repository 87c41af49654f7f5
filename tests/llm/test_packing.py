from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelake.llm import packing as K
from pagelake.llm import queries

PATH = public_tokenizers.path(K.TOKENIZER)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, K.END]


def check(rows, texts, length=K.LENGTH):
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids = ids_of(tokenizer, text)
        want = [(k // length, k, len(ids[k : k + length]), zlib.crc32(np.array(ids[k : k + length], "<u4").tobytes())) for k in range(0, len(ids), length)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_sequence), sum(r.length for r in rows)


def test_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    sequences, tokens = check(queries.op8_packing(spark, sf).collect(), texts)
    assert sequences <= -(-tokens // K.LENGTH) + 1


def test_edges(spark):
    texts = [None, "", " \n", "a", "it's I'LL don''t", "Σς İ ﬁ ² é", "日本語 text", "a<|endoftext|>b <|startoftext|>", "\x0b\x85x\xa0y", "w" * 20_000, "Ab cd " * 9000, "same", "same"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    check(K.packed(df, PATH).collect(), dict(enumerate(texts)))
    check(K.packed(df, PATH, length=7).collect(), dict(enumerate(texts)), length=7)
    assert K.packed(df.where("false"), PATH).collect() == []
    twice = spark.createDataFrame([(None, "x"), (1, "y"), (1, "y")], "doc_id long, text string")
    assert K.packed(twice, PATH).count() == 3


def test_word_table_overflows(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    monkeypatch.setattr(K, "MOST_WORDS", 6)
    known = K.WordIds(tokenizer)
    for text in ["one two three four", "five six seven eight nine", "one ten eleven, twelve!", "two five thirteen"] * 2:
        assert K.id_bytes([text, ""], known) == [np.array(ids_of(tokenizer, text)[:-1], "<u4").tobytes(), b""]


@pytest.mark.parametrize("seed", range(4))
def test_the_rule_by_brute_force(seed):
    r = np.random.default_rng(seed)
    length = 20
    sizes = r.integers(1, length + 1, 200)
    sequence, offset = K.sum_of_squares(sizes, length)
    gaps: dict[int, int] = {}
    for size, s, at in zip(sizes.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        def squares(changed):
            counts = np.bincount([g for g in changed.values() if g], minlength=length + 1)
            return int((counts**2).sum())
        options = [squares({**gaps, k: g - size}) for k, g in gaps.items() if g >= size and g < length] + [squares({**gaps, "new": length - size})]
        assert at == (length - gaps[s] if s in gaps else 0)
        gaps[s] = gaps.get(s, length) - size
        assert gaps[s] >= 0 and squares(gaps) == min(options)


def test_words_whose_pieces_differ_from_the_pattern(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    known = K.WordIds(tokenizer)
    known.ends[:] = False  # as if no id ended a piece
    text = "some words, it's 12 o'clock"
    assert K.id_bytes([text], known) == [np.array(ids_of(tokenizer, text)[:-1], "<u4").tobytes()]


def test_equal_rows_are_spread_over_blocks(spark):
    df = spark.range(3000, numPartitions=3).selectExpr("7L as doc_id", "'a few equal words' as text", "'x' as id", "1 as block", "2 as _small")
    rows = K.pack(K.written(K.pieces_of(df, PATH), "pieces"), length=64, block_pieces=500).collect()
    blocks = [r.sequence_id >> 32 for r in rows]
    assert len(rows) == 3000 and max(map(blocks.count, set(blocks))) < 1500
    assert {r.length for r in K.packed(df, PATH).collect()} == {5}


def test_one_operators_tables_at_a_time():
    from pagelake.llm import common

    gone = []
    common.claim("a", lambda: gone.append("a"))
    common.claim("a", lambda: gone.append("a"))
    common.claim("b", lambda: gone.append("b"))
    assert gone == ["a"]
    common.claim("a", int)
    assert gone == ["a", "b"]
