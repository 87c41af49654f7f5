from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelake.llm import queries, token_counts as T

PATH = public_tokenizers.path(T.TOKENIZER)


def test_query_against_the_library(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 512)


def test_edges(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [None, "", " ", "\n\n  \n", "a<|endoftext|>b <|endoftext|>", "x" * 5000, ("word  it's \n\t 12é　 " * 20_000), "é" * 3000 + " " + "ß\r\n" * 3000, "a", "a"]
    df = spark.createDataFrame([(i // 2, t, 5) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = T.token_counts(df, PATH, piece_chars=1000, batch_bytes=5000).collect()
    want = sorted((i // 2, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want
    assert T.token_counts(df.where("false"), PATH).collect() == []


@pytest.mark.parametrize("most", [1, 2, 7, 50])
def test_pieces_join_to_the_text(most):
    text = "  ab c\n\n d  e f g\th i" * 20
    parts = T.safe_pieces(text, most)
    assert "".join(parts) == text and all(p[0] in " \n" for p in parts[1:])


def test_clashing_columns_and_other_ids(spark):
    df = spark.createDataFrame([("x", "é a", 1, 2), (None, None, 1, 2)], "`a.b` string, text string, id int, n_tokens int")
    got = T.token_counts(df, PATH, id_col="a.b").collect()
    assert sorted(((r["a.b"], r.n_bytes, r.n_tokens > 0, r.over_limit) for r in got), key=str) == sorted([("x", 4, True, False), (None, 0, False, False)], key=str)


def test_batches_are_balanced_by_bytes():
    pieces = [(i, x) for i, x in enumerate(["é" * 50, "a" * 50, "日" * 40, "b" * 10])]
    assert [[i for i, _ in run] for run in T.byte_batches(pieces, 100)] == [[0], [1, 2], [3]]
