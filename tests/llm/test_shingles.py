from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagelake.llm import packed as P
from pagelake.llm import shingles as S


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def same_partition(texts, size, chunk):
    """Shingles get equal digests exactly where they are equal."""
    got = list(S.sets_of(pa.array(texts, pa.string()), size))
    by_digest, by_shingle = {}, {}
    for text, digests in zip(texts, got, strict=True):
        w = words(text)
        want = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        assert len(digests) == len(want) and (np.diff(digests.astype(object)) > 0).all()
        h = list(S.sets_of(pa.array([b" ".join(x).decode() for x in want], pa.string()), size))
        for shingle, (digest,) in zip(want, h, strict=True):
            assert by_digest.setdefault(int(digest), shingle) == shingle and by_shingle.setdefault(shingle, int(digest)) == int(digest)
        assert {int(d) for d in digests} == {by_shingle[x] for x in want}


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_sets(monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    r = random.Random(7)
    say = lambda n: " ".join(r.choice(["a", "B", "ab", "É", "日本", "x" * 70, "y" * 900, "z\x1cq", " "]) for _ in range(n))
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "One", *(say(r.randint(1, 40)) for _ in range(60)), "q" * 5000, say(300), "a b c d e " * 100, " lead and trail  "]
    same_partition(texts, 5, chunk)
    same_partition(texts[3:20], 1, chunk)


def test_slices_and_empty_batches():
    texts = pa.array(["a b c d e f", None, "g h", "a b c d e f"])
    assert [len(x) for x in S.sets_of(texts.slice(1), 5)] == [0, 1, 2] and list(S.sets_of(texts.slice(4), 5)) == []
    assert [x.tolist() for x in S.sets_of(texts.slice(3, 1).cast(pa.large_string()), 5)] == [x.tolist() for x in S.sets_of(texts.slice(0, 1), 5)]


def test_packed_round_trip():
    r = np.random.default_rng(3)
    key = r.integers(-(1 << 62), 1 << 62, 5000)
    small = r.integers(0, 100, 5000).astype(np.uint32)
    for n in (1, 7, 1 << 30):  # far more buckets than rows cost no more than the rows
        batches = list(P.deal(key, n, [key, small], kind=2))
        table = pa.Table.from_batches(batches, schema=P.ARROW)
        assert len(table) <= min(n, 5000)
        a, b = P.gather(table, ["i8", "u4"], 2)
        assert sorted(zip(a, b, strict=True)) == sorted(zip(key, small, strict=True)) and len(P.gather(table, ["i8"], 0)[0]) == 0
        for bucket in table.column("bucket").to_pylist()[:5]:
            (own, _) = P.gather(table.filter(pa.compute.equal(table.column("bucket"), bucket)), ["i8", "u4"], 2)
            assert set(own.view(np.uint64) % np.uint64(n)) == {bucket}
    assert list(P.deal(key[:0], 3, [key[:0]])) == []
