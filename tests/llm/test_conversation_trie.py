from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagelake.llm import conversation_trie as C
from pagelake.llm import queries
from pagelake.llm.common import written
from pagelake.llm.scans import scanned

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes by a dictionary of whole beginnings. rows: (conv, turn, role, text), ties of turns in any order that is given."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * words
    sha = lambda node: hashlib.sha256(",".join(str(c) for c in members[node] if len(whole[c]) == len(node)).encode()).hexdigest()
    return sorted(((m[0], len(node), members[node[:-1]][0] if node else None, len(m), kids[node], leaves[node], saved[node], sha(node)) for node, m in members.items()), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op12_conversation_trie(spark, sf)
    assert dict(df.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}
    assert shown(df) == brute(rows)


ROWS = [
    *[(c, t, "user", f"q {t % 3} x") for c in (0, 1, 2, 3, 20, 21, 22, 23, 24, 25, 26) for t in range(6)],
    *[(c, t, "user" if t else None, None if t == 2 else "a b\tc") for c in (40, 41, 42, 43, 44, 45) for t in range(3)],
    *[(c, 0, "user", "alone") for c in range(60, 90)],  # conversations whose turns all go
    *[(c, None, "system", "s") for c in (100, 101, 102)], *[(c, t, "user", "u") for c in (100, 101, 102, 103) for t in (-5, 0, 7)],
    *[(-c, t, "user", f"n{c % 2}") for c in (5, 6, 7, 20, 25) for t in range(4)],
    (101, 7, "user", "u"), (101, 7, "user", "u"), (None, 1, "user", "lost"), (10**15 + 7, 1, "user", ""),
    *[(300, t, "user", f"{t}") for t in range(150)], *[(305, t, "user", f"{t}") for t in range(150)], *[(311, t, "user", f"{min(t, 140)}") for t in range(160)],
]


@pytest.mark.parametrize("run", [8, 64])
def test_edges(spark, run):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    df = df.select("*", F.lit(1).alias("conv"), F.lit("x").alias("depth"), F.struct(F.lit(1).alias("a b")).alias("x1")).repartition(3)
    found = C.trie(df, run=run)
    assert shown(found) == brute(ROWS)
    rows = found.collect()
    at = {r.preorder: r for r in rows}
    assert sorted(at) == list(range(len(rows)))
    for r in rows:  # subtrees are intervals of the preorder
        own = [at[i] for i in range(r.preorder, r.subtree_end)]
        assert len([x for x in own if not x.n_children]) == r.n_leaves and all(x.depth > r.depth for x in own[1:])
        assert r.subtree_end == len(rows) or at[r.subtree_end].depth <= r.depth


def test_empty(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert C.trie(df.where("false")).count() == 0
    only = [(3, 0, "user", "x")]
    assert shown(C.trie(df.where("conv_id = 61"))) == brute([(61, 0, "user", "alone")])
    assert shown(C.trie(spark.createDataFrame(only, df.schema))) == brute(only)


def test_one_group_in_many_ranges(spark):
    """A group with most rows is scanned in several tasks, and its running values go on."""
    rows = written(spark.range(5000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 4500, F.col("id")).cast("long").alias("g"), ((F.col("id") * 7919) % 5000).alias("i"), (F.col("id") % 13 - 6).alias("v")), "rows")
    found = scanned(rows.withColumn("one", F.lit(1).cast("long")), ["g", "i"], ["g"], {"s": ("sum", "v"), "x": ("xor", "v")}, {"all": ("sum", "v"), "n": ("sum", "one")})
    s, x, n, total, before = 0, 0, 0, 0, "none"
    for r in sorted(found.collect(), key=lambda r: (r.g is not None, r.g or 0, r.i)):
        s, x = (s + r.v, x ^ r.v) if r.g == before else (r.v, r.v)
        n, total, before = n + 1, total + r.v, r.g
        assert (r.s, r.x, r.all, r.n) == (s, x, total, n)


def test_repeated_rows_are_dealt(spark):
    rows = written(spark.range(2000).select(F.lit(1).cast("long").alias("g"), F.lit(1).cast("long").alias("one")), "rows")
    found = scanned(rows, ["g"], ["g"], {"n": ("sum", "one")})
    assert sorted(r.n for r in found.collect()) == list(range(1, 2001))
