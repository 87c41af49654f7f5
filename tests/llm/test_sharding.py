from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagelake.llm import queries, sharding as S


def rebalanced(home, sizes, n_shards):
    """slot -> shard after a rebalancing, step by step. home: slot -> shard; sizes: slot -> bytes."""
    target = -(-sum(sizes.values()) // n_shards)
    load, out, over = [0] * n_shards, {}, []
    for slot in sorted(home, key=lambda s: (-sizes.get(s, 0), s)):
        if load[home[slot]] + sizes.get(slot, 0) <= target:
            out[slot] = home[slot]
            load[home[slot]] += sizes.get(slot, 0)
        else:
            over.append(slot)
    for slot in over:
        out[slot] = load.index(min(load))
        load[out[slot]] += sizes.get(slot, 0)
    return out


def hashed(spark, rows, n_slots):
    """The slot of each (id, size, crc, run), by Spark's hash on a table of its own."""
    df = spark.createDataFrame(rows, "i long, size long, crc long, run long")
    return {tuple(r)[:4]: r.slot for r in df.withColumn("slot", F.pmod(F.xxhash64("i", "crc", "size", "run"), F.lit(n_slots))).collect()}


def expected(spark, docs, shard_of, n_slots=S.N_SLOTS):
    """Rows (id, size, crc, shard, place, slot) of all documents, placed one by one."""
    copies = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    runs = [(i, size, crc, k) for (i, size, crc), n in copies.items() for k in range(-(-n // S.REPEATS))]
    slot = hashed(spark, runs, n_slots)
    in_slot = defaultdict(list)
    for i, size, crc, k in runs:
        n = copies[i, size, crc]
        in_slot[slot[i, size, crc, k]].append(((i is not None, i), crc, size, k, min(S.REPEATS, n - k * S.REPEATS), i))
    sizes = {s: sum(x[2] * x[4] for x in own) for s, own in in_slot.items()}
    shards, out, at = shard_of(sizes), [], Counter()
    for s in sorted(in_slot):
        for _, crc, size, _, n, i in sorted(in_slot[s], key=lambda x: x[:4]):
            for _ in range(n):
                out.append((i, size, crc, shards[s], at[shards[s]], s))
                at[shards[s]] += 1
    return sorted(out, key=str)


def first(n_shards, n_slots=S.N_SLOTS):
    return {s: s * n_shards // n_slots for s in range(n_slots)}


def shown(df):
    return sorted([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.vslot) for r in df.collect()], key=str)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op7_virtual_slots(spark, sf)
    assert shown(got) == expected(spark, docs, lambda sizes: rebalanced(first(8), sizes, 8))
    rows = got.collect()
    assert {(r.law, r.grown_shard, r.map_version) for r in rows} == {("bytes", None, 2)}
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    assert max(total[k] for k in range(8)) - min(total[k] for k in range(8)) <= max(r.size for r in rows)


def test_a_stored_map_places_a_grown_table(spark, sf, tmp_path):
    folder, n = f"file://{tmp_path}/maps", 256
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    small = docs.where("doc_id < 40")
    assert S.store_map(S.first_map(S.slot_sizes(S.measured(small, n_slots=n)), 8, n), folder) == 1
    old = S.stored_map(spark, folder, 1)
    assert old.count() == n
    got = S.shard_rows(docs, old, n_slots=n)
    assert shown(got) == expected(spark, docs.collect(), lambda sizes: first(8, n), n)  # every row once, in version 1's shards, without gaps
    assert S.store_map(S.rebalanced(S.resized(old, S.slot_sizes(S.measured(docs, n_slots=n))), 8), folder) == 2
    new = S.stored_map(spark, folder, 2)
    assert shown(S.shard_rows(docs, new, n_slots=n)) == expected(spark, docs.collect(), lambda sizes: rebalanced(first(8, n), sizes, 8), n)
    assert {r.version for r in S.stored_map(spark, folder, 1).collect()} == {1} and old.count() == new.count() == n
    with pytest.raises(ValueError, match="no version 3"):
        S.stored_map(spark, folder, 3).count()
    with pytest.raises(Exception, match="the map has no slot"):
        S.shard_rows(docs, new.where("vslot < 100"), n_slots=n).collect()


def test_rebalancing_moves_little(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"))
    one = S.first_map(S.slot_sizes(S.measured(docs, n_slots=512)), 4, 512)
    before, after = one.collect(), S.rebalanced(one, 4).collect()
    home = {r.vslot: r.shard for r in before}
    assert {r.vslot for r in after} == set(home) == set(range(512)) and {r.version for r in after} == {2} and {r.vslot: r.bytes for r in after} == {r.vslot: r.bytes for r in before}
    assert {r.vslot: r.shard for r in after} == rebalanced(home, {r.vslot: r.bytes for r in before}, 4)
    was = [sum(r.bytes for r in before if r.shard == k) for k in range(4)]
    target = sum(was) / 4
    assert sum(r.bytes for r in after if home[r.vslot] != r.shard) <= sum(max(0, x - target) for x in was) + 4 * max(r.bytes for r in after)
    again = S.rebalanced(spark.createDataFrame(after, S.MAP), 4).collect()
    assert {r.version for r in again} == {3} and sum(r.shard != {x.vslot: x.shard for x in after}[r.vslot] for r in again) <= 8


def test_edges(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (1, "a"), (2, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, size int, shard int, _id int")
    slot_map = S.rebalanced(S.first_map(S.slot_sizes(S.measured(df)), 8), 8)
    assert shown(S.shard_rows(df, slot_map)) == expected(spark, rows, lambda sizes: rebalanced(first(8), sizes, 8))
    none = df.where("false")
    assert S.shard_rows(none, S.rebalanced(S.first_map(S.slot_sizes(S.measured(none)), 8), 8)).collect() == []


def test_equal_rows_are_spread(spark):
    df = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    slot_map = S.rebalanced(S.first_map(S.slot_sizes(S.measured(df)), 8), 8)
    got = S.shard_rows(df, slot_map).collect()
    loads = Counter(r.shard for r in got)
    assert len(got) == 2000 and len(loads) == 8 and max(loads.values()) - min(loads.values()) <= S.REPEATS
    assert len({(r.shard, r.slot) for r in got}) == 2000
