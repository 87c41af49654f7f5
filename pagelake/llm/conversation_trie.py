"""Prefix trie of conversations (12): preorder intervals from lexicographic ranks and distributed prefix sums.

A node is a distinct beginning of conversations: its key is the depth and two XORs, over its turns, of 64-bit digests of (turn, place), so keys of
all beginnings are running XORs within a conversation and no beginning is ever written out.

1. Turns become slim rows (conversation, turn, role, digests, words); running counts within a conversation give their places.
2. Conversations take over the first turns of their base (`rebuilt`), and running XORs give each turn the key of its node and of the parent's.
3. Conversations are ranked lexicographically by the digests of their turns: runs of `RUN` turns are joined into a key and replaced by the key's
   rank, again and again, until a conversation is one key; equal ones share a rank. No group ever holds more than `RUN` turns.
4. A node's members have a run of ranks, first to last. In the order of (first, depth) nodes stand in preorder, and a subtree ends where the
   nodes with first <= last end. Running counts of nodes, leaves and savings over both kinds of events (a node begins, a subtree ends) give, as differences,
   each subtree's leaves and savings, its place in preorder and its end.

All running values are `scans.scanned`: no window or group holds a conversation or the members of a node. The ids that end at a node are sorted by ranges and
joined in pieces; a digest over all of them is fed piece by piece.

Defined results: null roles and texts count as empty; rows without a conversation's id belong to none and are left out; turns of equal number (null
first) stand in the order of their roles, then of their texts' digests; repeated rows are turns by themselves; a conversation without a turn
left is a member of the root alone; negative ids have their base towards zero; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import col, scratch, spread, with_found, written
from pagelake.llm.scans import scanned

RUN, PIECE_IDS = 64, 1 << 16
BASES, MOST_SHARED = 20, 4
KEY = ["depth", "x1", "x2"]
WORDS = r"[^\x20\x09-\x0D]+"


def ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, d1, d2 (digests of role and text), words, place (from 1) of all turns."""
    rows = df.select(col(conv_col).cast("long").alias("conv"), col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv IS NOT NULL").select(
        "conv", "turn", "role", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit("turn"), "text", "role").alias("d2"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"), F.lit(1).cast("long").alias("one")
    )
    order = ["conv", "turn", "role", "d1", "d2"]
    return scanned(written(rows, "turns"), order, ["conv"], {"place": ("sum", "one")}).select("conv", "d1", "d2", "words", "place")


def shared(conv: Column | str = "conv") -> Column:
    """How many first turns a conversation takes from its base."""
    return F.pmod(F.crc32(F.encode(F.col(conv).cast("string") if isinstance(conv, str) else conv, "UTF-8")), F.lit(MOST_SHARED)).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, d1, d2, words) of the rebuilt conversations, and the conversations (conv, length)."""
    turn = F.struct("d1", "d2", "words")
    firsts = [F.max(F.when(F.col("place") == i, turn)).alias(f"t{i}") for i in range(1, MOST_SHARED)]
    convs = written(turns.groupBy("conv").agg(F.max("place").alias("n"), *firsts), "conversations")
    bases = convs.where(F.col("conv") % BASES == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.array(*(f"t{i}" for i in range(1, MOST_SHARED))).alias("head"))
    own = convs.select("conv", "n", shared().alias("h"))
    planned = own.join(bases, F.col("conv") - F.col("conv") % BASES == F.col("base"), "left")
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)).cast("int"))
    planned = planned.select("conv", taken.alias("taken"), (taken - F.col("h")).alias("shift"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"), "head")
    planned = written(planned, "planned")
    head = planned.where("taken > 0").select("conv", F.posexplode(F.slice("head", F.lit(1), F.col("taken"))).alias("i", "t")).select("conv", (F.col("i") + 1).cast("long").alias("depth"), "t.*")
    # only conversations whose base has too few turns are moved
    moved = planned.where("shift <> 0").select(F.col("conv").alias("_conv"), "shift")
    rest = turns.where(F.col("place") > shared()).join(moved, F.col("conv") == F.col("_conv"), "left")
    rest = rest.select("conv", (F.col("place") + F.coalesce("shift", F.lit(0))).cast("long").alias("depth"), "d1", "d2", "words")
    return written(head.unionByName(rest), "rebuilt"), planned.select("conv", "length")


def keyed(rows: DataFrame) -> DataFrame:
    """Adds x1, x2 (with the depth, the node's key) and p1, p2 (the parent's)."""
    salted = rows.select("*", F.xxhash64("d1", "d2", "depth").alias("o1"), F.xxhash64("depth", "d2", "d1").alias("o2"))
    found = scanned(salted, ["conv", "depth"], ["conv"], {"x1": ("xor", "o1"), "x2": ("xor", "o2")})
    return found.select("conv", *KEY, F.col("x1").bitwiseXOR(F.col("o1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("o2")).alias("p2"), "words")


def ranked(rows: DataFrame, convs: DataFrame, run: int = RUN) -> DataFrame:
    """conv, rank: conversations with a turn in the lexicographic order of their turns' digests; equal ones share a rank."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    longest = convs.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    keys = rows.select("conv", (F.col("depth") - 1).alias("i"), F.concat(digits("d1"), digits("d2")).alias("key"))
    while True:
        of_run = keys.groupBy("conv", F.floor(F.col("i") / run).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "key"))).alias("keys"))
        joined = of_run.select("conv", "i", F.array_join(F.col("keys.key"), "").alias("key"), F.lit(1).cast("long").alias("one"))
        counts = scanned(written(joined, "runs"), ["key", "conv", "i"], ["key"], {"own": ("sum", "one")}, {"all": ("sum", "one")})
        ranks = counts.select("conv", "i", (F.col("all") - F.col("own")).alias("rank"))
        longest = -(-longest // run)
        if longest <= 1:
            return ranks.select("conv", "rank")
        keys = ranks.select("conv", "i", digits("rank").alias("key"))


def digests(ends: DataFrame) -> DataFrame:
    """Key and sha (of the ids, ascending, joined by commas) of the rows (key, conv): ids meet in pieces, in the order of ranges."""
    names = [*KEY, "at", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.string()], strict=True)], names=names)

        for batch in batches:
            for *own, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own != key or len(held) == PIECE_IDS:
                    if held:
                        done.append((*key, held[0], ",".join(map(str, held))))
                    key, held = own, []
                held.append(conv)
            if len(done) >= 1000:
                yield batch_of()
                done.clear()
        if held:
            done.append((*key, held[0], ",".join(map(str, held))))
        yield batch_of()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for *own, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if len(done) >= 10_000:
                yield rows_of(done)
                done = []
        if state:
            done.append((*key, state.hexdigest()))
        yield rows_of(done)

    def rows_of(done: list) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 3, pa.string()], strict=True)], names=[*KEY, "sha"])

    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.repartitionByRange(tasks, *KEY, "conv").sortWithinPartitions(*KEY, "conv")
    cut = rows.mapInArrow(pieces, "depth long, x1 long, x2 long, at long, ids string")
    return spread(cut, *KEY).sortWithinPartitions(*KEY, "at").mapInArrow(hashes, "depth long, x1 long, x2 long, sha string")


def trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder (from 0) and subtree_end (exclusive)."""
    zero = F.lit(0).cast("long")
    with scratch(df.sparkSession) as kept:
        rows, convs = rebuilt(ordered(df, conv_col, turn_col, role_col, text_col))
        ranks = ranked(rows, convs, run).join(convs.select(F.col("conv").alias("_conv"), "length"), F.col("conv") == F.col("_conv"))
        members = written(keyed(rows).join(ranks.select("_conv", "rank", "length"), F.col("conv") == F.col("_conv")), "members")
        nodes = members.groupBy(*KEY).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
        )
        everyone = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
        root = everyone.select(*(zero.alias(k) for k in KEY), "conv_id", "n_convs", zero.alias("words"), F.lit(-1).cast("long").alias("first"), F.lit((1 << 63) - 1).alias("last"), zero.alias("p1"), zero.alias("p2"))
        nodes = written(nodes.unionByName(root), "nodes")

        # children, and each node's parent: parents of very many children by a broadcast
        parent_of = [(F.col("depth") - 1).alias("pd"), "p1", "p2"]
        below = nodes.where("depth > 0").select(*parent_of).groupBy("pd", "p1", "p2").agg(F.count(F.lit(1)).alias("n_children"))
        own = nodes.select("depth", "x1", "x2", F.col("conv_id").alias("parent_conv_id"))
        parents = below.join(own, (F.col("pd") == F.col("depth")) & (F.col("p1") == F.col("x1")) & (F.col("p2") == F.col("x2"))).select("pd", "p1", "p2", "n_children", "parent_conv_id")
        parents = written(parents, "parents")
        counted = nodes.join(parents.select(F.col("pd").alias("_d"), F.col("p1").alias("_1"), F.col("p2").alias("_2"), "n_children"), (F.col("depth") == F.col("_d")) & (F.col("x1") == F.col("_1")) & (F.col("x2") == F.col("_2")), "left")
        counted = counted.select(*KEY, "conv_id", "n_convs", "first", "last", (F.col("depth") - 1).alias("pd"), "p1", "p2", F.coalesce("n_children", zero).alias("n_kids"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
        full = with_found(written(counted, "counted"), ["pd", "p1", "p2"], parents, "n_children")

        # events: a node begins (with its values), its subtree ends
        own = ["conv_id", "n_convs", "n_kids", "parent_conv_id"]
        begin = full.select(F.col("first").alias("rank"), zero.alias("kind"), F.col("depth").alias("level"), *KEY, *own, F.when(F.col("n_kids") == 0, 1).otherwise(0).cast("long").alias("leaf"), "saving", (zero + 1).alias("one"))
        none = [F.lit(None).cast("long").alias(c) for c in own]
        end = nodes.select(F.col("last").alias("rank"), (zero + 1).alias("kind"), zero.alias("level"), *KEY, *none, zero.alias("leaf"), zero.alias("saving"), zero.alias("one"))
        events = written(begin.unionByName(end), "events")
        sums = scanned(events, ["rank", "kind", "level", *KEY], [], {}, {"leaves": ("sum", "leaf"), "savings": ("sum", "saving"), "count": ("sum", "one")})

        last = members.where(F.col("depth") == F.col("length")).select(*KEY, "conv").unionByName(convs.where("length = 0").select(*(zero.alias(k) for k in KEY), "conv"))
        shas = digests(last)
        both = sums.select(*KEY, *own, "kind", F.col("leaves") - F.col("leaf"), "leaves", F.col("savings") - F.col("saving"), "savings", "count", F.lit(None).cast("string").alias("sha"))
        both = both.toDF(*KEY, *own, "kind", "leaves_before", "leaves", "savings_before", "savings", "count", "sha")
        both = both.unionByName(shas, allowMissingColumns=True)
        when = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        found = both.groupBy(*KEY).agg(
            *(F.max(c).alias(c) for c in own), (when(1, "leaves") - when(0, "leaves_before")).alias("n_leaves"), (when(1, "savings") - when(0, "savings_before")).alias("saved_tokens"),
            (when(0, "count") - 1).alias("preorder"), when(1, "count").alias("subtree_end"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
        found = found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_kids").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256", "preorder", "subtree_end")
        found = written(found, "trie")
        kept.append(found)
    return found
