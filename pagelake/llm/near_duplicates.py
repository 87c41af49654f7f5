"""N-gram Jaccard join (10): a prefix-tree join over globally ordered shingle sets, exact at any size.

A document's set holds the 64-bit digests of its word shingles; documents with equal sets are one node. Two nodes link
when intersection >= threshold x union, so neither may miss more than a quarter (at 0.75) of its shingles in the other.

1. Sets. Each text is shingled once; its first digests in numeric order (those below `REGION`, 3/8 of the digest space, or more
   where a prefix needs them) are kept. Tasks also count digests in runs of texts; those that have many in some run are summed, and
   the hot ones (at least `hot_at` nodes and a millionth of all digests, so a million of them at most) are broadcast.
2. Sift. The kept digests are dealt with their nodes to buckets of digests; what no other node has is counted against its node. A
   node that already lacks too many has no link and is done. Hot digests are shared for certain and go to their nodes at once, so
   no bucket gets more pairs of a digest than hot_at and a thirty-thousandth of all.
3. Candidates. The global order puts the region's digests first, rarest first, then the hot ones, then those beyond the region. Two
   sets that link share a digest among the first floor(n/4) + 1 of either. Survivors post those; nodes under one digest whose
   sizes are close enough are joined to a candidate group (connected components). Each task joins its own nodes first and posts a
   run of close sizes under a digest as one interval, so a digest that all nodes have gives a task a few rows, not one a node.
4. Prefix-tree join. A group's whole sets, in a common order, are stored in a path-compressed trie (see prefix_tree.py). Queries go
   on until every node outside the group's largest component has been asked, so no link between two components can be missed.
   Groups beyond `most_tokens` or `most_sets` are cut into blocks by size classes and hashes: each block is joined by itself, hubs of a
   few sets a block tie the blocks together, level by level, and whoever isn't tied to them is asked against the other blocks of its
   own and the neighbouring classes.
5. Components of the links found give each document the smallest id it can reach.

Numbers travel as packed arrays (see packed.py); no task holds more than a bucket, a block or a hub. A node is named by half of a
128-bit digest of its set; sets that share this half but not the other are found and named by the other, so unlike sets never
are one node. Shingle digests can collide: two given sets of n shingles with a chance of about n^2 / 2^64.

Defined results: a null or empty text, or one without words, has n_shingles 0 and is its own component; a text of fewer
words than a shingle has one, the whole; repeated rows are copies of each other; rows that share an id but not the text
are different nodes of one id; a row with a null id takes part but lends no id to its component, whose id is null if there
is no other; an empty table gives an empty table; other columns of the input are left aside.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import claim, col, fields, marked, scratch, spread, written
from pagelake.llm.components import components
from pagelake.llm.packed import ARROW, SCHEMA, deal, gather, unpacked
from pagelake.llm.prefix_tree import Trie, Union, ask, edge_batch, link
from pagelake.llm.shingles import powers, sets_of

__all__ = ["Trie", "near_duplicates", "one_of_each"]

SIZE, PERCENT = 5, 75
REGION = np.uint64(3 << 61)
HOT = np.uint32(0xFFFFFFFF)
EDGES = "a long, b long"
#: Kinds of packed rows: pairs of digest and node (or intervals), nodes with their sizes, hot pairs, edges.
PAIRS, SIZED, HOT_PAIRS, FOREST = range(4)


def halves(digests: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The two halves of a set's 128-bit name; tests ask for a first half of fewer bits."""
    name = hashlib.blake2b(digests.tobytes(), digest_size=16).digest()
    half = int.from_bytes(name[:8], "little", signed=True)
    return half if bits == 64 else half % (1 << bits), int.from_bytes(name[8:], "little", signed=True)


def may_miss(n, percent: int = PERCENT):
    """How many of its n digests a set may lack in a set that it links to."""
    return n - (n * percent + 99) // 100


def batches_of(found: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(found), schema=ARROW)


# ---------------------------------------------------------------- 1: sets


def shapes_of(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, node_bits: int, run: int, many: int) -> DataFrame:
    """Of every row doc_id, text_hash (Spark's xxhash64), n, region (how many digests lie in the region), node and other (the halves of
    its set's name), own (the first digests, where a task sees the set first). Rows of n = -1 have digests (own) that at least `many` sets
    of a run have, and their counts."""
    names = ["doc_id", "text_hash", "n", "region", "node", "other", "own", "counts"]
    kinds = [None, *[pa.int64()] * 5, pa.binary(), pa.binary()]

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_duplicates", powers.cache_clear)
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        count, id_type = 0, None

        def common() -> pa.RecordBatch:
            digests, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= many
            columns = [pa.nulls(1, id_type), *(pa.array([x], pa.int64()) for x in (None, -1, None, None, None)), *(pa.array([x.tobytes()], pa.binary()) for x in (digests[often], counts[often].astype(np.uint32)))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_type = batch.column(0).type
            columns: list[list] = [[], [], [], [], []]
            for digests in sets_of(batch.column(2), size):
                n = len(digests)
                region = int(np.searchsorted(digests, REGION))
                name, own = (halves(digests, node_bits) if n else (None, None)), None
                if n and name not in seen:
                    seen.add(name)
                    first = digests[: max(region, may_miss(n, percent) + 1)]
                    held.append(first)
                    count += len(first)
                    own = first.tobytes()
                for column, x in zip(columns, (n, region, *name, own), strict=True):
                    column.append(x)
            arrays = [batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(columns, kinds[2:7], strict=True)), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            if count >= run:
                yield common()
                held, count = [], 0
            if len(seen) > 200_000:
                seen = set()
        if held:
            yield common()

    rows = df.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col).alias("text"))
    return rows.mapInArrow(shape, fields([("doc_id", df.schema[id_col].dataType)], "text_hash long, n long, region long, node long, other long, own binary, counts binary"))


def nodes_of(shapes: DataFrame) -> DataFrame:
    """A row a node: n, region, the least id, one row's id and text as hashes, and the least and greatest other half of its name."""
    return shapes.where("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("region").alias("region"), F.min("doc_id").alias("first_id"), F.min(F.struct(F.xxhash64("doc_id").alias("h_id"), F.col("text_hash").alias("h_text"))).alias("at"),
        F.min("other").alias("other"), F.max("other").alias("_other"),
    )


def told_apart(shapes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets that share the first half of their names, but not the other, get the other half as their node."""
    shared = nodes.where("other != _other").select(F.col("node").alias("_shared"))
    if shared.isEmpty():
        return shapes, nodes
    renamed = shapes.join(F.broadcast(shared) if shared.count() <= 100_000 else shared, F.col("node") == F.col("_shared"), "left")
    shapes = renamed.withColumn("node", F.when(F.col("_shared").isNotNull(), F.col("other")).otherwise(F.col("node"))).select(*shapes.columns)
    nodes = written(nodes_of(shapes), "nodes")
    if not nodes.where("other != _other").isEmpty():
        raise RuntimeError("sets of both halves alike")
    return shapes, nodes


def hot_digests(shapes: DataFrame, total: int, hot_at: int) -> np.ndarray:
    """The digests with a certain count of at least `hot_at` and a millionth of `total`; so there are a million at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (digest,), (n,) = unpacked(batch.column(0), ["i8"]), unpacked(batch.column(1), ["u4"])
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(n.astype(np.int64))], names=["digest", "n"])

    counted = shapes.where("n < 0").select("own", "counts").mapInArrow(rows, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(hot_at, -(-total // 1_000_000))).select("digest").toPandas()["digest"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


# ---------------------------------------------------------------- 2, 3: sift and candidates


def post(shapes: DataFrame, hot: np.ndarray, n_buckets: int, run: int) -> DataFrame:
    """(digest, node) by digest, and hot ones by node."""
    sent = shapes.sparkSession.sparkContext.broadcast(hot)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, count = sent.value, [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            digest, node = (np.concatenate(x) for x in zip(*held, strict=True))
            often = known[np.minimum(np.searchsorted(known, digest), len(known) - 1)] == digest if len(known) else np.zeros(len(digest), bool)
            yield from deal(digest[~often], n_buckets, [digest[~often], node[~often]], PAIRS)
            yield from deal(node[often], n_buckets, [node[often], digest[often]], HOT_PAIRS)

        for batch in batches:
            own = batch.column(1)
            (digests,) = unpacked(own, ["u8"])
            places = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, 4 * own.offset) if len(own) else np.zeros(1, np.int32)
            held.append((digests, np.repeat(batch.column(0).to_numpy(), np.diff(places) // 8)))
            count += len(digests)
            if count >= run:
                yield from dealt()
                held, count = [], 0
        if held:
            yield from dealt()

    return shapes.where("own IS NOT NULL AND n > 0").select("node", "own").mapInArrow(rows, SCHEMA)


def distinct(*arrays: np.ndarray) -> list[np.ndarray]:
    """Distinct rows, sorted by the first array, then by the next."""
    order = np.lexsort(arrays[::-1])
    arrays = [a[order] for a in arrays]
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([a[1:] != a[:-1] for a in arrays], axis=0)
    return [a[fresh] for a in arrays]


def shared(table: pa.Table, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Of a bucket of (digest, node): those whose digest has two nodes or more, with their number, dealt by node; hot pairs as they are."""
    digest, node = distinct(*gather(table, ["u8", "i8"], PAIRS))
    starts = np.flatnonzero(np.append(True, digest[1:] != digest[:-1])) if len(digest) else np.empty(0, np.int64)
    runs = np.diff(np.append(starts, len(digest)))
    df = np.repeat(runs, runs)
    keep = df > 1
    yield from deal(node[keep], n_buckets, [node[keep], digest[keep], np.minimum(df[keep], HOT - 1).astype(np.uint32)], PAIRS)
    node, digest = gather(table, ["i8", "u8"], HOT_PAIRS)
    yield from deal(node, n_buckets, [node, digest, np.full(len(node), HOT)], PAIRS)


def prefixes(table: pa.Table, n_buckets: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of a bucket of nodes: the survivors' prefixes, without digests that no other node has, as intervals (digest, a node, least and
    greatest n), and a forest (a, b) that ties the nodes of each interval together."""
    node, digest, df = distinct(*gather(table, ["i8", "u8", "u4"], PAIRS))
    known, n, region = gather(table, ["i8", "u4", "u4"], SIZED)
    known, first = np.unique(known, return_index=True)
    n, region = n[first].astype(np.int64), region[first].astype(np.int64)
    late = (digest >= REGION) | (df == HOT)  # after all others, in numeric order
    order = np.lexsort((digest, np.where(late, 0, df), late, node))
    node, digest = node[order], digest[order]
    beyond, of = digest >= REGION, np.searchsorted(known, node)
    lacking = region - np.bincount(of[~beyond], minlength=len(known))
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    missable = may_miss(n, percent)
    keep = (lacking <= missable)[of] & (beyond | (rank < (missable + 1 - lacking)[of]))
    digest, node, n = digest[keep], node[keep], n[of[keep]]
    order = np.lexsort((n, digest))
    digest, node, n = digest[order], node[order], n[order]
    close = (digest[1:] == digest[:-1]) & (100 * n[:-1] >= percent * n[1:])
    starts = np.flatnonzero(np.append(True, ~close)) if len(digest) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(digest)) - 1 if len(digest) else starts
    yield from deal(digest[starts], n_buckets, [digest[starts], node[starts], n[starts].astype(np.uint32), n[ends].astype(np.uint32)], PAIRS)
    a, b = forest(node[:-1][close], node[1:][close])
    yield from deal(a, n_buckets, [a, b], FOREST)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that join what the pairs join."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    union, n = Union(len(names)), len(a)
    for i, j in np.unique(np.stack([at[:n], at[n:]], axis=1), axis=0).tolist() if n else ():
        union.join(i, j)
    roots = names[[union.find(i) for i in range(len(names))]] if len(names) else names
    return names[names != roots], roots[names != roots]


def candidates(table: pa.Table, percent: int) -> pa.Table:
    """A forest of the nodes of a bucket's intervals that touch under a digest, and of its edges."""
    digest, node, least, most = gather(table, ["u8", "i8", "u4", "u4"], PAIRS)
    order = np.lexsort((least, digest))
    digest, node, least, most = digest[order], node[order], least[order].astype(np.int64), most[order].astype(np.int64)
    if len(digest):  # the greatest size so far under the same digest
        of = np.cumsum(np.append(0, digest[1:] != digest[:-1])) << 32
        most = np.maximum.accumulate(of + most) - of
    touch = (digest[1:] == digest[:-1]) & (100 * most[:-1] >= percent * least[1:])
    a, b = gather(table, ["i8", "i8"], FOREST)
    a, b = forest(np.concatenate([a, node[:-1][touch]]), np.concatenate([b, node[1:][touch]]))
    return pa.table({"a": a, "b": b})


# ---------------------------------------------------------------- 4: prefix-tree join


def sets_in(table: pa.Table, mask: np.ndarray | None = None) -> tuple[list[int], list[np.ndarray]]:
    """The distinct nodes of a group and their sets."""
    rows = np.arange(len(table)) if mask is None else np.flatnonzero(mask)
    nodes, first = np.unique(table.column("node").to_numpy()[rows], return_index=True)
    digests = table.column("digests")
    return nodes.tolist(), [np.frombuffer(digests[int(rows[i])].as_buffer(), dtype=np.uint64) for i in first]


def join_group(table: pa.Table, percent: int) -> pa.Table:
    nodes, sets = sets_in(table)
    return pa.Table.from_batches([edge_batch(nodes, link(sets, percent))])


def join_block(table: pa.Table, percent: int, hub_sets: int) -> pa.Table:
    """One row a node of a block, or of a hub: label (its component's least node), state (0: outside the largest component, 1: in it, 2: one of
    the `hub_sets` that stand for it, with their digests). In a hub, nodes that come from one block are one already."""
    nodes, sets = sets_in(table)
    union = link(sets, percent)
    at = np.searchsorted(nodes, table.column("node").to_numpy())
    home = np.zeros(len(nodes), np.int64)
    home[at] = table.column("home").to_numpy()
    if "hub" in table.column_names:
        order = np.argsort(home, kind="stable")
        for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            if home[i] == home[j]:
                union.join(i, j)
    roots = np.array([union.find(i) for i in range(len(nodes))])
    label = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(label, roots, np.array(nodes, np.int64))
    label = label[roots]
    names, counts = np.unique(label, return_counts=True)
    main = label == names[counts.argmax()]
    state = main.astype(np.int32)
    few = np.flatnonzero(main)[np.argsort([halves(sets[i])[1] for i in np.flatnonzero(main)], kind="stable")[:hub_sets]]
    state[few] = 2
    digests = pa.array([sets[i].tobytes() if state[i] == 2 else None for i in range(len(nodes))], pa.binary())
    first = np.unique(at, return_index=True)[1]
    kept = [table.column(c).take(pa.array(first)) for c in ("root", "n", "class", "home")]
    block = table.column("hub" if "hub" in table.column_names else "home").take(pa.array(first))
    return pa.table([pa.array(nodes, pa.int64()), *kept, block, pa.array(label), pa.array(state), digests], names=["node", "root", "n", "class", "home", "block", "label", "state", "digests"])


def ask_group(table: pa.Table, percent: int) -> pa.Table:
    """Rows of a block, and of queries from other blocks (asked)."""
    asked = table.column("asked").to_numpy(zero_copy_only=False)
    (queries, wanted), (nodes, stored) = sets_in(table, asked), sets_in(table, ~asked)
    return pa.Table.from_batches([edge_batch([*queries, *nodes], ask(wanted, stored, percent))])


def size_class(n: Column, percent: int) -> Column:
    """Sets that link lie in the same class or in neighbouring ones: a class is a little wider than the least share of sizes."""
    return F.floor(F.log(n) / math.log(101 / percent)).cast("int")


def blocked(members: DataFrame, percent: int, most_tokens: int, most_sets: int) -> DataFrame:
    """Adds class, n_blocks (of the class, where the group is cut) and home (a block's number in its group). `members`: node, root, n, ..."""

    def blocks(tokens: str, sets: str) -> Column:
        return F.ceil(F.greatest(F.col(tokens) / most_tokens, F.col(sets) / most_sets)).cast("long")

    members = members.withColumn("class", size_class(F.col("n"), percent))
    by_class = members.groupBy("root", "class").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sets"))
    by_class = written(by_class, "classes")
    whole = by_class.groupBy("root").agg(F.sum("tokens").alias("_tokens"), F.sum("sets").alias("_sets")).where(blocks("_tokens", "_sets") > 1).select(F.col("root").alias("_root"))
    large = by_class.join(whole, F.col("root") == F.col("_root")).select(F.col("root").alias("_root"), F.col("class").alias("_class"), blocks("tokens", "sets").alias("n_blocks"))
    large = written(large, "large-classes")  # so that a large group's join can be split
    at = members.join(large, (F.col("root") == F.col("_root")) & (F.col("class") == F.col("_class")), "left").drop("_root", "_class")
    return at.withColumn("home", F.when(F.col("n_blocks").isNotNull(), F.col("class") * F.lit(1 << 40) + F.pmod(F.xxhash64("node"), "n_blocks")).otherwise(F.lit(0)).cast("long"))


BLOCK = "node long, root long, n long, class int, home long, block long, label long, state int, digests binary"


def large_groups(whole: DataFrame, percent: int, most_tokens: int, most_sets: int, hub_sets: int = 8) -> DataFrame:
    """Links (a, b) of groups of several blocks. `whole`: a written table of node, root, n, class, n_blocks, home, digests.

    Each block is joined by itself; a few sets of each block's largest component meet in hubs of about `most_sets`, theirs in further hubs, until
    a group has one. What hangs together with its block's, its hub's and so on largest component up to the last one is tied together;
    whoever isn't is asked against all other blocks of sizes that may link. So the work beyond one pass grows with these outsiders, not
    with the square of the group."""
    links = []

    def joined(rows: DataFrame, *keys: str) -> DataFrame:
        found = written(spread(rows, *keys).groupBy(*keys).applyInArrow(lambda t: join_block(t, percent, hub_sets), BLOCK), "blocks")
        links.append(found.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        return found

    inside = joined(whole.select("node", "root", "n", "class", "home", "digests"), "root", "home")
    outside = inside.where("state = 0").select("node", "root", "n", "class", "home")
    level, ways = inside, []  # ways: of each level, who went up from which block
    while True:
        up = level.where("state = 2").select("node", "root", "n", "class", F.col("block").alias("home"), "digests")
        number = up.groupBy("root").agg(F.count_distinct("home").alias("_blocks")).select(F.col("root").alias("_root"), F.ceil(F.col("_blocks") * hub_sets / most_sets).alias("_hubs"), "_blocks")
        number = written(number.where("_blocks > 1"), "hubs")
        if number.isEmpty():
            break
        hub = F.pmod(F.xxhash64("home", F.lit(len(ways))), F.least("_hubs", F.floor(F.col("_blocks") / 2))).cast("long")
        level = joined(up.join(number, F.col("root") == F.col("_root")).withColumn("hub", hub).drop("_root", "_hubs", "_blocks"), "root", "hub")
        ways.append(level.groupBy("root", "home", "block").agg(F.max("state").alias("tied")))
    if ways:  # blocks that aren't tied to the last hub, by way of all between
        at = written(whole.select("root", "home").distinct().withColumn("at", F.col("home")).withColumn("lost", F.lit(False)), "ways")
        for way in ways:
            way = way.select(F.col("root").alias("_root"), F.col("home").alias("_from"), F.col("block").alias("_to"), "tied")
            at = at.join(way, (F.col("root") == F.col("_root")) & (F.col("at") == F.col("_from")), "left")
            at = at.select("root", "home", F.coalesce("_to", "at").alias("at"), (F.col("lost") | F.coalesce(F.col("tied") == 0, F.lit(False))).alias("lost"))
        lost = written(at.where("lost").select("root", "home"), "lost")
        if not lost.isEmpty():
            outside = outside.unionByName(inside.where("state > 0").select(*outside.columns).join(lost, ["root", "home"], "left_semi"))
    outside = written(outside, "outside")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    if outside.isEmpty():
        return found

    # outsiders meet the blocks of their and the neighbouring classes; where they are many, two blocks are taken together, and outsiders are cut as blocks are
    several = outside.groupBy("root").agg(F.least(F.lit(2), F.ceil(F.count(F.lit(1)) / most_sets)).cast("long").alias("_several")).withColumnRenamed("root", "_root")
    several = written(several, "several")
    at = F.col("class") * F.lit(1 << 40) + F.pmod(F.col("home"), F.greatest(F.lit(1), F.ceil(F.col("n_blocks") / F.col("_several"))).cast("long"))
    stored = whole.join(several, F.col("root") == F.col("_root")).select("root", "class", F.when(F.col("n_blocks") > 1, at).otherwise(F.col("class") * F.lit(1 << 40)).alias("block"), "node", "digests")
    kinds = stored.select(F.col("root").alias("_root"), F.col("class").alias("_class"), "block").distinct()
    kinds = written(kinds, "kinds")
    near = outside.withColumn("_near", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    asks = near.join(kinds, (F.col("root") == F.col("_root")) & (F.col("_near") == F.col("_class"))).select(F.col("node").alias("_node"), "root", "block", "n")
    chunks = written(asks.groupBy("root", "block").agg(F.ceil(F.greatest(F.sum("n") / most_tokens, F.count(F.lit(1)) / (2 * most_sets))).cast("int").alias("chunks")), "chunks")
    asks = asks.join(chunks, ["root", "block"]).select("_node", "root", F.col("block").alias("_block"), F.pmod(F.xxhash64("_node"), F.col("chunks")).cast("int").alias("chunk"))
    asked = whole.select("node", "digests").join(asks, F.col("node") == F.col("_node")).select("root", F.col("_block").alias("block"), "chunk", "node", "digests", F.lit(True).alias("asked"))
    stored = stored.join(chunks, ["root", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    stored = stored.select("root", "block", "chunk", "node", "digests", F.lit(False).alias("asked"))
    return found.unionByName(spread(asked.unionByName(stored), "root", "block", "chunk").groupBy("root", "block", "chunk").applyInArrow(lambda t: ask_group(t, percent), EDGES))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, bucket_tokens: int = 200_000, most_tokens: int = 250_000, most_sets: int = 256,
    hot_at: int = 50_000, run: int = 600_000, many: int = 16, node_bits: int = 64,
) -> DataFrame:
    """`id_col`, n_shingles, component_id, text_hash, component (a number that the rows of a component share) of every row."""
    with scratch(df.sparkSession) as kept:
        shapes = written(shapes_of(df, id_col, text_col, size, percent, node_bits, run, many), "shapes")
        shapes, nodes = told_apart(shapes, written(nodes_of(shapes), "nodes"))
        total, kept_digests = shapes.where("n >= 0").agg(F.coalesce(F.sum("region"), F.lit(0)), F.coalesce(F.sum(F.octet_length("own")) / 8, F.lit(0))).first()
        hot = hot_digests(shapes, int(kept_digests), hot_at)
        n_buckets = int(max(8, -(-total // bucket_tokens)))

        def deal_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node, n, region = (batch.column(i).to_numpy() for i in range(3))
                yield from deal(node, n_buckets, [node, n.astype(np.uint32), region.astype(np.uint32)], SIZED)

        pairs = post(shapes, hot, n_buckets, run).groupBy("bucket").applyInArrow(lambda t: batches_of(shared(t, n_buckets)), SCHEMA)
        sized = nodes.select("node", "n", "region").mapInArrow(deal_sizes, SCHEMA)
        survivors = pairs.unionByName(sized).groupBy("bucket").applyInArrow(lambda t: batches_of(prefixes(t, n_buckets, percent)), SCHEMA)
        groups = components(survivors.groupBy("bucket").applyInArrow(lambda t: candidates(t, percent), EDGES))

        members = groups.join(nodes.select("node", "n", "at", "first_id"), "node")
        routes = blocked(members, percent, most_tokens, most_sets).select("at.*", F.col("node").alias("_node"), "root", "n", "class", "n_blocks", "home")
        routes = written(routes, "routes")
        texts = df.select(F.xxhash64(col(id_col)).alias("h_id"), F.xxhash64(col(text_col)).alias("h_text"), col(text_col).alias("text"))
        texts = marked(texts, F.xxhash64("h_id", "h_text"), routes.select(F.xxhash64("h_id", "h_text"))).where("maybe")  # the others aren't dealt
        texts = texts.groupBy("h_id", "h_text").agg(F.first("text").alias("text"))  # a task sends each repeated row once
        columns = ["root", "n", "class", "n_blocks", "home"]
        routed = texts.join(routes.hint("shuffle_hash"), ["h_id", "h_text"]).select("text", "_node", *columns)

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(sets_of(batch.column(0), size))
                real = [i for i, (s, node) in enumerate(zip(found, batch.column(1).to_pylist(), strict=True)) if node in halves(s, node_bits)]
                rest = [batch.column(i).take(pa.array(real, pa.int64())) for i in range(1, 7)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([found[i].tobytes() for i in real], pa.binary())], names=["node", *columns, "digests"])

        whole = written(routed.mapInArrow(digest, "node long, root long, n long, class int, n_blocks long, home long, digests binary"), "members")
        links = spread(whole.where("n_blocks IS NULL").select("root", "node", "digests"), "root").groupBy("root").applyInArrow(lambda t: join_group(t, percent), EDGES)
        if not routes.where("n_blocks IS NOT NULL").isEmpty():
            links = links.unionByName(large_groups(whole.where("n_blocks IS NOT NULL"), percent, most_tokens, most_sets))
        linked = components(links)

        ids = linked.join(nodes.select("node", "first_id"), "node")
        least = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
        known = linked.join(least, "root").select("node", "component_id", F.col("root").alias("component"))
        by_node = nodes.select("node", "first_id").join(known, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("component", "node").alias("component"))
        by_node = written(by_node, "by-node")
        out = shapes.where("node IS NOT NULL").select("doc_id", "text_hash", "n", "node").join(by_node, "node", "left")
        alone = shapes.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
        columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "component"]
        found = written(out.select(*columns).unionByName(alone.select(*columns)), "near-duplicates")
        kept.append(found)
    return found.withColumnRenamed("doc_id", id_col)


def one_of_each(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay: of each component the row with its least id (a null one only if there is no other) and one text of it,
    once if it is repeated; documents without words all stay."""
    rows = df.select(F.struct(*(col(c) for c in df.columns)).alias("row"), F.xxhash64(col(id_col)).alias("h_id"), F.xxhash64(col(text_col)).alias("h_text"))
    rows = rows.withColumn("worded", F.coalesce(col("row").getField(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    best = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(col(id_col).isNull().alias("a"), col(id_col).alias("b"), F.col("text_hash").alias("c"))).alias("best"))
    stay = best.select(F.xxhash64("best.b").alias("h_id"), F.col("best.c").alias("h_text")).distinct()
    once = rows.where("worded").groupBy("h_id", "h_text").agg(F.first("row").alias("row"))  # a task sends each repeated row once
    kept = once.join(stay.hint("shuffle_hash"), ["h_id", "h_text"], "left_semi").select("row")
    return kept.unionByName(rows.where("NOT worded").select("row")).select("row.*")
