"""Document fingerprints (6, native): invertible Bloom lookup sketches of paragraphs.

A paragraph is a line; lines are cut further at every sentence end, so that an edit changes the parts that it touches
only. Each distinct paragraph digest goes into three cells of
a table of m cells; a cell holds a count, the XOR of its digests and the XOR of their checks. The sketches of two
versions are subtracted cell by cell; what they share cancels out, and peeling (a cell that holds one digest gives it
away, which frees others) recovers the digests that differ.

The fingerprint is the sketch of 12 cells, which has the same size for every text. The difference of two fingerprints is peeled first, row by row, unless far more digests seem to differ than it can hold.
Where peeling gets stuck, a larger sketch is made, subtracted and peeled: of 48, 192, 768, ... cells, four times as many after each failure. It begins with the size that
an estimate asks for (from the 16 least digests of either side, which tell about how many differ; the estimate decides nothing else). Pairs of more than `ROW_DIGESTS` digests don't
fit into a row's arrays: their cells are rows of (pair, cell), summed by a hash aggregate over rows that have been dealt by their pair once, so a round of peeling costs no
shuffle and no more than the digests that are left; a round peels one third of the table, so no digest is taken out twice. They begin with two cells a third for each
digest and grow by the same factor. `cells_edited` and `cells_next` say which size gave the digests away.

Likeness of two sets of digests A and B with d recovered differences: (|A| + |B| - d) / (|A| + |B| + d), the Jaccard similarity.

`next_of` gives each row the next one in descending order of ids without a global sort: rows are dealt into ranges of
ids by cut points, and each range also gets the first row of the range that follows. Repeated rows are combined before and
told apart again afterwards.

Defined results: a null text counts as empty; two texts without paragraphs are alike (1.0), one with and one without are
not (0.0); rows that share an id follow each other in the order of their texts' hashes, repeated rows one after the
other; null ids come last; in a table of one row the next document is the row itself; an empty table gives an empty
table; other columns of the input are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import col, marked, scratch, written

CELLS, GROWTH, TRIES, ROUNDS = 12, 4, 16, 64
#: Sketches that are made row by row: sizes by the factor GROWTH, and the most digests of a pair. SAMPLE: digests of a side that the first size is told from.
ROW_SIZES, ROW_DIGESTS, SAMPLE = 7, 40_000, 16
#: Cells for each digest that is thought to differ, in the first larger sketch: so one or two rounds of peeling do, and cells without a digest cost nothing.
ROOM = 4
#: Paragraph ends: line ends, and sentence ends of any script: a mark and blanks, or a full-width mark; closing quotes go with their sentence.
CLOSERS = r"[\"\\x27\u00bb\u2019\u201d)\\]\u300d\u300f\uff09]"
COMMON, MARKS, WIDE = ".!?\u2026", "[.!?\u2026\u0589\u061f\u06d4\u0964\u0965\u104b\u1362\u17d4]", "[\u3002\uff01\uff1f\uff61]"
#: Texts with one of these marks and closers, or with an ASCII closer in front of a blank, are cut by patterns, all others by plain replacements.
RARE, CLOSED = "[\u0589\u061f\u06d4\u0964\u0965\u104b\u1362\u17d4\u3002\uff01\uff1f\uff61\u00bb\u2019\u201d\u300d\u300f\uff09]", ('" ', "\\' ", ") ", "] ")
WIDE_ENDS, PARTS = rf"({WIDE}{CLOSERS}{{0,2}})(?!{WIDE}|{CLOSERS})", rf"\\n+| (?<={MARKS}{CLOSERS}{{0,2}} ) *"
CELL = "struct<c:bigint,n:bigint,k:bigint,h:bigint>"
PAIR = ["rid", "w"]


def digests(text: str) -> str:
    """SQL: the distinct paragraph digests of the text expression, sorted. The patterns are used only where plain replacements don't tell all ends."""
    plain = text
    for mark in COMMON:
        plain = f"replace({plain}, '{mark} ', '{mark}\n')"
    rare = " or ".join([*(f"contains({text}, '{x}')" for x in CLOSED), f"(octet_length({text}) != length({text}) and {text} rlike '{RARE}')"])
    lines = f"if({text} rlike '{WIDE}', regexp_replace({text}, '{WIDE_ENDS}', '$1\n'), {text})"
    parts = f"if({rare}, split({lines}, '{PARTS}'), split({plain}, '\n'))"
    return f"sort_array(array_distinct(transform(filter(transform({parts}, p -> trim(p)), p -> p != ''), p -> xxhash64(p))))"


def check(key: str) -> str:
    return f"(xxhash64({key}, 7) & 4294967295L)"


def place(key: str, third: int, m: str) -> str:
    """SQL: the cell of a digest in a third of a table of m cells."""
    return f"({third}L * ({m} div 3) + pmod(xxhash64({key}, {third}L), {m} div 3))"


def entries(key: str, sign: str, m: str) -> str:
    """SQL: the three cells that a digest goes to."""
    return "array(" + ", ".join(f"named_struct('c', {place(key, j, m)}, 'n', {sign}, 'k', {key}, 'h', {check(key)})" for j in range(3)) + ")"


# ---------------------------------------------------------------- fingerprints, row by row


def combined(cells: str) -> str:
    """SQL: one entry a cell, without empty ones. Runs of a cell are found in sorted entries, so long texts cost no more than their sort."""
    starts = "filter(sequence(1, size(e)), i -> i = 1 or e[i - 1].c != e[greatest(i - 2, 0)].c)"
    run = "slice(e, at, coalesce(try_element_at(starts, i + 2), size(e) + 1) - at)"
    merged = f"aggregate({run}, named_struct('c', e[at - 1].c, 'n', 0L, 'k', 0L, 'h', 0L), (a, x) -> named_struct('c', a.c, 'n', a.n + x.n, 'k', a.k ^ x.k, 'h', a.h ^ x.h))"
    runs = f"transform(array({starts}), starts -> transform(starts, (at, i) -> {merged}))[0]"
    return f"""filter(transform(array(sort_array({cells})), e -> if(size(e) = 0, cast(array() as array<{CELL}>), {runs}))[0],
        c -> c.n != 0 or c.k != 0 or c.h != 0)"""


def sketch(keys: str) -> str:
    """SQL: the CELLS cells of an array of digests, without empty ones. A digest's places are worked out once."""
    third = CELLS // 3
    q = " + ".join(f"{third**j} * pmod(xxhash64(d, {j}L), {third}L)" for j in range(3))
    x = f"transform({keys}, d -> named_struct('d', d, 'h', {check('d')}, 'q', {q}))"
    own = f"filter(x, e -> (e.q div cast(pow({third}, i div {third}) as bigint)) % {third} = i % {third})"
    cell = "named_struct('c', i, 'n', cast(size(own) as bigint), 'k', aggregate(own, 0L, (a, e) -> a ^ e.d), 'h', aggregate(own, 0L, (a, e) -> a ^ e.h))"
    cells = f"transform(sequence(0L, {CELLS - 1}L), i -> transform(array({own}), own -> {cell})[0])"
    return f"filter(transform(array({x}), x -> {cells})[0], c -> c.n != 0)"


def subtracted(a: str, b: str) -> str:
    """SQL: the first sketch less the second, cell by cell."""
    return combined(f"concat({a}, transform({b}, c -> named_struct('c', c.c, 'n', -c.n, 'k', c.k, 'h', c.h)))")


def peeled(cells: str, m: str) -> str:
    """SQL: struct<cells, plus, minus, on>: what is left, and the recovered digests of either side.

    Each third of the table holds every digest once, so its counts and XOR tell when all have been recovered."""
    pure = f"filter(s.cells, c -> abs(c.n) = 1 and c.h = {check('c.k')})"
    found = "named_struct('p', array_distinct(transform(filter(pure, c -> c.n = 1), c -> c.k)), 'q', array_distinct(transform(filter(pure, c -> c.n = -1), c -> c.k)))"
    third = f"filter(s.cells, c -> c.c < {m} div 3)"
    xor = "aggregate({of}, 0L, (a, c) -> a ^ {x})"
    whole = f"""(aggregate({third}, 0L, (a, c) -> a + c.n) = size(f.p) - size(f.q)
        and {xor.format(of=third, x='c.k')} = {xor.format(of='f.p', x='c')} ^ {xor.format(of='f.q', x='c')})"""
    gone = f"flatten(concat(transform(f.p, y -> {entries('y', '-1L', m)}), transform(f.q, y -> {entries('y', '1L', m)})))"
    step = f"""transform(transform(array({pure}), pure -> {found}), f -> named_struct(
        'cells', CASE WHEN size(f.p) + size(f.q) = 0 THEN s.cells WHEN {whole} THEN cast(array() as array<{CELL}>) ELSE {combined(f"concat(s.cells, {gone})")} END,
        'plus', concat(s.plus, f.p), 'minus', concat(s.minus, f.q), 'on', size(f.p) + size(f.q) > 0))[0]"""
    none = "cast(array() as array<bigint>)"
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'plus', {none}, 'minus', {none}, 'on', true),
        (s, i) -> if(s.on and size(s.cells) > 0, {step}, s))"""


def first_try(a_cells: str, b_cells: str) -> Column:
    """How many digests the fingerprints' difference gives away; null if peeling gets stuck."""
    return F.expr(f"transform(array({peeled(subtracted(a_cells, b_cells), f'{CELLS}L')}), r -> if(size(r.cells) = 0, size(r.plus) + size(r.minus), null))[0]")


def guess(a: str, b: str) -> str:
    """SQL: about how many digests differ, from the least SAMPLE of either sorted side."""
    least = f"array(array(slice({a}, 1, {SAMPLE}), slice({b}, 1, {SAMPLE})))"
    union = f"slice(array_sort(array_union(x[0], x[1])), 1, {SAMPLE})"
    shared = f"size(array_intersect(array_intersect({union}, x[0]), x[1])) / greatest(size({union}), 1)"
    return f"transform(transform({least}, x -> {shared}), j -> (size({a}) + size({b})) * (1 - j) / (1 + j))[0]"


def hopeful(a: str, b: str, tried: Column) -> Column:
    """The fingerprints are peeled unless twice as many digests seem to differ as they have cells: then a larger sketch is made at once."""
    return F.when(F.expr(f"{guess(a, b)} < {2 * CELLS}"), tried)


def larger_try(a: str, b: str) -> Column:
    """struct<d, m>: how many digests a larger sketch gives away, and its cells; sketches grow by GROWTH until one peels. A null d if none of ROW_SIZES does."""
    of = lambda keys, sign: f"flatten(transform({keys}, d -> {entries('d', sign, 'm')}))"
    cells = combined(f"concat({of(a, '1L')}, {of(b, '-1L')})")
    count = f"transform(array({peeled(cells, 'm')}), r -> if(size(r.cells) = 0, size(r.plus) + size(r.minus), cast(null as int)))[0]"
    sizes = f"transform(sequence(1, {ROW_SIZES}), p -> {CELLS}L * cast(pow({GROWTH}, p) as bigint))"
    largest = CELLS * GROWTH**ROW_SIZES
    asked = f"filter({sizes}, m -> m >= least({largest}, {ROOM} * greatest(g, abs(size({a}) - size({b})))))"
    fold = f"aggregate({asked}, named_struct('d', cast(null as int), 'm', 0L), (acc, m) -> if(acc.d is null, named_struct('d', {count}, 'm', m), acc))"
    return F.expr(f"transform(array({guess(a, b)}), g -> {fold})[0]")


def fingerprint(cells: str) -> Column:
    """A sketch of CELLS cells in base64: 2 bytes of count, 8 of digests, 4 of checks a cell."""
    text = "concat(lpad(hex(c.n & 65535), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h), 8, '0'))"
    dense = f"concat({cells}, transform(array_except(sequence(0L, {CELLS - 1}L), transform({cells}, c -> c.c)), i -> named_struct('c', i, 'n', 0L, 'k', 0L, 'h', 0L)))"
    return F.expr(f"replace(replace(base64(unhex(array_join(transform(sort_array({dense}), c -> {text}), ''))), '\r', ''), '\n', '')")


# ---------------------------------------------------------------- larger tables, cell by cell


def tries(pairs: DataFrame, power: int, least_cells: int = 256, cells_each: int = 2, sweeps: int = 2) -> DataFrame:
    """rid, w, done, m, plus, minus of pairs (rid, w, a, b: arrays of digests) that lie by their rid already; a third has `cells_each` cells a digest."""
    size = F.size("a") + F.size("b")
    sized = pairs.withColumn("m", (F.lit(3) * F.greatest(F.lit(least_cells), cells_each * size) * F.lit(GROWTH**power)).cast("long"))
    keys = sized.select(*PAIR, "m", F.explode(F.expr("concat(transform(a, d -> struct(1L as n, d as k)), transform(b, d -> struct(-1L as n, d as k)))")).alias("x")).select(*PAIR, "m", "x.n", "x.k")
    rows = keys.select(*PAIR, "m", F.explode(F.expr(entries("k", "n", "m"))).alias("x")).select(*PAIR, "m", F.lit(False).alias("got"), "x.*")

    def summed(rows: DataFrame) -> DataFrame:
        """Cells by their sums; recovered digests (got) are rows by themselves, with the digest for a cell."""
        cells = rows.groupBy(*PAIR, "m", "got", "c").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
        return cells.where("n != 0 OR k != 0 OR h != 0")

    cells = summed(rows)
    for j in list(range(3)) * sweeps:
        pure = f"NOT got AND abs(n) = 1 AND h = {check('k')} AND c = {place('k', j, 'm')}"
        others = [f"named_struct('got', false, 'c', {place('k', i, 'm')}, 'n', -n, 'k', k, 'h', h)" for i in range(3) if i != j]
        given = f"array(named_struct('got', true, 'c', k, 'n', n, 'k', 0L, 'h', 0L), {', '.join(others)})"
        step = F.expr(f"if({pure}, {given}, array(named_struct('got', got, 'c', c, 'n', n, 'k', k, 'h', h)))")
        cells = summed(cells.select(*PAIR, "m", F.explode(step).alias("x")).select(*PAIR, "m", "x.*"))
    digest = lambda sign: F.collect_list(F.when(F.col("got") & (F.col("n") == sign), F.col("c")))
    found = cells.groupBy(*PAIR).agg(F.bool_and("got").alias("done"), F.max("m").alias("m"), digest(1).alias("plus"), digest(-1).alias("minus"))
    whole = pairs.select(F.col("rid").alias("_rid"), F.col("w").alias("_w"))
    none = F.array().cast("array<bigint>")  # pairs without a difference have no cell
    joined = whole.join(found, (F.col("rid") == F.col("_rid")) & (F.col("w") == F.col("_w")), "left")
    return joined.select(F.col("_rid").alias("rid"), F.col("_w").alias("w"), F.coalesce("done", F.lit(True)).alias("done"), F.coalesce("m", F.lit(0).cast("long")).alias("m"), F.coalesce("plus", none).alias("plus"), F.coalesce("minus", none).alias("minus"))


def differences(pairs: DataFrame, least_cells: int = 256, cells_each: int = 2, entries_a_task: int = 300_000) -> DataFrame:
    """rid, w, m (cells), plus, minus: the digests in which the arrays a and b of each pair (rid, w) differ, recovered from sketches."""
    with scratch(pairs.sparkSession) as kept:
        left, found = written(pairs.select("rid", "w", "a", "b"), "pairs"), None
        for power in range(TRIES):
            total = left.agg(F.coalesce(F.sum(F.size("a") + F.size("b")), F.lit(0))).first()[0]
            if left.isEmpty():
                break
            tried = written(tries(left.repartition(max(1, -(-3 * total // entries_a_task)), "rid"), power, least_cells, cells_each), "tried")
            kept.append(tried)
            good = tried.where("done").drop("done")
            found = good if found is None else found.unionByName(good)
            left = written(left.join(tried.where("NOT done").select("rid", "w"), PAIR, "left_semi"), "pairs")
        else:
            raise RuntimeError("the digests of some pair can't be told apart")
    return pairs.select("rid", "w", F.lit(0).cast("long").alias("m"), F.col("a").alias("plus"), F.col("b").alias("minus")).where("false") if found is None else found


def next_of(rows: DataFrame, id_col: str, columns: list[str], block_rows: int = 1000, most_blocks: int = 1 << 16) -> DataFrame:
    """Adds next_<column> of the row that follows in descending order of ids (after the last: the first). `rows` has `h`, a hash of its text,
    `n`, how many equal rows it stands for, and the columns; equal rows follow each other.

    At most `most_blocks` cut points, and as many first rows, are broadcast."""
    total = rows.count()
    n_blocks = min(most_blocks, max(1, -(-total // block_rows)))
    coarse = max(1, round(n_blocks**0.5))
    shares = [i / n_blocks for i in range(1, n_blocks)]
    cuts = rows.agg(F.percentile_approx(id_col, shares, 10 * n_blocks).alias("c")).first()["c"] if shares else None
    cuts = sorted(set(cuts or []))
    # the number of cut points below the id, by groups first; ids fall with the block's number, null ids come last, by their hashes
    if cuts:
        listed = lambda xs: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)")  # noqa: E731  one literal, which Catalyst folds
        tops = listed([cuts[min(i + coarse, len(cuts)) - 1] for i in range(0, len(cuts), coarse)])
        below = F.size(F.filter(tops, lambda c: c < F.col(id_col)))
        inside = F.size(F.filter(F.slice(listed(cuts), below * coarse + 1, coarse), lambda c: c < F.col(id_col)))
        rank = below * coarse + inside
    else:
        rank = F.lit(0)
    block = F.when(F.col(id_col).isNull(), F.lit(len(cuts) + 129) + F.shiftright("h", 56)).otherwise(F.lit(len(cuts)) - rank).cast("long")
    rows = rows.withColumn("block", block)
    tops = rows.groupBy("block").agg(F.max(F.struct(F.col(id_col).alias("_id"), F.bitwise_not("h").alias("_h"))).alias("top"))
    whole = Window.orderBy("block")  # over one row a block
    before = F.coalesce(F.lag("block").over(whole), F.max("block").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select(F.col("top._id").alias("_id"), F.bitwise_not("top._h").alias("_h"), before.alias("_before"))
    found = rows.join(F.broadcast(tops), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    targets = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("extra")), F.struct(F.col("_before").alias("b"), F.lit(True).alias("extra")))
    )
    dealt = found.withColumn("to", F.explode(targets)).drop("_id", "_h", "_before", "block").select("*", "to.*").drop("to").repartition("b")
    order = Window.partitionBy("b").orderBy("extra", F.col(id_col).desc_nulls_last(), "h")
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("NOT extra").drop("extra", "b")


def once_each(rows: DataFrame) -> DataFrame:
    """rows (id, text, h) without repeats, and n, how many there were."""
    several = rows.groupBy("id", "h").count().where("count > 1").select(F.xxhash64("id", "h").alias("x"))
    several = written(several, "repeated")
    if several.isEmpty():
        return rows.withColumn("n", F.lit(1).cast("long"))
    told = marked(rows, F.xxhash64("id", "h"), several)
    repeated = told.where("maybe").groupBy("id", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    return told.where("NOT maybe").select("id", "text", "h", F.lit(1).cast("long").alias("n")).unionByName(repeated.select("id", "text", "h", "n"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_share: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last 1/edit_share of it replaced by the next document's beginning), and how alike they are."""
    with scratch(df.sparkSession) as kept:
        rows = once_each(df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")))
        rows = next_of(rows.withColumn("keys", F.expr(digests("text"))), "id", ["text", "keys"])
        # of equal rows, all but the last are followed by an equal one
        follow = F.array(F.struct(F.col("next_text").alias("text"), F.col("next_keys").alias("keys")))
        own = F.struct("text", "keys")
        follow = F.when(F.col("n") == 1, follow).otherwise(F.concat(F.array_repeat(own, (F.col("n") - 1).cast("int")), follow))
        rows = rows.withColumn("next", F.explode(follow))
        cut = F.floor(F.length("text") / edit_share).cast("int")
        edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next.text", F.lit(1), cut))
        rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "keys", F.col("next.keys").alias("next_keys"))
        rows = rows.withColumn("edited_keys", F.expr(digests("edited"))).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).drop("edited")
        rows = rows.withColumn("cells", F.expr(sketch("keys"))).withColumn("edited_cells", F.expr(sketch("edited_keys"))).withColumn("next_cells", F.expr(sketch("next_keys")))
        tried = rows.select(
            "id", "n_chars", "edited_sha256", fingerprint("cells").alias("fingerprint"), fingerprint("edited_cells").alias("edited_fingerprint"), "keys", "edited_keys", "next_keys",
            hopeful("keys", "edited_keys", first_try("cells", "edited_cells")).alias("d_edited"), hopeful("keys", "next_keys", first_try("cells", "next_cells")).alias("d_next"),
        )
        tried = tried.select("*", F.size("keys").alias("n"), F.size("edited_keys").alias("n_edited"), F.size("next_keys").alias("n_next"))
        larger = lambda d, b: F.when(F.col(d).isNull() & (F.size("keys") + F.size(b) <= ROW_DIGESTS), larger_try("keys", b))
        tried = tried.withColumns({"l_edited": larger("d_edited", "edited_keys"), "l_next": larger("d_next", "next_keys")})
        cells = lambda d, x: F.when(F.col(d).isNotNull(), F.lit(CELLS).cast("long")).when(F.col(f"{x}.d").isNotNull(), F.col(f"{x}.m"))
        tried = tried.withColumns({"cells_edited": cells("d_edited", "l_edited"), "cells_next": cells("d_next", "l_next"), "d_edited": F.coalesce("d_edited", "l_edited.d"), "d_next": F.coalesce("d_next", "l_next.d")}).drop("l_edited", "l_next")
        pair = lambda d, b: F.when(F.col(d).isNull(), F.struct(F.lit(d).alias("w"), F.col("keys").alias("a"), F.col(b).alias("b")))
        stuck = F.array_compact(F.array(pair("d_edited", "edited_keys"), pair("d_next", "next_keys")))
        tried = tried.select(F.monotonically_increasing_id().alias("rid"), "*", F.when(F.size(stuck) > 0, stuck).alias("stuck")).drop("keys", "edited_keys", "next_keys")
        tried = written(tried, "fingerprints")
        kept.append(tried)
        found = differences(tried.where("stuck IS NOT NULL").select("rid", F.explode("stuck").alias("x")).select("rid", "x.*"))
        n = F.size("plus") + F.size("minus")
        of = lambda w, c, name: F.max(F.when(F.col("w") == w, c)).alias(name)
        found = found.groupBy(F.col("rid").alias("_rid")).agg(of("d_edited", n, "_edited"), of("d_next", n, "_next"), of("d_edited", F.col("m"), "_m_edited"), of("d_next", F.col("m"), "_m_next"))
        found = written(found, "recovered")
        kept.append(found)

    def likeness(n: str, first: str, again: str) -> Column:
        both, d = F.col("n") + F.col(n), F.coalesce(F.col(first), F.col(again))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d).cast("double") / (both + d))

    columns = lambda df: df.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("n_edited", "d_edited", "_edited").alias("near_edited"), likeness("n_next", "d_next", "_next").alias("near_next"),
        F.coalesce("cells_edited", "_m_edited").alias("cells_edited"), F.coalesce("cells_next", "_m_next").alias("cells_next"),
    )
    never = tried.where("stuck IS NULL").select("*", *(F.lit(None).cast("int").alias(c) for c in ("_edited", "_next")), *(F.lit(None).cast("long").alias(c) for c in ("_m_edited", "_m_next")))
    return columns(never).unionByName(columns(tried.where("stuck IS NOT NULL").join(found, F.col("rid") == F.col("_rid"), "left")))
