"""Text functions as Column -> Column; no Python runs per row.

White space and line ends are Unicode's, with U+001C to U+001F, as Python's str methods have them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1C-\x1F]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{0085}\x{2028}\x{2029}]"
#: The fence around a whole text, fence marks anywhere, and the preambles in the order in which they go.
WHOLE_FENCE = r"(?sU)\A```(?:markdown|md)?" + WS + r"*\n(.*?)\n```" + WS + r"*\z"
FENCES = r"(?U)```(?:markdown|md)?" + WS + r"*\n?|\n?```"
PREAMBLES = (
    r"(?iU)\A" + WS + r"*here(?:'s| is)[^.\n:]*[.:]" + WS + "*",
    r"(?iU)\A" + WS + r"*sure[!,]?[^.\n:]*[.:]" + WS + "*",
    r"(?iU)\A" + WS + r"*of course[!,]?[^.\n:]*[.:]" + WS + "*",
)
#: The same with a word's end after the opening word, so that "Surety bonds." stays.
STRICT_PREAMBLES = (PREAMBLES[0], PREAMBLES[1].replace("sure", r"sure\b"), PREAMBLES[2].replace("course", r"course\b"))
SEPARATOR_CELL = r"\A:?-+:?\z"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), rf"(?U)\A{WS}+|{WS}+\z", "")


def lines(x: Column | str) -> Column:
    """The lines of a text; a line end at its end gives an empty line more."""
    return F.split(_col(x), LINE_END, -1)


def clean_markdown(x: Column | str, strict_preamble: bool = False) -> Column:
    """A model's answer without a fence around the whole and without an opening phrase.

    By default an opening phrase may be the beginning of a longer word, as callers rely on; `strict_preamble` asks for whole words."""
    text = trim(F.coalesce(_col(x), F.lit("")))
    text = F.when(text.rlike(WHOLE_FENCE), trim(F.regexp_extract(text, WHOLE_FENCE, 1))).otherwise(text)
    for pattern in STRICT_PREAMBLES if strict_preamble else PREAMBLES:
        text = F.regexp_replace(text, pattern, "")
    return trim(text)


def normalize(x: Column | str) -> Column:
    """Lower case, without fence marks, white space as single spaces."""
    text = F.lower(trim(F.regexp_replace(F.coalesce(_col(x), F.lit("")), FENCES, "")))
    return F.regexp_replace(text, rf"(?U){WS}+", " ")


#: Texts of up to so many characters are compared whole; the first bound on the distance of longer ones, how bounds grow, and how many there are.
SHORT, FIRST_BOUND, BOUND_GROWTH, BOUNDS = 2048, 64, 4, 8


def _shared_length(at: Callable[[Column, Column], Column], n: Column) -> Column:
    """How many characters agree, of n at most: by halving steps, the next 2^k characters at a time. at(i, k): whether k characters after the first i agree."""
    steps = F.sequence(F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int"), F.lit(0))

    def step(i: Column, p: Column) -> Column:
        more = F.call_function("shiftleft", F.lit(1), p)
        return F.when((i + more <= n) & at(i, more), i + more).otherwise(i)

    return F.aggregate(steps, F.lit(0), step)


def without_shared_ends(a: Column, b: Column) -> Column:
    """struct<a, b>: the texts without their common beginning and end, which no best edit touches."""
    head = _shared_length(lambda i, k: F.substring(a, i + 1, k) == F.substring(b, i + 1, k), F.least(F.length(a), F.length(b)))
    rest = F.transform(F.array(head), lambda h: F.struct(F.substring(a, h + 1, F.length(a)).alias("a"), F.substring(b, h + 1, F.length(b)).alias("b")))

    def without_tail(x: Column) -> Column:
        piece = lambda t, i, k: F.substring(t, F.length(t) - i - k + 1, k)
        tail = _shared_length(lambda i, k: piece(x["a"], i, k) == piece(x["b"], i, k), F.least(F.length(x["a"]), F.length(x["b"])))
        cut = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
        return F.transform(F.array(tail), lambda n: F.struct(cut(x["a"], n).alias("a"), cut(x["b"], n).alias("b")))[0]

    return F.transform(rest, without_tail)[0]


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance by code points, exact for texts of any length, without Python.

    Of long texts the common beginning and end go first. What is left is compared within a band of 64, 256, ... edits until the distance lies within it; a band that would
    be as wide as the text is given up for the whole table. The band spares most of a table's work, but Spark's walks along every line up to it: for
    texts of a hundred thousand characters use distance.edit_distance. A null text gives null."""
    a, b = _col(a), _col(b)

    def banded(x: Column) -> Column:
        short, long = F.least(F.length(x["a"]), F.length(x["b"])), F.greatest(F.length(x["a"]), F.length(x["b"]))
        bounds = [FIRST_BOUND * BOUND_GROWTH**i for i in range(BOUNDS)]
        within = lambda k: F.transform(F.array(F.levenshtein(x["a"], x["b"], k)), lambda d: F.when(d >= 0, d))[0]
        tries = [F.when((long - short <= k) & (2 * k < long), within(k)) for k in bounds]
        return F.when(short == 0, long).otherwise(F.coalesce(*tries, F.levenshtein(x["a"], x["b"])))

    # the texts are bound first: inside the steps they would be worked out again each time
    given = F.array(F.struct(a.alias("a"), b.alias("b")))
    bounded = F.transform(F.transform(given, lambda x: without_shared_ends(x["a"], x["b"])), banded)[0]
    return F.when(a == b, F.lit(0)).when(F.greatest(F.length(a), F.length(b)) <= SHORT, F.levenshtein(a, b)).otherwise(bounded)


def edit_ratio(a: Column, b: Column, distance: Callable[[Column, Column], Column] = edit_distance) -> Column:
    """Levenshtein distance over the longer length; 0.0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(distance(a, b) / F.greatest(longest, F.lit(1)))


def normalized_edit_distance(a: Column | str, b: Column | str, distance: Callable[[Column, Column], Column] = edit_distance) -> Column:
    return edit_ratio(normalize(a), normalize(b), distance)


def anchor_recall(actual: Column | str, anchors: Column | str) -> Column:
    """Share of the anchors found as they are, in any case; 1.0 without anchors. Repeated anchors count each."""
    text, anchors = F.lower(F.coalesce(_col(actual), F.lit(""))), F.coalesce(_col(anchors), F.array().cast("array<string>"))
    hits = F.size(F.filter(anchors, lambda a: F.contains(text, F.lower(a))))
    return F.when(F.size(anchors) == 0, F.lit(1.0)).otherwise(hits / F.greatest(F.size(anchors), F.lit(1)))


def first_tokens(x: Column | str) -> Column:
    """The first word of each line that isn't blank, in lower case."""
    held = F.filter(F.transform(lines(F.coalesce(_col(x), F.lit(""))), trim), lambda t: t != "")
    return F.transform(held, lambda t: F.lower(F.split(t, rf"(?U){WS}+", 2)[0]))


def reading_order_distance(actual: Column | str, expected: Column | str) -> Column:
    """Edit ratio of the first words of all lines, joined by |, by characters."""
    a, b = (F.array_join(first_tokens(x), "|") for x in (actual, expected))
    return edit_distance(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(trim(line), r"\A\|+|\|+\z", ""), r"\|", -1), trim)


def _is_separator(row: Column) -> Column:
    return F.forall(row, lambda c: c.rlike(SEPARATOR_CELL))


def table_rows(x: Column | str) -> Column:
    """All rows of all Markdown tables: array<array<string>>, without separator rows; the header is a row."""
    held = F.filter(lines(F.coalesce(_col(x), F.lit(""))), lambda t: F.contains(t, F.lit("|")))
    return F.filter(F.transform(held, _cells), lambda r: ~_is_separator(r))


def tables(x: Column | str) -> Column:
    """The rows grouped into tables: array<array<array<string>>>. A line without | ends a table, a separator row doesn't."""
    none = F.array().cast("array<array<string>>")

    def step(acc: Column, line: Column) -> Column:
        row = _cells(line)
        grown = F.struct(acc["t"].alias("t"), F.when(_is_separator(row), acc["r"]).otherwise(F.concat(acc["r"], F.array(row))).alias("r"))
        ended = F.struct(F.when(F.size(acc["r"]) > 0, F.concat(acc["t"], F.array(acc["r"]))).otherwise(acc["t"]).alias("t"), none.alias("r"))
        return F.when(F.contains(line, F.lit("|")), grown).otherwise(ended)

    start = F.struct(F.array().cast("array<array<array<string>>>").alias("t"), none.alias("r"))
    return F.aggregate(lines(F.coalesce(_col(x), F.lit(""))), start, step, lambda acc: F.when(F.size(acc["r"]) > 0, F.concat(acc["t"], F.array(acc["r"]))).otherwise(acc["t"]))


def cell_set(x: Column | str) -> Column:
    """The distinct cells with text, in lower case."""
    return F.array_distinct(F.filter(F.transform(F.flatten(table_rows(x)), F.lower), lambda c: c != ""))


def table_cell_f1(actual: Column | str, expected: Column | str) -> Column:
    """F1 of the distinct cells of all tables; 1.0 if nothing is expected."""
    wanted, found = cell_set(expected), cell_set(actual)
    f1 = 2.0 * F.size(F.array_intersect(wanted, found)) / F.greatest(F.size(wanted) + F.size(found), F.lit(1))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(f1)


def table_cell_counts(actual: Column | str, expected: Column | str) -> Column:
    """struct<tp, fp, fn> of the distinct cells."""
    wanted, found = cell_set(expected), cell_set(actual)
    return F.struct(F.size(F.array_intersect(wanted, found)).alias("tp"), F.size(F.array_except(found, wanted)).alias("fp"), F.size(F.array_except(wanted, found)).alias("fn"))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def stem(path: Column | str) -> Column:
    """The file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def data_uri(content: Column | str, media_type: str = "image/png") -> Column:
    """data:<type>;base64,... of bytes. The line breaks that a session's setting may ask for are taken out."""
    return F.concat(F.lit(f"data:{media_type};base64,"), F.regexp_replace(F.base64(_col(content)), r"[\r\n]", ""))


def is_png(content: Column | str) -> Column:
    return F.hex(F.substring(_col(content), 1, 8)) == "89504E470D0A1A0A"


def utc_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
