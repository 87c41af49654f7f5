"""Edit distances of long texts, exact, at a cost that grows with the distance instead of the texts' product.

Furthest points on diagonals: with e edits, how far can a text be read on each diagonal of the comparison? One edit more reaches from a diagonal and its
neighbours, and then as far as the texts agree. How far they agree from any two places on is told by equality classes of runs of 1, 2, 4, ...
characters, made by sorting pairs of classes, so that nothing hangs on a hash. Distance d of texts of n characters takes n log n steps for the classes and d^2 log n
for the diagonals, all as arrays. Texts that are too unlike for that are compared by columns of bits: of the plain table one column is two whole numbers, the places where it
goes up and where it goes down by one, and the next column comes from a few operations on whole numbers (Myers 1999, Hyyrö 2003). That is still the product of
the lengths, but of a thirtieth of it, in a few operations of the machine each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions import text as X

#: The largest distance that is looked for by diagonals, as a part of the longer text: beyond it columns of bits cost less.
UNLIKE = 16
#: Texts of up to so many characters are compared by columns of bits at once.
BY_BITS = 20_000
#: Texts of up to so many characters aren't sent to Python.
SHORT = 512


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def without_shared_ends(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y, n = x[head:], y[head:], n - head
    differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return x[: len(x) - tail], y[: len(y) - tail]


def classes(both: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: numbers that are equal where runs of 2^k characters are; runs that reach beyond the end have none and stop the series."""
    found = [np.unique(both, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while 2 * width <= len(both):
        own = found[-1]
        pairs = own[: len(own) - width] * (int(own.max()) + 1) + own[width:]
        found.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return found


def distance(a: str, b: str, most: int) -> int:
    """The Levenshtein distance by code points, or -1 if it is beyond `most`."""
    x, y = without_shared_ends(codes(a), codes(b))
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return -1
    # a mark of its own between and after the texts, so that no run of equal characters reaches across
    both = np.concatenate([x, [0x110000], y, [0x110001]]).astype(np.uint32)
    tables = classes(both)

    def agreed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = i.copy(), n + 1 + j
        start = i.copy()
        for k in range(len(tables) - 1, -1, -1):
            table = tables[k]
            inside = (i < len(table)) & (j < len(table))
            same = np.zeros(len(i), dtype=bool)
            same[inside] = table[i[inside]] == table[j[inside]]
            i += same << k
            j += same << k
        return i - start

    # reach[k]: how much of x is read on diagonal k - offset (place in x less place in y)
    never = -(1 << 40)
    offset = most + 1
    reach = np.full(2 * most + 3, never, dtype=np.int64)
    for e in range(most + 1):
        low, high = max(-e, -m), min(e, n)
        k = np.arange(low, high + 1)
        if e == 0:
            best = np.zeros(1, dtype=np.int64)
        else:
            at = k + offset
            best = np.maximum(np.maximum(reach[at] + 1, reach[at - 1] + 1), reach[at + 1])  # substitution, deletion from x, insertion
        best = np.minimum(np.minimum(best, n), m + k)
        good = (best >= 0) & (best - k >= 0)
        new = np.full(len(k), never, dtype=np.int64)
        i = best[good]
        new[good] = i + agreed(i, i - k[good])
        reach[k + offset] = new
        if low <= n - m <= high and reach[n - m + offset] >= n:
            return e
    return -1


def by_bits(a: str, b: str) -> int:
    """The Levenshtein distance by code points, of texts however unlike."""
    x, y = without_shared_ends(codes(a), codes(b))
    if len(x) < len(y):
        x, y = y, x
    n = len(x)
    if not len(y):
        return n
    if n == len(y) == 1:
        return 1
    # for each character of y, the places of x that have it, as bits
    order = np.argsort(x, kind="stable")
    kinds, begins = np.unique(x[order], return_index=True)
    wanted, places = set(y.tolist()), {}
    for kind, at in zip(kinds.tolist(), np.split(order, begins[1:]), strict=True):
        if kind in wanted:
            bits = np.zeros(n, dtype=np.uint8)
            bits[at] = 1
            places[kind] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    every, last = (1 << n) - 1, n - 1
    up, down, found = every, 0, n
    for c in y.tolist():
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up = down | (every & ~(diagonal | up))
        right_down = up & diagonal
        found += (right_up >> last & 1) - (right_down >> last & 1)
        right_up = (right_up << 1 | 1) & every
        right_down = right_down << 1 & every
        up = right_down | (every & ~(diagonal | right_up))
        down = right_up & diagonal
    return found


def whole_distance(a: str, b: str) -> int:
    longest = max(len(a), len(b))
    if longest > BY_BITS:
        found = distance(a, b, longest // UNLIKE + 1)
        if found >= 0:
            return found
    return by_bits(a, b)


def distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Null for null texts. The texts stay Arrow's bytes; only one row's are Python's at a time."""
    return pa.array((whole_distance(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)), pa.int32(), size=len(a))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Like text.edit_distance, which it is for short texts; of long unequal ones a small Python step finds the distance."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    long = (F.greatest(F.length(a), F.length(b)) > SHORT) & (a != b)
    found = F.arrow_udf(distances, "int")(F.when(long, a), F.when(long, b))
    return F.when(long, found).otherwise(X.edit_distance(a, b))
