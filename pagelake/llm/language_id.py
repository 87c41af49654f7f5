"""Language ID (4): hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from a fixed seed. An n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rolled) by its place; a text's vector bundles (adds) those of its trigrams; a language's
prototype bundles those of all its training texts. A text gets the language whose prototype has the largest cosine.

Trigram counts are summed over all training rows before they are bundled; bundling and the sums of the bundles happen on the
executors, and the driver gets one vector a language, in one job. The prototypes (at most MOST_LANGUAGES x `dim` numbers; more
languages are an error) are broadcast. Letters are those of Unicode in
lower case, runs of anything else count as one space; code points share `SYMBOLS` vectors by their remainder.

Defined results: a null text or one without letters is `und` with score 0.0, as is every text if no row can be learned
from; rows with a null language aren't learned from; a null id is treated as the empty text when rows are held out;
equal cosines go to the language that sorts first; repeated rows count each; an empty table gives an empty table; other
columns of the input are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import claim, col, fields, scratch, written

DIM, SYMBOLS, SEED = 1024, 1024, 20_231
MOST_VECTORS, MOST_KEYS = 32_768, 2048
MOST_LANGUAGES = 4096


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Symbol of each code point: 0 if it isn't a letter."""
    return np.fromiter(((1 + c % (SYMBOLS - 1)) if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.int64, count=0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the text's trigrams, with a space at either end; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = letters()[points]
    symbols = np.concatenate([[0], symbols, [0]])
    symbols = symbols[np.flatnonzero((symbols != 0) | np.concatenate([[True], symbols[:-1] != 0]))]
    if len(symbols) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((symbols[:-2] << 20) | (symbols[1:-1] << 10) | symbols[2:], return_counts=True)


class Vectors:
    """Trigram key -> row of a bounded matrix of bound vectors."""

    def __init__(self, dim: int):
        base = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dim), dtype=np.int8) * 2 - 1
        self.letters = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
        self.dim = dim
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, self.dim), dtype=np.int8)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(keys) > min(MOST_KEYS, MOST_VECTORS // 2):  # a text of many different trigrams: part by part
            half = len(keys) // 2
            return self.bundle(keys[:half], counts[:half]) + self.bundle(keys[half:], counts[half:])
        names = keys.tolist()
        missing = [k for k in names if k not in self.rows]
        if missing:
            if len(self.rows) + len(missing) > MOST_VECTORS:
                self.clear()
                missing = names
            start = len(self.rows)
            while start + len(missing) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
            new = np.array(missing, dtype=np.int64)
            bound = self.letters[0][new >> 20] * self.letters[1][(new >> 10) & 1023] * self.letters[2][new & 1023]
            self.matrix[start : start + len(new)] = bound
            self.rows.update(zip(missing, range(start, start + len(new)), strict=True))
        return counts.astype(np.float32) @ self.matrix[[self.rows[k] for k in names]].astype(np.float32)


@lru_cache(maxsize=2)
def vectors(dim: int) -> Vectors:
    return Vectors(dim)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def prototypes(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, learned from all rows of `df` with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "key", "n"])

        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                held.setdefault(lang.as_py(), []).append(trigrams(text.as_py()))
            for lang, found in held.items():
                found += [sums[lang]] if lang in sums else []
                keys, of = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                sums[lang] = keys, np.bincount(of, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)
            if sum(len(k) for k, _ in sums.values()) > 1_000_000:
                yield from rows()
                sums = {}
        yield from rows()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id", vectors.cache_clear)
        sums: dict[str, np.ndarray] = {}
        bound = vectors(dim)
        for batch in batches:
            langs, keys, counts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in sorted(set(langs)):
                own = np.flatnonzero(langs == lang)
                for i in range(0, len(own), 4096):
                    part = own[i : i + 4096]
                    sums[lang] = sums.get(lang, 0) + bound.bundle(keys[part], counts[part]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = df.select(col(text_col).alias("text"), col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    with scratch(df.sparkSession):
        counts = rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
        bundles = counts.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
        summed = bundles.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("v"))
        sums = {r.lang: np.array(r.v) for r in written(summed, "prototypes").limit(MOST_LANGUAGES + 1).collect()}
    if len(sums) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(sums)
    matrix = np.array([sums[x] / max(np.linalg.norm(sums[x]), 1e-9) for x in langs]).reshape(len(langs), dim)
    return langs, matrix.astype(np.float32)


def identify(df: DataFrame, langs: list[str], matrix: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns `keep` (all others but these two, if not given). The text goes to Python once."""
    keep = [c for c in df.columns if c not in ("lang_pred", "score")] if keep is None else keep
    sent = df.sparkSession.sparkContext.broadcast((langs, matrix))
    dim = matrix.shape[1] if len(langs) else DIM
    columns = [*keep, *([] if text_col in keep else [text_col])]
    at = columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id", vectors.cache_clear)
        names, protos = sent.value
        bound = vectors(dim)
        for batch in batches:
            preds, scores = [], []
            for value in batch.column(at):
                keys, counts = trigrams(value.as_py() or "")
                if not len(keys) or not names:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                vector = bound.bundle(keys, counts)
                cosines = protos @ vector / max(float(np.linalg.norm(vector)), 1e-9)
                best = int(cosines.argmax())
                preds.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*places[: len(keep)], "lang_pred", "score"])

    places = [f"c{i}" for i in range(len(columns))]  # whatever the columns' names are
    schema = fields([(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)], "lang_pred string, score double")
    found = df.select(*(col(c).alias(p) for c, p in zip(columns, places, strict=True))).mapInArrow(predict, schema)
    return written(found, "languages").toDF(*keep, "lang_pred", "score")


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: `id_col` or the columns `keep`, held_out, lang_pred, score."""
    keep = [c for c in keep or [id_col] if c != "held_out"]
    langs, matrix = prototypes(df.where(~held_out(id_col)), text_col, lang_col)
    rows = df.select(*map(col, dict.fromkeys([*keep, text_col])), held_out(id_col).alias("held_out"))
    return identify(rows, langs, matrix, text_col, [*keep, "held_out"])
