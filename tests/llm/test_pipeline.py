"""Each stage against a brute-force version of itself, on its own input; and tables of all kinds."""

from __future__ import annotations

import pytest
from test_decontamination import brute as brute_decontamination
from test_near_duplicates import brute as brute_near_duplicates
from test_packing import check as check_packing
from test_secret_scan import spans

import corpus_pipeline as P
from pagelake.llm import secret_scan

KEY = lambda r: str(tuple(r))


def languages(rows, sf, spark):
    return [r for r in rows if any(c.isalpha() for c in r["text"] or "")]


def near_duplicates(rows, sf, spark):
    worded = [r for r in rows if (r["text"] or "").strip(" \t\n\x0b\x0c\r")]
    found = brute_near_duplicates([(r["doc_id"], r["text"]) for r in worded])
    return [r for r in rows if r not in worded or found[r["doc_id"]][1] == r["doc_id"]]


def decontamination(rows, sf, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return [r for r, found in zip(rows, brute_decontamination([r["text"] for r in rows], items), strict=True) if not found[4]]


def secrets(rows, sf, spark):
    out = []
    for r in rows:
        text, clean, at = r["text"], "", 0
        for a, _, b, _ in spans(text or ""):
            clean += (text[at:a] + "[REDACTED]") if a >= at else ""
            at = max(at, b)
        out.append(r | {"text": clean + text[at:], "n_chars": len(clean + text[at:])} if at else r)
    return out


BRUTE = {"language_id": languages, "near_duplicates": near_duplicates, "decontamination": decontamination, "secret_scan": secrets}


@pytest.fixture
def docs(spark, sf):
    """The smallest table, with secrets, benchmark passages and near copies where it has none."""
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    known = next(r["text"] for r in rows if len(r["text"].split()) > 60)
    texts = [f"key AKIA{'Q' * 16} and token = abcdefghijk, é {'0123456789abcdef' * 3}", "before it " + item + " after", known + " more", known, "12 34", "", None, None, "password: hunter2hunter2 " * 300, "Ω"]
    rows += [{"doc_id": 10**6 + i, "text": t, "lang": None, "source": "s", "n_chars": len(t or "")} for i, t in enumerate(texts)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], spark.read.parquet(f"{sf}/documents.parquet").schema)


def test_stages(spark, sf, docs):
    changed = 0
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        want = BRUTE[name](before, sf, spark)
        shown = lambda rows: sorted(str(r) for r in rows)
        assert shown(after) == shown(want), name
        changed += shown(before) != shown(after)
        docs = out
    assert changed == 4
    check_packing(P.STAGES[-1][1](spark, docs, sf).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_run_leaves_one_stage(spark, sf):
    """The run's result is the last stage's over all the others', which are gone by then but for the one that it has read."""
    from pagelake.llm.common import shared_dir

    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    there = lambda: {x.getPath().getName() for x in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)}
    before = there()
    got = P.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    check_packing(got, {r.doc_id: r.text for r in docs.collect()})
    left = {x.rsplit("-", 1)[0] for x in there() - before}
    assert len([x for x in left if x.startswith("stage-")]) == 1


def test_secrets_are_redacted(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables hold none
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = P.redact_secrets(spark, docs, sf)
    assert out.where("text LIKE '%[REDACTED]%' AND n_chars = length(text)").count() == secret_scan.secret_scan(docs).where("size(spans) > 0").count() > 0
    assert secret_scan.secret_scan(out).where("size(spans) > 0").count() == 0


def test_null_rows_pass_or_go(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "words in a text", None, None, None), (3, "words in a text", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf).collect() == []
        assert stage(spark, docs, sf).count() == {"language_id": 2, "near_duplicates": 3}.get(name, 4)


def test_columns_of_any_name_pass(spark, sf):
    names = "_id _hash _empty _rank _text_hash row blob found spans clean maybe held_out lang_pred score hits items n node component column_0 h_id `a.b`".split()
    docs = spark.createDataFrame([(1, "words in a text with token=abcdefghijk", "en", "s", 3), (2, "other words", "fr", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *(f"{k} AS {n}" for k, n in enumerate(names)))
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns[5:] == [n.strip("`") for n in names]
        assert [tuple(r)[5:] for r in docs.collect()] == [tuple(range(len(names)))] * 2
    assert docs.where("text LIKE '%[REDACTED]%'").count() == 1 and P.STAGES[-1][1](spark, docs, sf).count() == 2


def test_nested_columns_and_no_n_chars(spark, sf):
    """Fields of any name one level down, no n_chars, a text of 10 MB, and an empty table."""
    long = "some words in a row " * 500_000 + "token=abcdefghijk"
    docs = spark.createDataFrame([(1, "words in a text with token=abcdefghijk", "en"), (2, "other words", None), (3, long, "en")], "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "named_struct('content-type', 1, 'x y', array(named_struct('a.b', 2))) AS meta", "map('k', named_struct('`', 3)) AS m")
    kinds = docs.dtypes
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.where("false"), sf).collect() == []
        docs = stage(spark, docs, sf)
        assert docs.dtypes == kinds and docs.count() == 3
        assert {str(r.meta.asDict()) + str(r.m) for r in docs.select("meta", "m").collect()} == {"{'content-type': 1, 'x y': [Row(a.b=2)]}{'k': Row(`=3)}"}
    assert docs.where("text LIKE '%[REDACTED]%'").count() == 2
    assert P.STAGES[-1][1](spark, docs, sf).agg({"length": "sum"}).first()[0] > 2_000_000


def test_settings_are_put_back(spark, sf):
    from pagelake.llm.common import BATCH_BYTES

    before = spark.conf.get(BATCH_BYTES)
    P.keep_languages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count()
    assert spark.conf.get(BATCH_BYTES) == before


def test_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"] and P.ORACLE_SQL is None
