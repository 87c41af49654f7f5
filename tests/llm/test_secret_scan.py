from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import functions as F

from pagelake.llm import queries, secret_scan as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def shown(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


TEXTS = [
    None, "", "none", "PassWord = 'abcdefgh' é token:short", 'token: "secret": "abcdefgh1"', "token=secret=abcdefghijk api_key=12345678", "AKIA" + "X" * 12 + " AKIAX AKIA" + "9" * 40,
    "é😀" * 50 + " secret : " + "0123456789abcdef" * 3 + "\n" + "f" * 31 + "g" + "0" * 32, "x" * 100_000 + " apikey=abcdefgh" * 300, "passwd=abcdefgh", "passwd=abcdefgh",
]


def test_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        found = spans(text)
        counts = tuple(sum(k == x[3] for x in found) for k in ("assign", "access", "hex"))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == counts and got[i].spans == shown(found) and got[i].base_sha256 == hashlib.sha256(shown(found).encode()).hexdigest()


def test_edges_and_redaction(spark):
    df = spark.createDataFrame([(i if i else None, t, "b") for i, t in enumerate(TEXTS)], "doc_id int, text string, blob string")
    got = {r.doc_id: r[1] for r in S.secret_scan(df).select("doc_id", S.span_text(F.col("spans"))).collect()}
    assert got == {i if i else None: shown(spans(t or "")) for i, t in enumerate(TEXTS)}
    red = df.select("doc_id", "text", S.redacted(F.col("text"), S.spans_of(F.coalesce("text", F.lit("")))).alias("r")).collect()
    for row in red:
        out, at = "", 0
        for a, _, b, _ in spans(row.text or ""):
            if a >= at:
                out += (row.text[at:a]) + "[REDACTED]"
            at = max(at, b)
        assert row.r == (None if row.text is None else out + row.text[at:])
    assert S.secret_scan(df.where("false")).collect() == []


def entries(spark, ledger):
    return sorted(tuple(r) for r in S.ledger_rows(spark, ledger).selectExpr("blob", "rule_version", "size(spans)").collect())


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "clean"), (3, "clean"), (None, None), (None, None)], "doc_id int, text string")
    two = spark.createDataFrame([(1, "token=abcdefgh!"), (4, "clean"), (5, "token=abcdefgh")], "doc_id int, text string")
    S.secret_scan(one, ledger).collect()
    assert len(entries(spark, ledger)) == 3 and len(S.ended_scans(spark, ledger)) == 1
    got = {r.doc_id: len(r.spans) for r in S.secret_scan(two, ledger).collect()}
    assert got == {1: 1, 4: 0, 5: 1} and len(entries(spark, ledger)) == 4
    S.secret_scan(one, ledger).collect()
    assert len(entries(spark, ledger)) == 4 and len(S.ended_scans(spark, ledger)) == 2
    fewer = S.RULES[1:]  # other rules are another version, so nothing stale is found
    assert all(r.spans == [] for r in S.secret_scan(one, ledger, rules=fewer).collect())
    assert len(entries(spark, ledger)) == 7 and {v for _, v, _ in entries(spark, ledger)} == {S.version_of(S.RULES), S.version_of(fewer)}


def test_repeated_rows_are_scanned_once(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    df = spark.range(1000).selectExpr("7L as doc_id", "'token=abcdefgh' as text")
    assert S.secret_scan(df, ledger).where("size(spans) = 1").count() == 1000
    assert len(entries(spark, ledger)) == 1


def test_a_scan_that_failed_leaves_no_trace(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    df = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id int, text string")
    S.secret_scan(df, ledger).collect()
    scan = S.ended_scans(spark, ledger)[0].removeprefix("file:")
    os.remove(f"{scan}/_SUCCESS")  # as if it hadn't come to its end
    assert entries(spark, ledger) == []
    assert S.secret_scan(df, ledger).first().spans and len(entries(spark, ledger)) == 1


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", "p", "b", 3)], "doc_id int, text string, path string, _blob string, _at int")
    assert S.secret_scan(df).count() == 1 and S.secret_scan(df.withColumnRenamed("doc_id", "a.b"), id_col="a.b").first()["a.b"] == 1
