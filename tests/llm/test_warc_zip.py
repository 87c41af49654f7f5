from __future__ import annotations

import base64
import hashlib
import zipfile

import pytest
from pyarrow import fs

from pagelake.llm import queries, warc_zip as W
from pagelake.llm.stores import Stores


def expected(rows):
    least = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        if i is not None:
            least[payload] = min(i, least.get(payload, i))
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        first = least.get(payload)
        revisit = first is not None and first != i
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op2_warc_zip(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, tmp_path, zip64):
    rows = [(1, "http://a/b c\n", "<p>x"), (3, None, "<p>x"), (2, "u", None), (7, "u", ""), (5, "é", "ü" * 100_000), (None, "n", "<p>x"), (9, "z", "\r\n\r\nWARC/1.1"), (1, "http://a/b c\n", "<p>x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    archives = W.write_archives(df, f"file://{tmp_path}/w", zip64=zip64, archive_bytes=400)
    got = W.read_archives(archives, run_bytes=300, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert all(bytes(r.payload).decode() in {h or "" for _, _, h in rows} for r in got if r.record_type == "response")
    paths = [r.path for r in archives.collect()]
    assert len(paths) > 1
    for path in paths:
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED} and set(z.namelist()) == {W.DATA, W.INDEX}
    assert W.archived(spark, df.where("false")).collect() == []
    only_large = W.archived(spark, df, min_bytes=10)
    assert only_large.where("record_type = 'revisit'").count() == 0


def test_foreign_archives(tmp_path):
    for name, force in (("a.zip", False), ("b.zip", True)):
        at = tmp_path / name
        with zipfile.ZipFile(at, "w") as z:
            z.comment = b"PK\x05\x06 not the end"
            with z.open("m/x", "w", force_zip64=force) as f:
                f.write(b"hello")
            z.writestr(zipfile.ZipInfo("packed"), b"y" * 1000, zipfile.ZIP_DEFLATED)
        with fs.LocalFileSystem().open_input_file(str(at)) as f:
            members = W.zip_members(f)
            assert W.read_range(f, *W.stored(members, "m/x")) == b"hello"
            with pytest.raises(ValueError):
                W.stored(members, "packed")
    (tmp_path / "c").write_bytes(b"nothing")
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "c")) as f, pytest.raises(ValueError):
        W.zip_members(f)


def test_a_changed_payload_is_an_error():
    raw = W.record_bytes(1, "u", b"payload", None)
    assert W.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        W.parse_record(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_ids_of_other_types_and_clashing_columns(spark):
    rows = [("a b", "u", "<p>x", "q"), ("none", "u", "<p>x", "q"), (None, "u", "", "q"), ("é/%41", "u", "<p>y", "q"), ("", "u", "<p>z", "q")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, id string").selectExpr("*", "1 as refers_to", "2 as payload", "3 as _id", "4 as x")
    got = W.archived(spark, df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected([r[:3] for r in rows])


def test_reading_back_is_dealt_by_bytes(spark):
    df = spark.range(400).selectExpr("id as page_id", "'u' as url", "repeat(sha2(cast(id as string), 512), 40) as html")
    archives = W.write_archives(df, W.fresh(spark, "warc"))
    total = archives.agg({"n_bytes": "sum"}).first()[0]
    assert W.read_archives(archives, run_bytes=20_000, task_bytes=total // 20).rdd.getNumPartitions() >= 20  # the runs' descriptors have a few KB
    assert W.read_archives(archives, run_bytes=20_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert W.read_archives(archives, run_bytes=20_000).count() == 400 == W.read_archives(archives.select("path")).count()


def test_payloads_without_copies_are_not_dealt(spark):
    df = spark.createDataFrame([(i, "u", f"<p>{i % 90}") for i in range(100)], "page_id long, url string, html string")
    rows = W.with_revisits(df.selectExpr("page_id as id", "url", "html as payload"), 0)
    assert sorted((r.id, r.refers_to) for r in rows.collect()) == [(i, i - 90 if i >= 90 else None) for i in range(100)]


def test_attempts_do_not_touch_each_other(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", f"<p>{i}") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    first = W.write_archives(rows.orderBy("page_id"), folder, archive_bytes=900)
    before = {r.path: open(r.path.removeprefix("file://"), "rb").read() for r in first.collect()}
    again = W.write_archives(rows.orderBy(-rows.page_id), folder, archive_bytes=900)  # as a late attempt, whose rows came in another order
    (tmp_path / "w" / "pages-00000-000-lost.zip").write_bytes(b"PK half of an arch")
    assert len(before) > 1 and not set(before) & {r.path for r in again.collect()}
    assert all(open(path.removeprefix("file://"), "rb").read() == data for path, data in before.items())
    assert [sorted(r.page_id for r in W.read_archives(x).collect()) for x in (first, again)] == [list(range(40))] * 2


def test_names_of_stores(spark, tmp_path):
    settings = {"endpoint": "http://store:9000", "access.key": "k", "secret.key": "s", "path.style.access": "true", "bucket.b2.endpoint": "other:1", "bucket.b2.endpoint.region": "r2", "bucket.b2.access.key": "k2"}
    stores = Stores(settings)
    assert stores.s3_options("b1") == {"access_key": "k", "secret_key": "s", "region": "us-east-1", "endpoint_override": "store:9000", "scheme": "http", "force_virtual_addressing": False}
    assert stores.s3_options("b2") == {"access_key": "k2", "secret_key": "s", "region": "r2", "endpoint_override": "other:1", "scheme": "https", "force_virtual_addressing": False}
    assert Stores({"aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}).s3_options("b") == {"anonymous": True}
    for name in ("s3a", "s3n"):
        store, path = stores.at(f"{name}://b1/archives/a b.zip")
        assert store.type_name == "s3" and path == "b1/archives/a b.zip"
    store, path = Stores.of(spark).at(f"file://{tmp_path}/x")
    assert store.type_name == "local" and path == f"{tmp_path}/x"
    spark._jsc.hadoopConfiguration().set("fs.s3a.bucket.mine.endpoint", "here:9")
    assert Stores.of(spark).s3_options("mine")["endpoint_override"] == "here:9"
