"""Sources, OCR step, budget, storage, evaluation, reports, pipeline and stream on small inputs."""

from __future__ import annotations

import hashlib
import json
import sys
import time

import pytest
from pyspark.sql import functions as F

from pagelake import BudgetExceeded, OCROutput, OCRPipeline
from pagelake.functions import models as M
from pagelake.functions import text as X
from pagelake.operators import budget, reports, store
from pagelake.operators.evaluate import Evaluator, assert_golden, score_documents
from pagelake.operators.ocr import cached_backend, make_ocr_udf, parse_batch, run_ocr, run_ocr_once_each
from pagelake.schema import SILVER_COLUMNS
from pagelake.sources import dimensions as D
from pagelake.sources import documents as S

SILVER = "path string, filename string, page_num int, markdown string, doc_type string, confidence double, prompt_tokens int, completion_tokens int, cost_usd double, model string, error string"


def silver(spark, rows):
    return spark.createDataFrame([(p, p, n, md, "other", 1.0, 1, 1, cost, "m", err) for p, n, md, cost, err in rows], SILVER)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("x" * 1800 + "yé")
    (tmp_path / "sub" / "b.txt").write_text("z")  # Spark leaves files of no bytes out
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.PDF").write_bytes(b"no")
    return tmp_path


def test_scan_and_pages(spark, folder):
    docs = S.scan_documents(spark, str(folder), "*.txt")
    assert docs.count() == 3 and S.scan_documents(spark, str(folder)).count() == 0
    assert S.scan_documents(spark, str(folder), "*.txt", min_bytes=1000).count() == 1
    assert sorted(r.name for r in S.list_documents(spark, str(folder)).collect()) == ["a.txt", "b.txt", "bad.txt", "c.PDF"]
    pages = S.explode_pages(docs, S.TextExtractor())
    assert sorted((r.filename, r.page_num, len(r.page_png)) for r in pages.collect()) == [("a.txt", 1, 1800), ("a.txt", 2, 3), ("b.txt", 1, 1), ("bad.txt", 0, 90)]
    cause = "UnicodeDecodeError: 'utf-8' codec can't decode byte 0xff in position 0: invalid start byte"
    assert [bytes(r.page_png).decode() for r in pages.where("page_num = 0").collect()] == [cause]
    assert [r.error for r in run_ocr(pages, "mock", "mock-model").where("page_num = 0").collect()] == [cause]
    assert S.explode_pages(docs, S.TextExtractor(max_pages=1), keep_failed=False).count() == 2
    assert S.one_document(spark, b"abc").first()["path"] == "<bytes>"
    plan = S.scan_documents(spark, str(folder), "*.txt", max_bytes=10)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(length,10)" in plan


def test_simple_pdf_is_fixed():
    a, b = (S.simple_pdf([["INV-2024-001", "total (1)"], ["p2"]]) for _ in range(2))
    assert a == b and a.startswith(b"%PDF") and a.count(b"/Type /Page ") == 2
    with pytest.raises((RuntimeError, ValueError, Exception)):
        S.PageExtractor().extract(b"not a pdf")


def test_text_pages_agree_with_the_extractor(spark):
    texts = ["", None, "a", "é" * 1800, "é" * 1801, "x" * 3601]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.page_num): r.page_text for r in S.text_pages(df).collect()}
    assert got == {(i, k): p.decode() for i, t in enumerate(texts) for k, p in enumerate(S.TextExtractor().extract((t or "").encode()), 1)}


def test_ocr_step(spark, tmp_path):
    pages = spark.createDataFrame([("d", "d", i, bytearray(b"p%d" % (i % 2))) for i in range(4)], "path string, filename string, page_num int, page_png binary")
    canned = {hashlib.sha256(b"p1").hexdigest(): OCROutput(markdown="one")}
    out = run_ocr(pages, "mock", "mock-model", partitions=2, concurrency=2, canned=canned)
    assert out.columns == SILVER_COLUMNS
    rows = {r.page_num: r for r in out.collect()}
    assert rows[0].error == "p0" and rows[1].markdown == rows[3].markdown == "one" and rows[2].doc_type == "other" and rows[2].error is None
    blank = spark.createDataFrame([("d", "d", 0, bytearray())], pages.schema)
    assert run_ocr(blank, "mock", "mock-model").first().error == "ValueError: unreadable document"
    once = run_ocr_once_each(pages, f"file://{tmp_path}/once", "mock", "mock-model", canned=canned)
    assert sorted(map(str, once.collect())) == sorted(map(str, out.collect()))


def test_ocr_is_one_python_node_even_when_filtered(spark):
    udf = make_ocr_udf("mock", "mock-model")
    df = spark.createDataFrame([(bytearray(b"x"),)], "page_png binary").withColumn("ocr", udf("page_png")).select("ocr.*").where("error IS NULL")
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_parse_batch_catches_and_caches():
    class Broken:
        pass

    from pagelake.backends import Backend

    class Raises(Backend):
        def parse_image(self, image, prompt=None):
            raise KeyError("x")

    assert parse_batch(Raises("m"), "m", [b"1", b"2"])[1]["error"] == "KeyError: 'x'"
    assert cached_backend("mock", {"model": "a"}) is cached_backend("MOCK", {"model": "a"}) is not cached_backend("mock", {"model": "b"})


def test_budget(spark):
    rows = silver(spark, [(f"d{d}", p, "", 0.25, None) for d in range(5) for p in range(1, 4)] + [("d9", 1, "", None, None)])
    got = {(r.path, r.page_num): r.running_usd for r in budget.running_cost(rows, ranges=2).collect()}
    assert got == {**{(f"d{d}", p): 0.25 * (3 * d + p) for d in range(5) for p in range(1, 4)}, ("d9", 1): 3.75}
    assert budget.admit(rows, 1.0).count() == 4 and budget.total_cost(rows) == 3.75
    budget.check_cap(1.0, 1.0)
    with pytest.raises(BudgetExceeded):
        budget.preflight(rows, 0.5, 7.9)
    assert budget.calibrated_page_cost(rows, 9) == 0.25 and budget.calibrated_page_cost(rows.where("false"), 9) == 9
    assert budget.total_cost(rows.where("false")) == 0.0


def test_upsert(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    one = silver(spark, [("a", 1, "x", 0.0, None), ("a", 2, "y", 0.0, "e"), (None, 1, "n", 0.0, None)])
    assert not store.exists(spark, at)
    store.write_silver(one, at, ["path", "page_num"])
    new = silver(spark, [("a", 2, "z", 0.0, None), ("b", 1, "w", 0.0, None), (None, 1, "n", 0.0, None)])
    for expected in (5, 6):  # null keys match nothing: such a row is added each time
        got = store.write_silver(new, at, ["path", "page_num"])
        assert got.count() == expected and got.where("path = 'a' AND page_num = 2").first().markdown == "z"
    with pytest.raises(store.AmbiguousMerge):
        store.upserted(one, new.union(new), ["path", "page_num"])
    assert store.read_table(spark, at).count() == 6
    assert store.pending(one, store.read_table(spark, at)).where("path IS NOT NULL").count() == 0
    assert store.pending(new, one).where("path = 'a'").count() == 1
    ledger = store.record_costs(one, f"file://{tmp_path}/ledger", "2024-01-02 03:04:05")
    assert ledger.first().asDict() == {"ts": "2024-01-02T03:04:05Z", "model": "m", "pages": 3, "cost_usd": 0.0}
    assert store.write_bronze(one, f"file://{tmp_path}/bronze").columns[-1] == "extracted_at"
    attempts = one.withColumn("processed_at", F.lit(1)).union(new.withColumn("processed_at", F.lit(2)))
    assert {(r.path, r.page_num): r.markdown for r in store.latest(attempts).collect()} == {("a", 1): "x", ("a", 2): "z", ("b", 1): "w", (None, 1): "n"}


def test_views_and_catalogue_tables(spark):
    rows = silver(spark, [("a", 1, "x" * 400, 0.5, None), ("b", 1, None, 0.25, "e")])
    store.as_view(rows)
    got = spark.sql("SELECT filename, page_num, left(markdown, 300) AS preview FROM silver ORDER BY cost_usd DESC, filename LIMIT 20").collect()
    assert [(r.filename, r.preview and len(r.preview)) for r in got] == [("a", 300), ("b", None)]
    spark.sql("DROP TABLE IF EXISTS pagelake_silver")
    for frame in (rows, rows.select("path", "model")):
        store.save_table(frame, "pagelake_silver")
        assert spark.table("pagelake_silver").columns == frame.columns
    spark.sql("DROP TABLE pagelake_silver")


def test_dimensions(spark):
    pages = spark.createDataFrame([("a", 1, bytearray(b"1")), ("a", 2, bytearray(b"2")), ("b", 1, bytearray(b"3"))], "stem string, page_num int, page_png binary")
    truth = spark.createDataFrame([("a", None, "whole"), ("a", 2, "two")], "stem string, page_num int, gt string")
    assert [r.gt for r in D.with_ground_truth(pages, truth).orderBy("stem", "page_num").collect()] == ["whole", "two", None]
    assert [r.anchors for r in D.with_anchors(pages, D.anchors(spark, {"a": ["x"]})).orderBy("stem", "page_num").collect()] == [["x"], ["x"], []]
    canned = D.canned_results(spark, {hashlib.sha256(b"2").hexdigest(): OCROutput(markdown="two", model="old")})
    rows = [r.ocr for r in D.with_canned(pages, canned, OCROutput(markdown="d", doc_type="other"), "m").orderBy("stem", "page_num").collect()]
    assert [(r.markdown, r.model) for r in rows] == [("d", "m"), ("two", "m"), ("d", "m")]


def test_evaluation(spark, tmp_path):
    (tmp_path / "inv.md").write_text("# A\n\n| x | y |\n|---|---|\n| 1 | 2 |\n")
    (tmp_path / "rep_p2.md").write_text("second")
    (tmp_path / "rep.md").write_text("first\nsecond")
    rows = silver(spark, [("inv.pdf", 1, "# A\n\n| x | y |\n|---|---|\n| 1 | 2 |", 0.0, None), ("rep.pdf", 1, "first", 0.0, None), ("rep.pdf", 2, "second", 0.0, None), ("none.pdf", 1, "z", 0.0, None)])
    got = Evaluator(str(tmp_path), {"inv": ["X", "zzz"]}).score_df(rows)
    assert got["n_pages_scored"] == 3 and got["table_f1"] == 1.0 and got["exact_token_recall"] == pytest.approx((0.5 + 1 + 1) / 3)
    assert got["edit_distance"] == pytest.approx((0 + 7 / 12 + 0) / 3)
    whole = score_documents(rows, D.ground_truth(spark, str(tmp_path)), D.anchors(spark, {"x": []}))
    assert whole.where("filename = 'rep.pdf'").first().edit_distance == 0.0
    empty = Evaluator(str(tmp_path), {"x": []}).score_df(rows.where("filename = 'none.pdf'"))
    assert empty == {"edit_distance": 0.0, "exact_token_recall": 0.0, "table_f1": 0.0, "reading_order_ed": 0.0, "n_pages_scored": 0}
    assert assert_golden("hello world", "hello  world", spark=spark) == 0.0
    with pytest.raises(AssertionError):
        assert_golden("a", "zzzz", spark=spark)


def test_reports(spark, tmp_path):
    rows = silver(spark, [("a", 1, "t" * 600, 0.5, None), ("a", 2, None, 0.5, "bad"), ("b", 1, "u", 0.25, "")])
    summary = json.loads(reports.run_summary(rows).first()[0])
    assert summary["total_pages"] == 3 and summary["total_cost_usd"] == 1.25 and summary["failed"] == ["a p2"] and len(summary["pages"][0]["preview"]) == 500
    assert {r.filename: r.pages for r in reports.file_rollup(rows).collect()} == {"a": 2, "b": 1, None: 3}
    assert [(r.filename, r.page_num) for r in reports.top_cost(rows, 2).collect()] == [("a", 1), ("a", 2)]
    assert reports.error_rows(rows).count() == 1
    assert [r.failed for r in reports.failed_pages(rows).collect()] == ["a p2"] and reports.page_previews(rows, 2).where("preview = 'tt'").count() == 1
    many = silver(spark, [("f", i, "t", 0.0, "bad") for i in range(30)])
    short = json.loads(reports.run_summary(many, most_listed=5).first()[0])
    assert (short["total_pages"], short["n_failed"], len(short["failed"]), [p["page_num"] for p in short["pages"]]) == (30, 30, 5, [0, 1, 2, 3, 4])
    assert [r.place for r in reports.with_places(rows).orderBy("place").select("place").collect()] == [1, 2, 3]
    perf = reports.run_perf(spark, 5, output=str(tmp_path / "perf.md"))
    assert perf["pages"] == 5 and perf["errors"] == 0 and "pages_per_s" in (tmp_path / "perf.md").read_text()


def test_pipeline(spark, folder, tmp_path):
    out = f"file://{tmp_path}/out"
    run = OCRPipeline(input_path=str(folder), output_path=out, pages="text", max_cost_usd=0.0, partitions=2)
    rows = run.run(spark)
    assert sorted((r.filename, r.page_num, r.error is None) for r in rows.collect()) == [("a.txt", 1, True), ("a.txt", 2, True), ("b.txt", 1, True), ("bad.txt", 0, False)]
    assert OCRPipeline(input_path=str(folder), output_path=out, pages="text", mode="resume").run(spark).count() == 4
    frame = run.parse_single(b"x" * 2000)
    assert list(frame["page_num"]) == [1, 2] and list(frame.columns[:2]) == ["filename", "page_num"]
    with pytest.raises(ValueError):
        OCRPipeline().run(spark)


def test_admission_by_the_plan(spark, folder):
    run = OCRPipeline(backend="modal", input_path=str(folder), pages="text", max_cost_usd=0.001, over_cap="admit", keep_failed=False)
    assert sorted((r.filename, r.page_num) for r in run.run(spark).collect()) == [("a.txt", 1), ("a.txt", 2)]
    with pytest.raises(BudgetExceeded):
        OCRPipeline(backend="modal", input_path=str(folder), pages="text", max_cost_usd=0.001, keep_failed=False).run(spark)


def test_synthetic_documents(spark, tmp_path):
    from pagelake.sources import synthetic

    made = synthetic.SyntheticDocuments(tmp_path / "pdf")
    first = [p.read_bytes() for p in made.build_all()]
    assert [p.read_bytes() for p in (made.build_invoice(), made.build_report(), made.build_table())] == first
    assert sorted(r.name for r in S.list_documents(spark, str(tmp_path / "pdf"), "*.pdf").collect()) == ["synth_invoice.pdf", "synth_report.pdf", "synth_table.pdf"]
    made.write_ground_truth(tmp_path / "gt")
    texts = {stem: stem.encode() for stem in synthetic.DOCUMENTS}
    canned = synthetic.canned_for(S.TextExtractor(), texts)
    docs = spark.createDataFrame([(f"/d/{k}.pdf", bytearray(v)) for k, v in texts.items()], "path string, content binary")
    silver_rows = run_ocr(S.explode_pages(docs, S.TextExtractor()), "mock", "mock-model", canned=canned)
    scores = Evaluator(str(tmp_path / "gt"), synthetic.ANCHORS).score_df(silver_rows)
    assert scores == {"edit_distance": 0.0, "exact_token_recall": 1.0, "table_f1": 1.0, "reading_order_ed": 0.0, "n_pages_scored": 3}
    from pagelake.operators.evaluate import append_metrics

    assert append_metrics(spark, scores, f"file://{tmp_path}/metrics").count() == 5


def test_images(spark):
    from pagelake.functions import image

    assert image.png_data_uri(b"abc") == "data:image/png;base64,YWJj"
    row = spark.createDataFrame([(bytearray(reports.PIXEL),)], "b binary").select(image.downscale_udf(1)("b"), X.is_png("b"), X.data_uri("b")).first()
    assert bytes(row[0]) == reports.PIXEL and row[1] and row[2] == image.png_data_uri(reports.PIXEL)


def test_command_line(spark, folder, tmp_path, capsys):
    from pagelake.__main__ import main

    main(["run", str(folder), f"file://{tmp_path}/cli", "--pages", "text"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["total_pages"] == 4
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "b.md").write_text("x")
    main(["score", f"file://{tmp_path}/cli/silver", str(tmp_path / "truth")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_pages_scored"] == 1


def test_no_call_beyond_the_cap(spark, folder, tmp_path):
    run = OCRPipeline(backend="openrouter", model="qwen/qwen3-vl-instruct", input_path=str(folder), pages="text", max_cost_usd=0.0001, backend_kwargs={"api_key": "k", "base_url": "http://127.0.0.1:1"})
    began = time.time()
    with pytest.raises(BudgetExceeded):
        run.run(spark)
    assert time.time() - began < 30


def test_stream(spark, tmp_path):
    from pagelake.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    args = (f"file://{tmp_path}/in", f"file://{tmp_path}/silver", f"file://{tmp_path}/cp")
    for name, n in (("b.txt", 1), ("c.txt", 2), (None, 3)):
        query = ingest(spark, *args)
        query.awaitTermination(120)
        assert query.exception() is None
        assert store.read_table(spark, f"file://{tmp_path}/silver").count() == n
        if name:
            (tmp_path / "in" / name).write_text(name)


class FakeRenderer:
    """Stands in for the PDF renderer: pages are what form feeds part."""

    class Page:
        def __init__(self, text):
            self.text = text

        def get_pixmap(self, dpi, alpha):
            assert not alpha
            self.dpi = dpi
            return self

        def tobytes(self, kind):
            return b"\x89PNG\r\n\x1a\n" + f"{kind} {self.dpi} {self.text}".encode()

    class Document(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    def open(self, stream, filetype):
        if not stream.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        return self.Document(self.Page(x.decode()) for x in stream[4:].split(b"\f") if x)


def test_pages_of_a_renderer(monkeypatch):
    monkeypatch.setitem(sys.modules, "pymupdf", FakeRenderer())
    extractor = S.PageExtractor(dpi=150, max_pages=2)
    assert extractor.extract(b"%PDFone\ftwo\fthree") == [b"\x89PNG\r\n\x1a\npng 150 one", b"\x89PNG\r\n\x1a\npng 150 two"]
    assert len(S.PageExtractor().extract(b"%PDFone\ftwo\fthree")) == 3
    for broken, cause in ((b"not a pdf", "not a PDF"), (b"%PDF", "no pages")):
        with pytest.raises(ValueError, match=cause):
            extractor.extract(broken)
    rows = OCRPipeline("mock").parse_single(b"%PDFone\ftwo")
    assert rows.page_num.tolist() == [1, 2] and set(rows.error) == {None}


def test_a_missing_renderer_is_one_clear_error(spark, folder, monkeypatch):
    monkeypatch.setitem(sys.modules, "pymupdf", None)
    with pytest.raises(RuntimeError, match="needs pymupdf"):
        S.explode_pages(S.scan_documents(spark, str(folder), "*.txt"))
    with pytest.raises(RuntimeError, match="needs pymupdf"):
        OCRPipeline("mock", input_path=str(folder)).run(spark)


def test_request_column_and_dictionary_agree(spark):
    models = [*M.PRICES, "other", None]
    df = spark.createDataFrame([(m,) for m in models], "model string")
    rows = df.select("model", M.sampling_column("model").alias("s"), M.chat_request_column(F.col("model"), M.prompt_column("model"), F.lit("data:x")).alias("body")).collect()
    for r in rows:
        if r.model is not None:
            assert r.s.asDict() == M.sampling_for(r.model)
            assert json.loads(r.body) == M.chat_request(r.model, M.prompt_for(r.model), "data:x")
