"""Column functions against small Python versions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pagelake.backends.base import clean_answer
from pagelake.functions import models as M
from pagelake.functions import text as X

PIECES = ["a", "B", "é", "İ", "ß", "|", "-", ":", " ", "\t", "\n", "\r\n", "\x1c", " ", "\u0085", " ", "```", "```markdown\n", "Sure. ", "Here is x: ", "---", "| a | b |\n", "|---|:-:|\n"]


def texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]


def norm(s: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"```(?:markdown|md)?\s*\n?|\n?```", "", s).strip().lower())


def lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def firsts(s: str) -> str:
    return "|".join(re.split(r"\s+", x.strip(), maxsplit=1)[0].lower() for x in s.splitlines() if x.strip())


def grouped(md: str) -> list[list[list[str]]]:
    out, rows = [], []
    for line in md.splitlines():
        if "|" in line:
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                rows.append(cells)
        elif rows:
            out, rows = [*out, rows], []
    return [*out, rows] if rows else out


def test_recipes_match_python(spark):
    pairs = list(zip(texts(300, 1), texts(300, 2), strict=True))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", X.clean_markdown("a").alias("clean"), X.normalize("a").alias("norm"), X.normalized_edit_distance("a", "b").alias("ed"), X.reading_order_distance("a", "b").alias("ro"), X.tables("a").alias("t"), X.table_rows("a").alias("r"), X.table_cell_f1("a", "b").alias("f1")).collect()
    for row in got:
        a, b = pairs[row.i]
        na, nb = norm(a), norm(b)
        assert row.clean == clean_answer(a), repr(a)
        assert row.norm == na, repr(a)
        assert row.ed == pytest.approx(lev(na, nb) / max(len(na), len(nb)) if na or nb else 0.0)
        fa, fb = firsts(a), firsts(b)
        assert row.ro == pytest.approx(lev(fa, fb) / max(len(fa), len(fb), 1))
        assert row.t == grouped(a), repr(a)
        assert row.r == [r for t in grouped(a) for r in t]
        e, c = ({x.lower() for t in grouped(s) for r in t for x in r if x} for s in (b, a))
        assert row.f1 == pytest.approx(1.0 if not e else 2 * len(e & c) / (len(e) + len(c)))


@pytest.mark.parametrize(
    ("raw", "loose", "strict"),
    [
        (None, "", ""), ("   x ", "x", "x"), ("```md\n# T\n```", "# T", "# T"), ("```\na\n```\nrest", "```\na\n```\nrest", "```\na\n```\nrest"),
        ("Here's the page: # T", "# T", "# T"), ("Sure, here. Text", "Text", "Text"), ("Of course! A: b", "b", "b"), ("Surety bonds. rest", "rest", "Surety bonds. rest"),
    ],
)
def test_clean_markdown(spark, raw, loose, strict):
    row = spark.createDataFrame([(raw,)], "x string").select(X.clean_markdown("x"), X.clean_markdown("x", strict_preamble=True)).first()
    assert (row[0], row[1]) == (loose, strict)


def test_metric_literals(spark):
    df = spark.createDataFrame([("foo bar baz", ["bar", "baz"]), ("foo", ["bar", "baz"]), ("Foo Bar", ["bar"]), ("x", []), ("x", None), (None, ["a"]), ("aa", ["a", "a", "b"])], "t string, a array<string>")
    assert [round(r[0], 6) for r in df.select(X.anchor_recall("t", "a")).collect()] == [1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.666667]
    row = spark.createDataFrame([("hello world", "hallo world")], "a string, b string").select(X.normalized_edit_distance("a", "b")).first()
    assert row[0] == pytest.approx(1 / 11)


def test_paths_and_bytes(spark):
    names = ["/x/y/report.final.pdf", "a.pdf", ".hidden", "noext", "/d/.x.md", "s3://b/k/p.PDF"]
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "p string").select(X.base_name("p"), X.stem("p")).collect()]
    assert got == [("report.final.pdf", "report.final"), ("a.pdf", "a"), (".hidden", ".hidden"), ("noext", "noext"), (".x.md", ".x"), ("p.PDF", "p")]
    png = bytes.fromhex("89504e470d0a1a0a") + bytes(200)
    row = spark.createDataFrame([(bytearray(png),)], "b binary").select(X.data_uri("b"), X.is_png("b")).first()
    import base64

    assert row[0] == "data:image/png;base64," + base64.b64encode(png).decode() and row[1]


def test_costs(spark):
    assert M.estimate_cost("qwen/qwen3-vl-instruct", 1_000_000, 1_000_000) == pytest.approx(0.8)
    assert M.estimate_cost("nobody", 10, 10) == 0.0 and not M.is_priced("nobody")
    assert M.page_estimate("x", 10, "mock") == 0.0 and M.page_estimate("x", 10, "modal") == pytest.approx(0.005)
    rows = spark.createDataFrame([("gemini-2.0-flash", 1000, 2000), ("nobody", 1, 1), (None, 1, 1)], "model string, prompt_tokens int, completion_tokens int")
    assert [round(r[0], 9) for r in M.with_cost(rows).select("cost_usd").collect()] == [0.000675, 0.0, 0.0]
    own = spark.createDataFrame([("nobody", 1.0, 1.0)], "model string, usd_in double, usd_out double")
    assert M.with_cost(rows, own).where("cost_usd > 0").count() == 1
    assert M.with_cost(rows, M.price_table(spark), strict=True).where("cost_usd IS NULL").count() == 2
    assert rows.select(M.money(F.lit(1.23456))).first()[0] == "$1.2346"


def test_prompts_and_answers(spark):
    assert M.prompt_for("m", "own") == "own" and M.prompt_for("Qwen/x").endswith(M.QWEN_SUFFIX) and M.sampling_for("Qwen/Qwen3-VL-Instruct")["top_p"] == 0.95
    df = spark.createDataFrame([("QWEN-2", ""), ("m", None), ("m", "own")], "m string, o string").select(M.prompt_column("m", "o"))
    assert [r[0] for r in df.collect()] == [M.PROMPT + M.QWEN_SUFFIX, M.PROMPT, "own"]
    body = '{"candidates":[{"content":{"parts":[{"text":"T"}]}}],"usageMetadata":{"promptTokenCount":3}}'
    row = spark.createDataFrame([(body,)], "b string").select(M.gemini_answer("b").alias("a")).first().a
    assert (row["content"], row.prompt_tokens, row.completion_tokens, row.error) == ("T", 3, 0, None)
    import json

    request = spark.range(1).select(M.chat_request_column(F.lit("m"), F.lit('say "x"'), F.lit("data:u"))).first()[0]
    assert json.loads(request)["messages"] == M.chat_request("m", 'say "x"', "data:u")["messages"]
    kinds = spark.createDataFrame([(x,) for x in (None, "missing API key", "rate_limit: a", "http 404: b", "parse: c", "ValueError: d")], "e string").select(M.error_kind("e"))
    assert [r[0] for r in kinds.collect()] == ["none", "auth", "rate_limit", "http", "parse", "exception"]
