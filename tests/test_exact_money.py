"""Costs in decimals: exact, and the same however rows are dealt."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagelake.functions import models as M
from pagelake.operators import budget, store
from pagelake.plans import queries as Q


@pytest.fixture(scope="module")
def rows(spark, sf):
    kept = Q.exact_silver(spark, sf).select("doc_id", "page_num", "model", "prompt_tokens", "completion_tokens", "cost_usd", "error").checkpoint()
    return kept


def by_hand(r):
    usd_in, usd_out = (Decimal(str(x)) for x in M.PRICES.get(r.model, (0, 0)))
    return (r.prompt_tokens * usd_in + r.completion_tokens * usd_out) / 10**6


def test_every_cost(rows):
    assert dict(rows.dtypes)["cost_usd"] == M.EXACT
    assert all(r.cost_usd == by_hand(r) for r in rows.collect())


def test_sums_under_any_partitioning(rows):
    want = sum((by_hand(r) for r in rows.collect()), Decimal(0))
    for n in (1, 3, 11):
        dealt = rows.repartition(n, F.rand(n))
        assert budget.total_cost(dealt) == want
        running = budget.running_cost(dealt, doc="doc_id", ranges=n + 1)
        assert running.agg(F.max("running_usd")).first()[0] == want
        assert store.ledger_rows(dealt).agg(F.sum("cost_usd")).first()[0] == want


def test_a_cap_is_kept_to_the_last_digit(rows):
    total = budget.total_cost(rows)
    budget.check_cap(total, total)
    budget.check_cap(total, float(total) + 1e-9)
    with pytest.raises(budget.BudgetExceeded):
        budget.check_cap(total, total - Decimal("0.000000000001"))
    ordered = sorted(rows.collect(), key=lambda r: (r.doc_id, r.page_num))
    cap = sum((by_hand(r) for r in ordered[:50]), Decimal(0))
    admitted = budget.admit(rows, cap, doc="doc_id").count()
    free = next((i for i, r in enumerate(ordered[50:]) if by_hand(r) > 0), None)
    assert admitted == 50 + free


def test_prices_of_the_caller(spark):
    df = spark.createDataFrame([("a", 3, 7), ("b", 1, 1), (None, 1, 1), ("a", None, 1)], "model string, prompt_tokens int, completion_tokens int")
    prices = spark.createDataFrame([("a", 0.1, 0.000001)], "model string, usd_in double, usd_out double")
    got = {(r.model, r.prompt_tokens): r.cost_usd for r in M.with_exact_cost(df, prices).collect()}
    assert got == {("a", 3): Decimal("0.000000300007").quantize(Decimal("1E-12")), ("b", 1): 0, (None, 1): 0, ("a", None): 0}
    assert [r.cost_usd for r in M.with_exact_cost(df, prices, strict=True).where("model = 'b'").collect()] == [None]


def test_doubles_stay_doubles(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None)], "path string, page_num int, cost_usd double")
    assert budget.total_cost(df) == 0.5 and isinstance(budget.total_cost(df), float)
    assert [r.running_usd for r in budget.running_cost(df).orderBy("page_num").collect()] == [0.5, 0.5]
    assert budget.admit(df, 0.5).count() == 2 and budget.total_cost(df.where("false")) == 0.0
