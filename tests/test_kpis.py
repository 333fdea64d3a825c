"""Indicators of several sources, money booked twice, and what makes a value unknown or partial."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date

import pytest

from ledgerline.operators.booking import already_booked
from ledgerline.plans import kpis

LINE = "order_id string, date date, subtotal double, cost double, status string, customer_id string, quantity double"
MOVE = "transaction_id string, date date, amount double, type string, currency string, status string, category string, description string"
SLIP = "employee_id string, period date, total_cost double"
PAID = "expense_id string, date date, amount double"


def orders(spark, months, year=2024):
    return spark.createDataFrame([(f"o{m}", date(year, m, 5), 1000.0, 0.0, "paid", "c", 1.0) for m in months], LINE)


def slips(spark, months, amount=100.0, year=2024):
    return spark.createDataFrame([("e", date(year, m, 1), amount) for m in months], SLIP)


def moves(spark, rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], MOVE)


def get(spark, frames, *ids, **k):
    return {r.kpi: (r.value, r.status) for r in kpis.compute(spark, frames, ids=list(ids), **k).collect()}


PROFIT = ("ebitda", "net_income", "total_charges", "net_margin_pct", "rh_expense_ratio")


def test_profit_over_the_months_in_common(spark):
    """Six months of orders against twelve of payroll: only six of payroll count. Expenses are missing, so profit is partial."""
    got = get(spark, {"order_lines": orders(spark, range(1, 7)), "payroll": slips(spark, range(1, 13))}, *PROFIT, "payroll_total")
    assert got == {"ebitda": (5400.0, "UNKNOWN"), "net_income": (5400.0, "UNKNOWN"), "total_charges": (600.0, "UNKNOWN"), "net_margin_pct": (90.0, "UNKNOWN"), "rh_expense_ratio": (10.0, "VALID"), "payroll_total": (1200.0, "VALID")}


def test_months_in_common_take_all_sources(spark):
    """Transactions from March on cut orders and payroll; without expenses in the ratio of pay, expenses cut nothing there."""
    frames = {
        "order_lines": orders(spark, range(1, 7)), "payroll": slips(spark, range(1, 13)), "transactions": moves(spark, [(date(2024, m, 9), 10.0, "expense", "CAD", None, None, None) for m in range(3, 9)]),
        "expenses": spark.createDataFrame([("a", date(2024, 5, 1), 50.0), ("b", date(2024, 9, 1), 70.0), ("c", None, 5.0)], PAID),
    }
    got = {r.kpi: r for r in kpis.shared_months(spark, frames).collect()}
    # May and June are in all four; the expense without a date stays
    assert (got["ebitda"].value, got["ebitda"].status, got["ebitda"].first_month, got["ebitda"].last_month) == (2000.0 - 20 - 55 - 200, "VALID", date(2024, 5, 1), date(2024, 6, 1))
    assert (got["rh_expense_ratio"].value, got["rh_expense_ratio"].first_month) == (10.0, date(2024, 3, 1))
    assert (got["total_expense"].value, got["total_expense"].first_month) == (60.0 + 125, None)


def test_no_month_in_common_and_a_lone_month(spark):
    apart = get(spark, {"order_lines": orders(spark, (1, 2)), "payroll": slips(spark, (5, 6))}, *PROFIT)
    assert set(apart.values()) == {(None, "NOT_MEASURED")}
    # a source of one month may be a year's total: nothing is cut
    lone = get(spark, {"order_lines": orders(spark, range(1, 7)), "payroll": slips(spark, (6,), 1200.0)}, "ebitda")
    assert lone == {"ebitda": (4800.0, "UNKNOWN")}
    # months apart are no common period, lone or not
    assert get(spark, {"order_lines": orders(spark, (1, 2)), "payroll": slips(spark, (6,))}, "ebitda") == {"ebitda": (None, "NOT_MEASURED")}


def test_money_that_has_not_moved(spark):
    rows = [(date(2024, 1, 2), 500.0, "income", "CAD", "Complétée", None, None), (date(2024, 1, 3), 700.0, "income", "CAD", "En attente", None, None), (date(2024, 1, 3), 9.0, "Dépense", "CAD", "annulée", None, None), (date(2024, 1, 4), -20.0, "Sortie", "CAD", None, None, None)]
    assert get(spark, {"transactions": moves(spark, rows)}, "total_revenue", "total_expense") == {"total_revenue": (500.0, "VALID"), "total_expense": (20.0, "VALID")}


def test_orders_without_an_id(spark):
    lines = spark.createDataFrame([(None, date(2024, 1, 2), 10.0, 1.0, "paid", None, 1.0), ("", date(2024, 1, 2), 10.0, 1.0, "paid", "c", 1.0)] * 3, LINE)
    got = get(spark, {"order_lines": lines}, "order_revenue", "order_count", "aov")
    assert got == {"order_revenue": (60.0, "VALID"), "order_count": (None, "NOT_MEASURED"), "aov": (None, "NOT_MEASURED")}
    voided = spark.createDataFrame([("o", date(2024, 1, 2), 10.0, 1.0, "annulée", "c", 1.0)], LINE)
    assert get(spark, {"order_lines": voided}, "order_count") == {"order_count": (0.0, "VALID_ZERO")}


def test_expenses_that_net_to_nothing(spark):
    """Unknown, unless all of them were booked elsewhere."""
    day = date(2024, 3, 1)
    nothing = moves(spark, [(day, 0.0, "expense", "CAD", None, None, None)])
    assert get(spark, {"transactions": nothing}, "total_expense") == {"total_expense": (None, "NOT_MEASURED")}
    paid = moves(spark, [(day, 80.0, "expense", "CAD", None, None, None)])
    assert get(spark, {"transactions": paid, "payroll": slips(spark, (3,), 80.0)}, "total_expense") == {"total_expense": (0.0, "VALID_ZERO")}
    assert get(spark, {"transactions": paid, "payroll": slips(spark, (3,), 80.01)}, "total_expense") == {"total_expense": (80.0, "VALID")}


def test_rates_are_an_argument(spark):
    rows = moves(spark, [(date(2024, 1, 2), 100.0, "income", "EUR", None, None, None)])
    assert get(spark, {"transactions": rows}, "total_revenue") == {"total_revenue": (None, "NOT_MEASURED")}
    assert get(spark, {"transactions": rows}, "total_revenue", rates={"CAD": 1.0, "EUR": 1.5}) == {"total_revenue": (150.0, "VALID")}


def walk(moves, expenses, slips):
    """The cascade, one transaction after the other."""
    key = lambda d, a: (d, round(abs(a or 0) * 100))
    left, pay, months = Counter(key(d, a) for _, d, a in expenses), Counter(key(d, a) for _, d, a in slips), {d.replace(day=1) for _, d, _ in slips if d}
    for i, d, a, *_, label in sorted(moves, key=lambda r: int(r[0])):
        k = key(d, a)
        if left[k]:
            left[k] -= 1
            yield i, "expense"
        elif pay[k]:
            pay[k] -= 1
            yield i, "pay slip"
        else:
            yield i, "month's payroll" if d and d.replace(day=1) in months and "paie" in (label or "").lower() else None


@pytest.mark.parametrize("seed", [1, 2])
def test_booking_against_a_walk(spark, seed):
    r = random.Random(seed)
    day = lambda: r.choice([None, *(date(2024, m, d) for m in (1, 2, 3) for d in (1, 2))])
    amount = lambda: r.choice([10.0, -10.0, 10.001, 20.0, None, 0.0])
    rows = [(str(i), day(), amount(), "expense", "CAD", None, None, r.choice([None, "Virement PAIE", "loyer"])) for i in range(400)]
    spent, paid = [(str(i), day(), amount()) for i in range(60)], [(str(i), r.choice([None, date(2024, 1, 1), date(2024, 3, 2)]), amount()) for i in range(40)]
    got = already_booked(spark.createDataFrame(rows, MOVE), spark.createDataFrame(spent, PAID), spark.createDataFrame(paid, SLIP))
    assert got.columns == [*[x.split()[0] for x in MOVE.split(", ")], "booked_by"]
    assert {x.transaction_id: x.booked_by for x in got.collect()} == dict(walk(rows, spent, paid))


def test_booking_of_one_frequent_amount(spark):
    """A day and amount with very many rows is numbered over ranges; the first ones are covered."""
    t = spark.range(2_500_000).selectExpr("id AS transaction_id", "DATE '2024-01-01' AS date", "5.0D AS amount")
    x = spark.range(1_200_000).selectExpr("id AS expense_id", "DATE '2024-01-01' AS date", "-5.0D AS amount")
    got = already_booked(t, x, spark.createDataFrame([("e", date(2024, 1, 1), 5.0)], SLIP)).groupBy("booked_by").agg({"transaction_id": "max", "*": "count"}).collect()
    assert {(r.booked_by, r["count(1)"], r["max(transaction_id)"]) for r in got} == {("expense", 1_200_000, 1_199_999), ("pay slip", 1, 1_200_000), (None, 1_299_999, 2_499_999)}


def test_entities_that_nobody_passed(spark):
    """A frame without rows was passed; one that isn't there was forgotten."""
    assert kpis.not_given({}, ["cac"]) == ["campaign_days"] and kpis.not_given({"campaign_days": spark.createDataFrame([], SLIP)}, ["cac"]) == []
    assert kpis.not_given({"order_lines": orders(spark, (1,))}, ["ebitda"]) == ["expenses", "payroll", "transactions"]
