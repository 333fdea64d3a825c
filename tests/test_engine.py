"""Contract cases and oracle checks of the business-indicator engine."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import money, parsing, semantics
from ledgerline.functions.periods import align, balances_per_month, can_aggregate, cash_per_month, complete_months, densify
from ledgerline.operators import derive, profile, quality
from ledgerline.operators.dedup_engine import deduplicate, occurrence
from ledgerline.operators.row_import import Entity, Field, counters, import_rows
from ledgerline.plans import kpis, registry
from ledgerline.plans.dedup import classify
from ledgerline.plans.windows import Period, add_months, build

DATA = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [("1 736,72", 1736.72), ("1,736.72", 1736.72), ("1'736.72", 1736.72), ("(500)", -500), ("1.5M", 1.5e6), ("2,5 k", 2500), ("3 Md", 3e9), ("1,234", 1234), ("0,234", 0.234), ("1234,567", 1234.567), ("12 %", 12), ("$29.14", 29.14), ("-7", -7), ("n/a", None), ("", None), (None, None), ("1.234.567", 1234567)],
)
def test_parse_number(spark, raw, want):
    got = value(spark, parsing.parse_number(F.lit(raw).cast("string")))
    assert got == want or got == pytest.approx(want)


@pytest.mark.parametrize(
    "raw, want",
    [("2024-02-29", date(2024, 2, 29)), ("2023-02-29", None), ("31/12/2023", date(2023, 12, 31)), ("45000", date(2023, 3, 15)), ("1er mars 2024", date(2024, 3, 1)), ("5 août 2023", date(2023, 8, 5)), ("2024-05", date(2024, 5, 1)), ("2024-01-02T10:00:00", date(2024, 1, 2)), ("x", None), (None, None)],
)
def test_parse_date(spark, raw, want):
    assert value(spark, parsing.parse_date(F.lit(raw).cast("string"))) == want


def test_ex_tax_of_seven_shapes(spark):
    rows = [(950.0, None, None, None, None, None, None), (None, 950.0, None, None, None, None, None), (None, 1000.0, 1045.0, 95.0, 50.0, 10.0, 100.0), (None, 1000.0, 1045.0, 95.0, 0.05, 10.0, 100.0), (None, 950.0, 1045.0, 95.0, 50.0, 10.0, 100.0), (None, None, 1045.0, 95.0, None, None, None), (None, None, 950.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double")
    assert [r[0] for r in df.select(money.ex_tax(*(F.col(x) for x in "abcdefg"))).collect()] == [950.0] * 7


def test_labels_and_statuses(spark):
    for label, total in (("TOTAL", True), ("Sous-total :", True), ("Moyenne", True), ("Totalité", False), (None, False)):
        assert value(spark, parsing.is_summary_label(F.lit(label).cast("string"))) is total
    assert value(spark, parsing.classify_status(F.lit("Annulée et remboursée"))) == "cancelled"
    assert value(spark, parsing.canonical_key(F.lit("Coût unitaireTotal (HT)"))) == "cout_unitaire_total_ht"
    assert value(spark, parsing.branch_key(F.lit("Montréal (Centre) "))) == "centre"
    assert value(spark, money.depreciation_rate(F.lit(30.0))) == 0.3


def test_kpis_over_any_frames(spark):
    """Contract rows: what is there is measured, what is not is unknown, and a period filters flows alone."""
    orders = spark.createDataFrame([("o1", date(2024, 1, 5), 100.0, 40.0, "completed", "c1", 2.0), ("o1", date(2024, 1, 5), 50.0, 20.0, "completed", "c1", 1.0), ("o2", date(2024, 3, 1), 300.0, 100.0, "paid", "c2", 1.0), ("o3", date(2024, 3, 2), 999.0, 1.0, "Annulée", "c2", 1.0), ("o4", date(2024, 3, 3), -30.0, None, "completed", None, -1.0)], "order_id string, date date, subtotal double, cost double, status string, customer_id string, quantity double")
    payroll = spark.createDataFrame([("e1", date(2024, 3, 1), 80.0), ("e1", date(2024, 4, 1), 90.0)], "employee_id string, period date, total_cost double")
    get = lambda frames, **k: {r.kpi: (r.value, r.status) for r in kpis.compute(spark, frames, **k).collect()}
    got = get({"order_lines": orders, "payroll": payroll})
    assert got["order_revenue"] == (420.0, "VALID") and got["order_count"] == (2.0, "VALID") and got["gross_sales"] == (450.0, "VALID") and got["returns_amount"] == (30.0, "VALID")
    assert got["aov"] == (225.0, "VALID") and got["purchase_frequency"] == (1.0, "VALID") and got["payroll_total"] == (170.0, "VALID")
    assert got["rh_expense_ratio"] == (round(80 * 100 / 270, 4), "VALID")  # March alone is covered by both
    for k in ("cash_runway", "bfr", "dso", "active_customers", "inventory_value_total", "customer_sentiment_score", "churn_rate", "tps_payable", "weighted_esg_score"):
        assert got[k] == (None, "NOT_MEASURED"), k
    march = get({"order_lines": orders, "payroll": payroll}, start="2024-03-01", end="2024-03-31", ids=["order_revenue", "net_margin_pct", "payroll_total"])
    assert march == {"order_revenue": (270.0, "VALID"), "payroll_total": (80.0, "VALID"), "net_margin_pct": (round((270 - 100 - 80) * 100 / 270, 4), "UNKNOWN")}  # without expenses the profit is partial
    nothing = get({})
    assert {s for _, s in nothing.values()} == {"NOT_MEASURED"} and len(nothing) == 62
    zero = get({"expenses": spark.createDataFrame([("x", date(2024, 1, 1), 0.0)], "expense_id string, date date, amount double")}, ids=["total_expense"])
    assert zero == {"total_expense": (0.0, "VALID_ZERO")}


def statuses(df):
    return {r.row_no: r.status for r in df.collect()}


def test_dedup_engine_outcomes(spark):
    cust = spark.createDataFrame([(1, "C1", "a@x", "Ann"), (2, "c1", "a@x", "Ann"), (3, "C1", None, "Anne"), (4, "AUTO-9", None, "Bob"), (5, "AUTO-9", None, "Bob"), (6, None, None, None), (7, "C2", "b@x", "Cy")], "row_no long, customer_id string, email string, name string")
    got = statuses(deduplicate(cust, "Customer"))
    assert got == {1: "new", 2: "conflict", 3: "conflict", 4: "new", 5: "potential_duplicate", 6: "new", 7: "new"}
    again = statuses(deduplicate(cust, "Customer", cust.filter("row_no IN (4, 7)")))
    assert again[4] == "duplicate" and again[5] == "potential_duplicate" and again[7] == "duplicate" and again[1] == "new"
    pay = spark.createDataFrame([(1, "e1", "2024-01", 5.0), (2, "e1", "2024-01", 5.0), (3, "e2", "2024-01", 5.0), (4, "e2", "2024-01", 9.0), (5, "e2", "2024-01", 9.0)], "row_no long, employee_id string, period string, total_cost double")
    assert statuses(deduplicate(pay, "Payroll")) == {1: "new", 2: "duplicate", 3: "new", 4: "new", 5: "potential_duplicate"}  # e2's key is refuted
    lines = [(1, "o1", "p1", 1.0, "2024-01-01", "c"), (2, "o1", "p1", 1.0, "2024-01-01", "c"), (3, "o1", "p2", 1.0, "2024-01-02", "c"), (4, "o1", "p2", 3.0, "2024-01-01", "c")]
    schema = "row_no long, order_id string, product_id string, quantity double, date string, customer_id string"
    assert statuses(deduplicate(spark.createDataFrame(lines, schema), "Order")) == {1: "new", 2: "potential_duplicate", 3: "conflict", 4: "new"}  # p2 has two contents: no key
    assert statuses(deduplicate(spark.createDataFrame(lines[:2], schema), "Order")) == {1: "new", 2: "duplicate"}
    assert deduplicate(cust.limit(0), "Customer").count() == 0


def test_occurrences_are_counted_over_ranges(spark):
    df = spark.range(0, 50).select((F.col("id") * 7).alias("row_no"), (F.col("id") % 3).cast("string").alias("k0"))
    got = {r.row_no: r.k for r in occurrence(df, "k0", width=10).collect()}
    assert got == {7 * i: i // 3 + 1 for i in range(50)}


def test_row_import(spark):
    entity = Entity("Expense", (Field("expense_id"), Field("date", "date", required=True), Field("amount", "number", required=True), Field("paid", "boolean"), Field("kind", "enum", required=True, values=("rent", "other"), translations={"loyer": "rent"})), fallback=("expense_id", "kind", "date"))
    raw = spark.createDataFrame(
        [(1, "E1", "13/02/2024", "-1 200,50", "oui", "Loyer de mars"), (2, "E1", "13/02/2024", "-1 200,50", "oui", "Loyer de mars"), (3, "E1", "14/02/2024", "5", "oui", "rent"), (4, "", "2024-02-30", "7", "", "rent"), (5, "E5", "", "7", "non", "rent"), (6, "E6", "01/03/2024", "sept", None, "rent"), (7, "TOTAL", "", "12", "", ""), (8, None, "02/03/2024", "8", "?", "loyer"), (9, "E9", "02/03/2024", "8", "?", "")],
        "row_no long, expense_id string, date string, amount string, paid string, kind string",
    )
    got = {r.row_no: r for r in import_rows(raw, entity).collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {1: ("IMPORTED", None), 2: ("DUPLICATE", "DUPLICATE"), 3: ("CONFLICT", "CONFLICT"), 4: ("QUARANTINED", "INVALID_DATE:date"), 5: ("QUARANTINED", "MISSING_DATE:date"), 6: ("QUARANTINED", "INVALID_NUMBER:amount"), 7: ("SUMMARY_ROW", "MISSING_DATE:date"), 8: ("IMPORTED", None), 9: ("QUARANTINED", "MISSING_ENUM:kind")}
    assert (got[1].amount, got[1].paid, got[1].kind, got[1].date) == (1200.5, True, "rent", date(2024, 2, 13)) and got[8].expense_id == "AUTO-rent - 2024-03-02" and got[8].paid is None
    assert sum(r.n for r in counters(import_rows(raw, entity)).collect()) == 9
    again = {r.row_no: r.status for r in import_rows(raw, entity, import_rows(raw, entity).filter("status = 'IMPORTED'").drop("status", "reason", "is_summary")).collect()}
    assert again[1] == again[2] == again[8] == "DUPLICATE" and again[3] == "CONFLICT"
    assert import_rows(raw.limit(0), entity).count() == 0


def test_conventions_and_readers(spark):
    col = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    convention = lambda xs: col(xs).agg(parsing.number_convention(F.col("x"))).first()[0]
    assert convention(["1,234.5", "7"]) == "point" and convention(["1.234,5"]) == "comma" and convention(["22.368", "1.234"]) is None and convention(["1.5", "1,5"]) is None and convention([None, "n/a"]) is None
    assert value(spark, parsing.parse_number_by(F.lit("22.368"), F.lit("point"))) == 22.368 and value(spark, parsing.parse_number_by(F.lit("22.368"), F.lit(None).cast("string"))) == 22368
    dates = lambda xs: col(xs).agg(parsing.date_convention(F.col("x"))).first()[0]
    assert dates(["13/02/2024", "01/02/2024"]) == "DMY" and dates(["02/13/2024"]) == "MDY" and dates(["13/02/2024", "02/13/2024"]) is None and dates(["1/2/2024"]) is None
    for raw, want in (("2024-03", "2024-03"), ("3/2024", "2024-03"), ("2024.12", "2024-12"), ("13/2024", None), ("Mars 2024", "2024-03"), ("févr. 2024", "2024-02"), ("2024-03-05", "2024-03-05"), ("x", None), (None, None)):
        assert value(spark, parsing.period_month(F.lit(raw).cast("string"))) == want, raw
    for first, blanks, want in (("TOTAL", 0, True), ("Grand total annuel", 0, True), ("Total 2024", 0, True), ("Total Laval", 0, False), ("Total Laval", 2, True), ("Moyenne", 0, False), ("Moyenne", 1, True), ("Totalement", 3, False), (None, 5, False)):
        assert value(spark, parsing.is_summary_row(F.lit(first).cast("string"), F.lit(blanks), F.lit(5))) is want, first
    enum = lambda x, **k: value(spark, parsing.coerce_enum(F.lit(x).cast("string"), {"annulée": "cancelled"}, ["cancelled", "on-hold"], **k))
    assert enum("ANNULEE") == "cancelled" and enum("On hold") == "on-hold" and enum("bien annulée hier", by_word=True) == "cancelled" and enum("zzz") == "autre" and enum(" ") is None and enum("zzz", fallback=None) is None
    for raw, want in (("Oui", True), ("0", False), ("faux", False), ("?", None), (None, None)):
        assert value(spark, parsing.parse_boolean(F.lit(raw).cast("string"))) is want


def test_money(spark):
    for raw, want in (("usd", "USD"), ("€", "EUR"), ("Livres sterling", "GBP"), ("C$", "CAD"), ("dollars américains", "USD"), ("zloty", None), (None, None)):
        assert value(spark, money.currency_code(F.lit(raw).cast("string"))) == want
    assert value(spark, money.row_currency(F.lit("?"), F.lit("Royaume-Uni"))) == "GBP" and value(spark, money.row_currency(F.lit(None).cast("string"), F.lit("Narnia"))) is None
    for margin, cost, price, want in ((0.4, 6.0, 10.0, 40.0), (4.0, 6.0, 10.0, 40.0), (35.0, 6.0, 10.0, 35.0), (400.0, 6.0, 10.0, 40.0), (None, 6.0, 10.0, 40.0), (0.0, 6.0, 10.0, 40.0), (0.3, None, None, 30.0), (30.0, None, 10.0, 30.0), (None, None, None, None)):
        got = value(spark, money.product_margin_pct(F.lit(margin).cast("double"), F.lit(cost).cast("double"), F.lit(price).cast("double")))
        assert got == want or got == pytest.approx(want)
    o = spark.createDataFrame([("USD", 10.0), ("CAD", 5.0), ("CAD", 6.0), ("GBP", 7.0), (None, 1.0)], "currency string, total double")
    x = money.normalise_currencies(o)
    assert Counter((r.currency, r.total, r.left_out) for r in money.normalise_currencies(x).collect()) == Counter([("CAD", 13.5, False), ("CAD", 5.0, False), ("CAD", 6.0, False), ("GBP", 7.0, True), ("CAD", 1.0, False)])
    assert {r.reference for r in money.normalise_currencies(o, "USD").collect()} == {"USD"}
    assert money.normalise_currencies(o.limit(0)).count() == 0


def test_derivations(spark):
    o = derive.order(spark.createDataFrame([(None, 2.0, 10.0, 4.0, 0.1, "US$"), ("A", None, None, None, None, None)], "order_id string, quantity double, unit_price double, unit_cost double, discount double, currency string"))
    a, b = sorted(o.collect(), key=lambda r: r.order_id == "A")
    assert a.order_id.startswith("AUTO-") and (a.total_revenue, a.total_cost, a.gross_profit, a.gross_margin, a.currency) == (18.0, 8.0, 10.0, 55.56, "USD") and b.total_revenue is None and b.gross_margin is None
    t = derive.transaction(spark.createDataFrame([("Dépense", 5.0, None), (None, -5.0, None), (None, 5.0, "Loyer de mars"), (None, 5.0, "divers")], "type string, amount double, description string"))
    assert [(r.type, r.amount, r.currency) for r in t.collect()] == [("expense", 5.0, "CAD"), ("expense", 5.0, "CAD"), ("expense", 5.0, "CAD"), (None, 5.0, "CAD")]
    p = derive.payroll(spark.createDataFrame([("Janvier 2024", 10.0, None), ("x", None, None)], "period string, regular_pay double, bonus double")).collect()
    assert [(r.period, r.total_cost) for r in p] == [("2024-01", 10.0), ("x", None)]
    assert derive.asset(spark.createDataFrame([("Four à pain", 100.0, 130.0)], "description string, initial_cost double, accumulated_depreciation double")).select("asset_id", "net_book_value").first() == ("AST-FOUR_A_PAIN", 0.0)
    assert derive.cash_flow(spark.createDataFrame([(5.0, None), (None, None)], "cash_in double, cash_out double")).select("net_cash_flow").collect() == [(5.0,), (None,)]


def test_cash_per_month_three_ways(spark):
    rows = [(date(2024, 1, 5), 10.0, 4.0, 106.0), (date(2024, 1, 9), 1.0, 0.0, 107.0), (date(2024, 3, 1), 0.0, 7.0, 100.0), (date(2024, 4, 2), 9.0, 0.0, 109.0)]
    df = spark.createDataFrame(rows, "date date, cash_in double, cash_out double, closing_cash double")
    got = lambda x: {r.month.month: r.net_flow for r in cash_per_month(x, "2024-04-15").collect()}
    assert got(df) == {1: 7.0, 3: -7.0} and got(df.select("date", "closing_cash")) == {3: -7.0}
    assert got(df.withColumn("net_cash_flow", F.lit(2.0))) == {1: 4.0, 3: 2.0}
    assert [r.balance for r in balances_per_month(df, 100.0, "2024-04-15").orderBy("month").collect()] == [107.0, 107.0, 100.0]


def test_profiles_and_quality(spark):
    df = spark.createDataFrame([("a", "1", "2024-01-01", None), ("b", "2", "2024-01-02", " "), ("a", "3", "02/03/2024", None), ("a", None, "x", None)], "k string, n string, d string, e string")
    got = {r.name: r for r in profile.column_profile(df).collect()}
    assert (got["k"].logical_type, got["k"].is_dimension, got["n"].logical_type, got["n"].nulls, got["e"].logical_type, got["e"].n_distinct) == ("category", True, "integer", 1, "empty", 0)
    keys = {r.name: r.is_key for r in profile.key_candidates(df, ["k", "n", "d"]).collect()}
    assert keys == {"k": False, "n": False, "d": True, "k+n": False, "k+d": True, "n+d": False}
    rel = {r.relation: (r.n, r.holds) for r in profile.column_relations(spark.createDataFrame([(2.0, 3.0, 6.0, 40.0, 100.0, 0.4), (1.0, 5.0, 5.0, 50.0, 100.0, 50.0)], "quantity double, unit_cost double, total_cost double, gross_profit double, total_revenue double, gross_margin double")).collect()}
    assert rel == {"quantity_cost_total": (2, True), "gross_profit": (2, False), "gross_margin": (2, True)}
    q = quality.source_quality(spark.createDataFrame([(date(2024, 1, 1), 5.0, "a"), (date(2024, 4, 1), 0.0, "a"), (None, 7.0, "b")], "d date, v double, k string"), "s", "2024-03-15", "d", "v", "k").first()
    assert (q.n, q.undated, q.future, q.zero, q.duplicates, q.month_gaps, q.verdict) == (3, 1, 1, 1, 1, 2, "error")
    assert quality.source_quality(spark.createDataFrame([], "d date, v double, k string"), "s", "2024-03-15", "d", "v", "k").first().verdict == "skip"


def test_grains_and_windows():
    assert can_aggregate("day", "month") and not can_aggregate("month", "day") and align("week", "year") == "year" and align("month", "order") is None


def test_order_statistic(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 9, 9, 2, 7, 7, 3]], "v double")
    assert parsing.upper_median(df, "v").first()[0] == 7.0
    assert parsing.order_statistic(df, "v", 0.75, "q").first()[0] == 9.0
    assert parsing.upper_median(df.limit(0), "v").first()[0] is None


def test_periods():
    assert build("CLOSED_MONTH", date(2024, 3, 10)) == Period(date(2024, 2, 1), date(2024, 2, 29))
    assert build("QTD", date(2024, 5, 10)).start == date(2024, 4, 1)
    assert Period(date(2024, 2, 1), date(2024, 2, 29)).shift(-1) == Period(date(2024, 1, 1), date(2024, 1, 31))
    assert Period(date(2024, 2, 29), date(2024, 2, 29)).year_before().start == date(2023, 2, 28)
    assert add_months(date(2024, 1, 31), 1) == date(2024, 2, 29) and add_months(date(2024, 1, 15), -13) == date(2022, 12, 15)
    with pytest.raises(ValueError):
        build("CUSTOM", date(2024, 1, 1))


def test_calendar(spark):
    m = spark.createDataFrame([(date(2024, 1, 1), 5.0), (date(2024, 4, 1), 7.0), (date(2024, 5, 1), 1.0)], "month date, v double")
    assert [r.v for r in densify(m, "v").orderBy("month").collect()] == [5.0, 0.0, 0.0, 7.0, 1.0]
    assert complete_months(m, "2024-05-20").count() == 3  # too few earlier months: the running one stays
    assert complete_months(m, "2024-05-20", least=2).count() == 2
    assert densify(m.limit(0), "v").count() == 0


def test_duplicates_conflicts_and_metamorphosis(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "c", 4), (None, "c", 5)]
    df = spark.createDataFrame(rows, "key int, content string, n int")
    for x in (df, df.repartition(3), df.select("n", "content", "key")):
        got = classify(x.filter("key IS NOT NULL").withColumn("n", F.col("n")), ["key"], ["content"], ["n"])
        assert Counter(r.status for r in got.collect()) == Counter({"new": 2, "conflict": 1, "duplicate": 1})


def test_kpi_order_and_cycles():
    ids = [k.id for k in kpis.ordered()]
    assert len(ids) == 62 and ids.index("total_revenue") < ids.index("gross_margin_amount") and ids.index("ebitda") < ids.index("net_income") < ids.index("net_margin_pct")
    with pytest.raises(ValueError):
        kpis.ordered([kpis.Kpi("a", "b + 1", ""), kpis.Kpi("b", "a + 1", "")])


def test_stocks_and_rates_are_never_summed(spark):
    wrong = semantics.Measure("s", "inventory", ("q",), semantics.STOCK, "sum")
    with pytest.raises(ValueError):
        semantics.aggregate(spark.range(1), wrong)
    m = semantics.MEASURES
    assert not semantics.can_add(m["order_discount"], m["supplier_esg"]) and semantics.can_add(m["revenue"], m["cogs"])
    assert semantics.aggregate(spark.range(3), m["revenue"]).first()["status"] == "NOT_MEASURED"


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 6)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())
    assert Counter(tuple(_norm(v) for v in r) for r in got.select(*(f"`{c}`" for c in cols)).collect()) == want


def test_whole_tables(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    n = lines.count()
    assert registry.QUERIES["n_parse_number"](spark, DATA).filter("parsed IS NOT NULL").count() == n
    assert registry.QUERIES["n_order_derivations"](spark, DATA).count() == n
    got = registry.QUERIES["b_complete_months"](spark, DATA).agg(F.sum("revenue")).first()[0]
    assert got == pytest.approx(registry.QUERIES["b_monthly_buckets"](spark, DATA).filter("month < DATE '2001-08-01'").agg(F.sum("revenue")).first()[0])
