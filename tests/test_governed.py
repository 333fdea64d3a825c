"""Read plans, gated aggregates, lineage and alert chains, on small fixtures and by brute force."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.semantics import Measure
from ledgerline.operators.gated import gated_aggregate
from ledgerline.operators.read_plan import Plan, PlanColumn, apply_plan, signature
from ledgerline.operators.row_import import Entity, Field, import_rows
from ledgerline.plans import kpis, lineage
from ledgerline.streaming.alert_chain import alert_chain, alert_stream, critical

RAW = "row_no long, `Date op.` string, Sens string, Montant string, Divers string, Note string"
ROWS = [
    (2, "11/8/2016", "D", "1,50", "x", "first"), (3, "11/22/2016", " C ", "1 234,5", "x", ""), (4, "not a date", "?", "12", "y", None), (5, "", "", "", "", " "), (6, "Total général", "", "13,50", "", ""),
    (7, "1/2/2016", "D", "abc", "x", "skip me"), (8, None, "C", None, None, None), (9, "Total", "", "9,99", "zz", "and a note that hides it"),
]
PLAN = Plan((PlanColumn("Date op.", "date"), PlanColumn("Sens", "type", coded=True), PlanColumn("Montant", "amount"), PlanColumn("Divers")))


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, RAW)


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([("Sens", "D", "expense"), ("Sens", "C", "income"), ("Note", "first", "wrong column")], "column string, code string, value string")


def test_plan(spark, raw, codes):
    rows, journal = apply_plan(raw, PLAN, codes, spark.createDataFrame([(7,), (7,), (99,)], "row_no long"))
    got = {r.row_no: r for r in rows.collect()}
    assert rows.columns == ["row_no", "date", "type", "amount", "Note", "original_data"] and set(got) == {2, 3, 4, 8}
    # the 22nd proves months first for the whole column, decimals prove the comma; what can't be read stays
    assert (got[2].date, got[2].type, got[2].amount, got[2].Note) == ("2016-11-08", "expense", "1.5", "first")
    assert (got[3].date, got[3].type, got[3].amount) == ("2016-11-22", "income", "1234.5")
    assert (got[4].date, got[4].type, float(got[4].amount)) == ("not a date", "?", 12.0)
    assert json.loads(got[2].original_data) == {"Date op.": "11/8/2016", "Sens": "D", "Montant": "1,50", "Divers": "x", "Note": "first"}
    told = {r.row_no: (r.reason, r.preview) for r in journal.collect()}
    assert told == {6: ("total", "Total général | 13,50"), 7: ("ignored", "1/2/2016 | D | abc | x"), 9: ("total", "Total | 9,99 | zz | and a note that hides it")}


def test_plan_by_rules_keeps_headers(spark, raw):
    rows, _ = apply_plan(raw, Plan((PlanColumn("Date op.", None, date="DMY"), PlanColumn("Sens"), PlanColumn("Divers", excluded=True)), by_rules=True))
    assert rows.columns == ["row_no", "Date op.", "Sens", "Montant", "Note", "original_data"]
    assert {r.row_no: r["Date op."] for r in rows.collect()}[2] == "2016-08-11"  # the plan's word goes before what the column proves


def test_planned_rows_go_through_the_import(spark, raw, codes):
    rows, _ = apply_plan(raw, PLAN, codes)
    entity = Entity("Transaction", (Field("date", "date", required=True), Field("type"), Field("amount", "number", required=True)))
    got = {r.row_no: (r.status, r.reason) for r in import_rows(rows.select("row_no", "date", "type", "amount"), entity).collect()}
    assert got[2][0] == got[3][0] == "IMPORTED" and got[4] == ("QUARANTINED", "INVALID_DATE:date") and got[7] == ("QUARANTINED", "INVALID_NUMBER:amount") and got[8] == ("QUARANTINED", "MISSING_DATE:date")


def test_plan_of_nothing(spark, raw):
    rows, journal = apply_plan(raw.limit(0), PLAN)
    assert rows.count() == journal.count() == 0


def test_signature(spark):
    one = lambda h, s="": spark.range(1).select(signature(h, s)).first()[0]
    assert one(["Montant", "Date"]) == one([" date ", "MONTANT"]) != one(["Date"]) and one(["Date"], "a") != one(["Date"], "b")


def test_gate_and_fallback(spark):
    lines = spark.createDataFrame([("a", date(2024, 1, 1), 10.0, None, -1.0, None), ("b", date(2024, 1, 2), 20.0, 7.0, None, None), ("c", date(2024, 1, 3), None, None, None, None)] * 4, "order_id string, date date, subtotal double, total double, fee double, none double")
    seen = [("finance.energy", 5.0, 0.9, None), ("energy", 7.0, 0.6, None), ("energy", 100.0, 0.59, None), ("energy", None, 0.9, None), ("waste", 1.0, 0.1, None), ("revenue", 3.0, 0.9, "Campaign"), ("marketing.revenue", 4.0, 0.9, None), ("sales.energy", 50.0, 1.0, None)]
    observations = spark.createDataFrame(seen, "concept string, value double, confidence double, entity string")
    m = lambda key, entity, *fields, how="sum", role="flow": Measure(key, entity, fields, role, how)
    get = lambda x: (lambda r: (r.value, r.status, r.source, r.reason))(gated_aggregate(x, {"o": lines}, "2024-01-05", observations).first())
    assert get(m("revenue", "o", "subtotal", "total")) == (120.0, "VALID", "o.subtotal", None)
    assert get(m("revenue", "o", "none", "total")) == (28.0, "VALID", "o.total", None)  # the first field with any value
    assert get(m("fee", "o", "fee")) == (None, "NOT_MEASURED", "o.fee", "quality")
    # declared but empty: not measured, whatever observations say
    assert get(m("energy", "o", "none")) == (None, "NOT_MEASURED", "o.none", "no value")
    assert get(m("energy", "meters", "kwh")) == (12.0, "VALID", "observations", None)
    assert get(m("waste", "meters", "t")) == (None, "NOT_MEASURED", "observations", "trust")
    assert get(m("water", "meters", "m3")) == (None, "NOT_MEASURED", None, "no source")
    assert get(m("revenue", "x", "y")) == (None, "NOT_MEASURED", None, "no source")  # a campaign's is no revenue
    with pytest.raises(ValueError):
        get(m("price", "o", "subtotal", role="rate"))


def test_lineage_through_dependencies(spark):
    assert ("order_lines", "cost") in lineage.sources_of({k.id: k for k in kpis.KPIS}["net_margin_pct"])
    assert lineage.sources_of({k.id: k for k in kpis.KPIS}["ltv_cac_ratio"])[0][0] == "order_lines"
    orders = spark.createDataFrame([("a", date(2024, 1, 1), 10.0), ("b", date(2024, 3, 2), None)], "order_id string, date date, subtotal double")
    spent = spark.createDataFrame([], "expense_id string, date date, amount double")
    got = {r.kpi: r for r in lineage.lineage(spark, {"order_lines": orders, "expenses": spent}, "2024-03-05", ids=["total_revenue", "ebitda", "cash_runway", "order_count"]).collect()}
    r = got["total_revenue"]
    assert (r.value, r.status, r.sources, r.n_records, r.period_start, r.period_end, r.evidence, r.warnings) == (10.0, "VALID", "order_lines.subtotal", 2, date(2024, 1, 1), date(2024, 3, 2), "CALCUL", "")
    assert r.quality == 85  # half of the column is empty
    assert (got["ebitda"].evidence, got["ebitda"].warnings, got["ebitda"].value) == ("HYPOTHÈSE", "empty source", None)
    assert (got["cash_runway"].sources, got["cash_runway"].quality, got["cash_runway"].n_records, got["cash_runway"].status) == ("", None, 0, "NOT_MEASURED")


def greedy(events, quiet, alerted=()):
    """One event after the other."""
    last = dict(alerted)
    out = []
    for title, ts, event_id in sorted(events, key=lambda e: (e[1], e[2])):
        day = ts.date()
        if title not in last or day - last[title] > timedelta(quiet):
            last[title] = day
            out.append((title, day, event_id))
    return sorted(out)


def history(seed, n=400):
    r = random.Random(seed)
    return [(r.choice(["a", "b", "hot", "hot", "hot"]), datetime(2024, 1, 1) + timedelta(minutes=r.randrange(200 * 1440)), f"e{i:04}") for i in range(n)]


@pytest.mark.parametrize(("seed", "quiet"), [(1, 30), (2, 5), (3, 0)])
def test_alert_chain_against_greedy(spark, seed, quiet):
    events = history(seed)
    df = spark.createDataFrame([(f"  {t.upper()}", ts, i) for t, ts, i in events], "name string, at timestamp, id string")
    told = critical(df, F.col("name"), F.lit(True), "at", "id")
    assert sorted(tuple(r) for r in alert_chain(told, quiet).collect()) == greedy(events, quiet)
    sent = spark.createDataFrame([("HOT", date(2024, 1, 20)), ("B", None)], "title string, day date")
    later = [e for e in events if e[0] != "b"]
    assert sorted(tuple(r) for r in alert_chain(told, quiet, sent).collect()) == greedy(later, quiet, {"hot": date(2024, 1, 20)})
    assert alert_chain(critical(df, F.lit("  "), F.lit(True), "at", "id")).count() == 0 == alert_chain(critical(df, F.col("name"), F.lit(None).cast("boolean"), "at", "id")).count()


def test_alert_stream_agrees_with_batch(spark, tmp_path):
    """Events come in files out of order within the delay; a last event pushes the watermark over all days."""
    events = sorted(history(7, 150), key=lambda e: e[1])
    r = random.Random(0)
    chunks = [events[i : i + 50] for i in range(0, 150, 50)]
    for k, chunk in enumerate(chunks):
        late = [e for e in chunk if r.random() < 0.2 and k < 2]
        chunks[k] = [e for e in chunk if e not in late]
        if late:
            chunks[k + 1] = chunks[k + 1] + late
    chunks.append([("zz", datetime(2026, 1, 1), "end")])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "title string, ts timestamp, event_id string"
    for k, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        told = critical(stream, F.col("title"), F.lit(True), "ts", "event_id")
        query = alert_stream(told, "200 days", 30).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    got = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == greedy(events, 30)
