"""What the larger tables showed: odd values, and plans whose shuffles and memory do not outgrow the input."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import parsing, semantics
from ledgerline.operators import anomaly, profile, row_import
from ledgerline.operators.dedup_engine import deduplicate
from ledgerline.plans import imports, kpis, registry
from ledgerline.plans.lineage import source_facts
from ledgerline.sources import catalog
from ledgerline.sources.catalog import frames

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def odd(tmp_path):
    """A folder of the small tables, some replaced by a SELECT over them; and whether a query's rows are those of its SQL."""

    def make(**instead: str) -> str:
        con = duckdb.connect()
        for f in os.listdir(SMALL):
            name = f.split(".")[0]
            if name in instead:
                con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{f}'")
                con.sql(f"COPY ({instead[name]}) TO '{tmp_path}/{f}' (FORMAT parquet)")
            else:
                os.symlink(f"{SMALL}/{f}", f"{tmp_path}/{f}")
        return str(tmp_path)

    return make


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def by_sql(name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    rel = con.sql(registry.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_amount_of_zero_is_classified(spark, odd):
    folder = odd(events="SELECT * REPLACE (CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE value END AS value) FROM events")
    assert rows(registry.QUERIES["p_classify_transaction"](spark, folder)) == by_sql("p_classify_transaction", folder)


def test_key_candidates_group_short_rows(spark):
    df = spark.createDataFrame([(1, 1.5, None), (2, 1.5, "x"), (2, -0.0, "x")], "k int, n double, d string")
    got = profile.key_candidates(df, ["k", "n", "d"])
    assert "Generate" not in plan(got) and "sha2" not in plan(got)
    assert {r.name: (r.uniqueness, r.is_key) for r in got.collect()} == {"k": (0.666667, False), "n": (0.666667, False), "d": (0.333333, False), "k+n": (1.0, True), "k+d": (0.333333, False), "n+d": (0.666667, False)}


def test_contents_with_nulls_refute_a_key(spark, odd):
    folder = odd(lineitem="SELECT * REPLACE (CASE WHEN l_quantity > 25 THEN NULL ELSE l_quantity END AS l_quantity) FROM (SELECT * FROM lineitem UNION ALL SELECT * REPLACE (51 - l_quantity AS l_quantity) FROM lineitem WHERE l_quantity < 20)")
    got = registry.QUERIES["x_composite_key_refuted"](spark, folder)
    assert rows(got) == by_sql("x_composite_key_refuted", folder)
    assert "part.parquet" not in plan(got)


def test_dedup_plans_only_what_can_matter(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, None, None), (4, None, None)], "row_no long, description string, amount double")
    got = deduplicate(t, "Transaction")
    assert plan(got).count("Exchange hashpartitioning") <= 2 and "InMemoryTableScan" not in plan(got)
    assert {r.row_no: r.status for r in got.collect()} == {1: "new", 2: "potential_duplicate", 3: "new", 4: "potential_duplicate"}
    schema = "row_no long, order_id string, product_id string, quantity double, date string, customer_id string"
    mixed = [(1, "o1", "p1", 1.0, "2024-01-01", "c"), (2, "o1", "p1", 1.0, "2024-01-01", "c"), (3, "o1", "p1", 1.0, "2024-01-02", "c"), (4, None, "p1", 2.0, None, None), (5, None, "p1", 2.0, None, None), (6, "o2", None, 1.0, None, None), (7, "o2", None, 1.0, None, None), (8, "o2", None, 3.0, None, None)]
    got = deduplicate(spark.createDataFrame(mixed, schema), "Order")
    assert {r.row_no: r.status for r in got.collect()} == {1: "new", 2: "potential_duplicate", 3: "conflict", 4: "new", 5: "potential_duplicate", 6: "new", 7: "duplicate", 8: "conflict"}
    assert "InMemoryTableScan" not in plan(registry.QUERIES["x_dedup_engine"](spark, SMALL))


def test_facts_of_a_source_take_one_pass(spark):
    df = spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr("o_orderkey AS order_id", "CAST(o_orderdate AS DATE) AS date", "IF(o_orderkey % 2 = 0, o_totalprice, NULL) AS total")
    got = source_facts({"order_lines": df}, {("order_lines", "total"), ("order_lines", "order_id")}, "2001-08-15")
    assert plan(got).count("orders.parquet") == 1
    days = df.agg({"date": "min"}).first()[0], df.agg({"date": "max"}).first()[0]
    assert got.select("order_lines__total.n", "order_lines__total.a", "order_lines__total.b").first() == (df.count(), *days)


def test_measures_of_an_entity_take_one_pass(spark):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("l_extendedprice AS subtotal", "l_quantity AS quantity", "l_orderkey AS order_id", "CAST(NULL AS DOUBLE) AS total_cost", "l_tax AS cost")
    own = [semantics.MEASURES[k] for k in ("revenue", "cogs", "sales_quantity", "order_ids", "order_unit_price")]
    got = semantics.aggregate(df, *own)
    assert plan(got).split("unit_price")[0].count("lineitem.parquet") == 1
    told = {r.key: (r.value, r.status) for r in got.collect()}
    assert told["order_unit_price"] == (None, "NOT_MEASURED") and told["order_ids"] == (df.select("order_id").distinct().count(), "VALID")
    assert told["cogs"][0] == pytest.approx(df.agg({"cost": "sum"}).first()[0]) and told["revenue"][0] == pytest.approx(df.agg({"subtotal": "sum"}).first()[0])


@pytest.mark.parametrize("name", ["b_cash_ways", "a_gated_aggregates"])
def test_what_is_read_several_times_is_kept(spark, name):
    assert "InMemoryTableScan" in plan(registry.QUERIES[name](spark, SMALL))


def test_lines_of_two_domains_are_read_once(spark):
    assert plan(registry.QUERIES["c_domain_scores"](spark, SMALL)).count("InMemoryTableScan") > 2  # two are of the domains' own rows


def test_conventions_cast_no_text(spark):
    df = spark.createDataFrame([("13/01/2024", "1,5"), ("x", ""), (None, "n/a")], "d string, n string")
    got = df.agg(parsing.date_convention(df.d).alias("d"), parsing.date_convention(df.n).alias("none"), parsing.number_convention(df.n).alias("n"))
    assert "cast(" not in plan(got).lower()  # a cast of a text that is no number costs twenty microseconds
    assert got.first() == ("DMY", None, "comma")


def test_readers_work_a_cell_out_once(spark):
    df = spark.createDataFrame([("1 234,5 k", "15 mars 2024"), ("(500)", "n/a"), ("x", "2024-02-30")], "n string, d string")
    number, date = df.select(parsing.parse_number(df.n).alias("v")), df.select(parsing.parse_date(df.d).alias("v"), parsing.parse_date(df.d, "MDY").alias("w"))
    assert plan(number).count("regexp_replace") == 2
    assert "try_cast" not in date._jdf.queryExecution().analyzed().toString()
    assert [r.v for r in number.collect()] == [1234500.0, -500.0, None]
    assert [(str(r.v), str(r.w)) for r in date.collect()] == [("2024-03-15", "2024-03-15"), ("None", "None"), ("None", "None")]


def test_quarantine_is_read_once(spark):
    spark.catalog.clearCache()
    assert registry.QUERIES["x_reprocess_quarantine"](spark, SMALL).count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 2  # the texts, and the rows read from them
    assert rows(registry.QUERIES["x_reprocess_quarantine"](spark, SMALL)) == by_sql("x_reprocess_quarantine", SMALL)


def test_anomalies_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    lists = [[1.0] * 11 + [20.0, 20.000000000000004, -1.0, None], [nan] * 8 + [inf] * 3 + [5.0], [1.0] * 5 + [inf] * 6 + [nan, nan], [5e-324, 1e-323, 1e300, -inf] * 4, [2.0] * 9 + [100.0], [3.0] * 8 + [70.0], [0.0, -0.0, None] * 5, [], [x / 7 for x in range(-5, 3000)], [1.01**x for x in range(900)]]
    frames = {f"e{n}": spark.createDataFrame([(v,) for v in x], "v double") for n, x in enumerate(lists)}
    want = set()
    for n, x in enumerate(lists):  # what is no number sorts last
        order = lambda v: (v != v, 0 if v != v else v)
        some = sorted((v for v in x if v is not None and order(v) > (False, 0)), key=order)
        over = sum(order(v) > order(20 * some[len(some) // 2]) for v in some) if len(some) >= 10 else 0
        want |= {(e, "v", sum(v is not None and v < 0 for v in x), over) for e in (f"e{n}", f"f{n}")}
    got = anomaly.anomalous(spark, frames, {e: [(e, "v"), (f"f{e[1:]}", "v")] for e in frames})
    assert {tuple(r) for r in got.select("entity", "field", "negative", "outliers").collect()} == want


def test_anomalies_read_the_lines_once_a_pass(spark, odd):
    folder = odd(lineitem="SELECT * REPLACE (CASE l_linenumber WHEN 1 THEN -l_quantity ELSE l_quantity END AS l_quantity, CASE l_orderkey % 9 WHEN 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice) FROM lineitem", events="SELECT * FROM events WHERE false")
    df = registry.QUERIES["p_anomalous_values"](spark, folder)
    told = plan(df)  # before it runs: a plan that ran is told twice
    assert rows(df) == by_sql("p_anomalous_values", folder)
    scans = sum("FileScan" in x and "l_quantity" in x for x in told.splitlines())
    assert scans == 2 * told.count("InMemoryRelation [") > 0  # what is kept reads the lines twice, as lines and as stock; nothing else does


def test_rows_of_one_block_are_dealt_out_before_they_are_read(spark):
    raw = spark.range(400).coalesce(1).selectExpr("id AS row_no", "'article' AS description", "'2024-01-05' AS date", "concat(id % 7, ',50') AS amount")
    told = plan(row_import.normalise(raw, imports.TRANSACTION))
    assert "hashpartitioning(row_no" in told and told.index("original_data") < told.index("hashpartitioning(row_no")
    assert Counter(r["status"] for r in row_import.import_rows(raw, imports.TRANSACTION).collect()) == {"IMPORTED": 7, "POTENTIAL_DUPLICATE": 393}


def test_indicators_read_only_what_they_need(spark):
    told = plan(kpis.compute(spark, frames(spark, SMALL), ids=["order_count"]))
    assert not [x for x in told.splitlines() if "FileScan" in x and ("role" in x or "c_acctbal" in x or "c_custkey" in x)]
    lines = [("1", "a", 5.0), ("1", None, 5.0), ("2", "a", 0.0), (None, "b", 5.0), (" ", None, 5.0), (None, None, 5.0)]
    df = spark.createDataFrame(lines, "order_id string, customer_id string, subtotal double")
    got = {r["kpi"]: r["value"] for r in kpis.compute(spark, {"order_lines": df}, ids=["order_count", "purchase_frequency", "arpu"]).collect()}
    assert got == {"order_count": 1.0, "purchase_frequency": 0.5, "arpu": 5.0}


@pytest.mark.parametrize("name", ["j_product_latest_inventory", "a_kpi_period", "a_kpi_catalogue"])
def test_stock_is_dealt_out_once_by_product(spark, name):
    sent = [x for x in plan(registry.QUERIES[name](spark, SMALL)).splitlines() if "Exchange hashpartitioning" in x]
    assert any("l_partkey" in x and f", {catalog.STOCK_TASKS})" in x and "REPARTITION_BY_NUM" in x for x in sent)
    assert not any("warehouse_id" in x or "l_suppkey" in x for x in sent)


def test_stock_keys_of_other_types_and_none(spark, odd):
    days = [("a", "x", "2000-01-31", 5.0, 50.0), ("a", "x", "2000-02-29", 20.0, 80.0), (None, "x", "2000-01-31", 30.0, 7.0)]
    stock = spark.createDataFrame(days, "product_id string, warehouse_id string, date string, closing_stock double, inventory_value double")
    for df in (stock, stock.withColumn("product_id", F.when(F.col("product_id") == "a", 1.5)), stock.drop("warehouse_id")):
        got = {r.kpi: r.value for r in kpis.compute(spark, {"inventory": df}, ids=["inventory_value_total", "inventory_value_average", "critical_sku_rate"]).collect()}
        assert got == {"inventory_value_total": 87.0, "inventory_value_average": 72.0, "critical_sku_rate": pytest.approx(100 / 3, abs=1e-4)}
    folder = odd(part="SELECT * FROM part WHERE p_partkey % 3 <> 0", lineitem="SELECT * REPLACE (CASE l_orderkey % 5 WHEN 0 THEN NULL ELSE l_partkey END AS l_partkey) FROM lineitem")
    assert rows(registry.QUERIES["j_product_latest_inventory"](spark, folder)) == by_sql("j_product_latest_inventory", folder)


def test_checks_sum_the_lines_once(spark):
    kept = re.findall(r"InMemoryRelation \[[^\]]*\]", registry.QUERIES["q_coherence"](spark, SMALL)._jdf.queryExecution().withCachedData().toString())
    assert len(kept) > 6 and len({re.sub(r"#\d+", "", x) for x in kept}) == 2  # the lines' sums, and stock


def test_lines_of_high_order_numbers(spark, odd):
    up = 54_000_000  # the last order of a 360-fold copy; the SQL's row numbers pass 64 bits there, so it runs on the lines as they were
    folder = odd(lineitem=f"SELECT * REPLACE (l_orderkey + {up} AS l_orderkey) FROM lineitem", orders=f"SELECT * REPLACE (o_orderkey + {up} AS o_orderkey) FROM orders")
    assert rows(registry.QUERIES["x_dedup_engine"](spark, folder)) == by_sql("x_dedup_engine", SMALL)


def test_lines_of_high_product_numbers_keep_their_order(spark, odd):
    folder = odd(lineitem="SELECT * REPLACE (l_orderkey % 300 AS l_orderkey, l_partkey * 70001 AS l_partkey, l_suppkey * 9001 AS l_suppkey) FROM lineitem")
    assert rows(registry.QUERIES["x_dedup_engine"](spark, folder)) == by_sql("x_dedup_engine", folder)
