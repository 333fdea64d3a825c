"""Periods, windows and comparisons; all dates are arguments."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import month, trend_direction, trend_pct
from ..functions.rules import half_up
from ..sources import catalog as cat
from .base import Part

part = Part()
c = F.col


@dataclass(frozen=True)
class Period:
    start: date
    end: date

    def shift(self, n: int) -> Period:
        """The period moved by its own number of whole months, or of days where it is not whole months."""
        if self.start.day == 1 and (self.end + timedelta(1)).day == 1:
            months = (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1
            return Period(add_months(self.start, n * months), add_months(self.end + timedelta(1), n * months) - timedelta(1))
        days = (self.end - self.start).days + 1
        return Period(self.start + timedelta(n * days), self.end + timedelta(n * days))

    def year_before(self) -> Period:
        return Period(add_months(self.start, -12), add_months(self.end + timedelta(1), -12) - timedelta(1) if (self.end + timedelta(1)).day == 1 else add_months(self.end, -12))


def add_months(d: date, n: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(1)).day
    return date(y, m + 1, min(d.day, last))


def build(kind: str, as_of: date, start: date | None = None, end: date | None = None) -> Period:
    """CLOSED_MONTH, MTD, QTD, YTD or CUSTOM."""
    first = as_of.replace(day=1)
    if kind == "CLOSED_MONTH":
        return Period(add_months(first, -1), first - timedelta(1))
    if kind == "MTD":
        return Period(first, as_of)
    if kind == "QTD":
        return Period(date(as_of.year, 3 * ((as_of.month - 1) // 3) + 1, 1), as_of)
    if kind == "YTD":
        return Period(date(as_of.year, 1, 1), as_of)
    if kind == "CUSTOM" and start and end and start <= end:
        return Period(start, end)
    raise ValueError(f"no such period: {kind} {start} {end}")


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir).filter("date < DATE '2001-08-01'")
    return o.groupBy(month("date").alias("month")).agg(F.sum("subtotal").alias("v"), F.sum("cost").alias("k"))


_M = "m AS (SELECT date_trunc('month', date)::DATE AS month, sum(subtotal) AS v, sum(cost) AS k FROM order_lines WHERE date < DATE '2001-08-01' GROUP BY 1)"


@part.query("SELECT CASE WHEN date IS NULL THEN 'undated' WHEN status = 'in progress' THEN 'reference' ELSE 'flow' END AS kind, date_trunc('month', date)::DATE AS month, count(*) AS n FROM order_lines GROUP BY 1, 2")
def d_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("date").isNull(), "undated").when(c("status") == "in progress", "reference").otherwise("flow")
    return cat.order_lines(spark, sf_dir).groupBy(kind.alias("kind"), month("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@part.query("""SELECT round(sum(subtotal), 2) AS total, round(sum(subtotal) FILTER (date >= DATE '2001-07-01' AND date < DATE '2001-08-01'), 2) AS last_month, round(sum(subtotal) FILTER (date >= DATE '2001-06-01' AND date < DATE '2001-07-01'), 2) AS previous_month,
round(sum(subtotal) FILTER (date >= DATE '2001-05-01' AND date < DATE '2001-08-01'), 2) AS last_3, round(sum(subtotal) FILTER (date >= DATE '2001-02-01' AND date < DATE '2001-05-01'), 2) AS previous_3 FROM order_lines""")
def d_five_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: every window is a condition of its sum."""
    closed = build("CLOSED_MONTH", date.fromisoformat(cat.ORDERS_AS_OF))
    three = Period(add_months(closed.start, -2), closed.end)
    within = lambda p: F.round(F.sum(F.when(c("date").between(F.lit(p.start), F.lit(p.end)), c("subtotal"))), 2)
    return cat.order_lines(spark, sf_dir).agg(F.round(F.sum("subtotal"), 2).alias("total"), within(closed).alias("last_month"), within(closed.shift(-1)).alias("previous_month"), within(three).alias("last_3"), within(three.shift(-1)).alias("previous_3"))


@part.query("SELECT count(*) FILTER (date BETWEEN DATE '2001-01-01' AND DATE '2001-03-31') AS flows, (SELECT count(*) FROM inventory WHERE date <= DATE '2001-03-31') AS stocks, (SELECT count(*) FROM customers) AS reference FROM order_lines")
def d_strict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows inside the period, stocks up to its end, reference rows always."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    flows = n(cat.order_lines(spark, sf_dir).filter(c("date").between("2001-01-01", "2001-03-31")), "flows")
    return flows.crossJoin(n(cat.inventory(spark, sf_dir).filter("date <= DATE '2001-03-31'"), "stocks")).crossJoin(n(cat.customers(spark, sf_dir), "reference"))


@part.query("""WITH a AS (SELECT sum(subtotal) AS v, count(DISTINCT order_id) AS n FROM order_lines WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-07-31'), b AS (SELECT sum(subtotal) AS v, count(DISTINCT order_id) AS n FROM order_lines WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-07-31')
SELECT 'revenue' AS kpi, round(a.v, 2) AS now, round(b.v, 2) AS before, floor((a.v - b.v) * 100 + 0.5) / 100 AS delta, floor((a.v - b.v) * 1000 / abs(b.v) + 0.5) / 10 AS pct FROM a, b UNION ALL SELECT 'orders', a.n, b.n, a.n - b.n, floor((a.n - b.n) * 1000.0 / b.n + 0.5) / 10 FROM a, b""")
def d_year_over_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = Period(date(2001, 1, 1), date(2001, 7, 31))
    before = now.year_before()
    o = cat.order_lines(spark, sf_dir)
    flag = lambda p: c("date").between(F.lit(p.start), F.lit(p.end))
    sums = {f"{k}_{n}": agg for n, p in (("now", now), ("before", before)) for k, agg in (("revenue", F.sum(F.when(flag(p), c("subtotal")))), ("orders", F.countDistinct(F.when(flag(p), c("order_id"))).cast("double")))}
    one = o.filter(flag(now) | flag(before)).agg(*(v.alias(k) for k, v in sums.items()))
    cells = [F.struct(F.lit(k).alias("kpi"), F.round(f"{k}_now", 2).alias("now"), F.round(f"{k}_before", 2).alias("before"), half_up(c(f"{k}_now") - c(f"{k}_before"), 2).alias("delta"), half_up((c(f"{k}_now") - c(f"{k}_before")) * 100 / F.abs(f"{k}_before"), 1).alias("pct")) for k in ("revenue", "orders")]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


@part.query(f"""WITH {_M}, r AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS i FROM m)
SELECT round(sum(v) FILTER (i <= 3), 2) AS sum_last, round(sum(v) FILTER (i BETWEEN 4 AND 6), 2) AS sum_prev, count(*) >= 6 AS has_window, round(CASE WHEN count(*) >= 6 AND sum(v) FILTER (i BETWEEN 4 AND 6) > 0 THEN (sum(v) FILTER (i <= 3) - sum(v) FILTER (i BETWEEN 4 AND 6)) * 100 / sum(v) FILTER (i BETWEEN 4 AND 6) END, 4) AS trend FROM r""")
def d_last_and_previous_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the last and the previous three months, refused unless both are covered."""
    r = _monthly(spark, sf_dir).withColumn("i", F.row_number().over(Window.orderBy(F.desc("month"))))  # one row a month
    s = r.agg(F.sum(F.when(c("i") <= 3, c("v"))).alias("a"), F.sum(F.when(c("i").between(4, 6), c("v"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return s.select(F.round("a", 2).alias("sum_last"), F.round("b", 2).alias("sum_prev"), (c("n") >= 6).alias("has_window"), F.round(F.when(c("n") >= 6, trend_pct(c("a"), c("b"))), 4).alias("trend"))


@part.query(f"WITH {_M}, l AS (SELECT month, v, lag(v) OVER (ORDER BY month) AS p FROM m), t AS (SELECT *, CASE WHEN p > 0 THEN (v - p) * 100 / p END AS pct FROM l) SELECT month, round(pct, 4) AS pct, CASE WHEN pct > 2 THEN 'up' WHEN pct < -2 THEN 'down' WHEN pct IS NOT NULL THEN 'flat' END AS direction FROM t")
def d_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = trend_pct(c("v"), F.lag("v").over(Window.orderBy("month")))
    return _monthly(spark, sf_dir).select("month", pct.alias("p")).select("month", F.round("p", 4).alias("pct"), trend_direction(c("p")).alias("direction"))


@part.query("SELECT customer_id, arg_max(order_id, (date, order_id)) AS last_order, max(date) AS last_date FROM order_lines GROUP BY 1")
def d_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.order_lines(spark, sf_dir).groupBy("customer_id").agg(F.max_by("order_id", F.struct("date", "order_id")).alias("last_order"), F.max("date").alias("last_date"))


@part.query(f"WITH {_M}, r AS (SELECT month, (v - k) * 100 / v AS pct FROM m) SELECT month, round(pct, 4) AS margin_pct, round(pct - lag(pct) OVER (ORDER BY month), 4) AS points FROM r")
def d_margin_in_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin of sums, and its change in points, not percent."""
    pct = (c("v") - c("k")) * 100 / c("v")
    r = _monthly(spark, sf_dir).select("month", pct.alias("p"))
    return r.select("month", F.round("p", 4).alias("margin_pct"), F.round(c("p") - F.lag("p").over(Window.orderBy("month")), 4).alias("points"))


@part.query("SELECT round(sum(revenue) FILTER (date >= DATE '2024-01-16') / nullif(sum(spend) FILTER (date >= DATE '2024-01-16'), 0), 4) AS roas, round(sum(revenue) FILTER (date < DATE '2024-01-16') / nullif(sum(spend) FILTER (date < DATE '2024-01-16'), 0), 4) AS roas_before FROM campaign_days")
def d_roas_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = c("date") >= "2024-01-16"
    s = lambda x, w: F.sum(F.when(w, c(x)))
    r = lambda w: F.round(s("revenue", w) / F.nullif(s("spend", w), F.lit(0.0)), 4)
    return cat.campaign_days(spark, sf_dir).agg(r(late).alias("roas"), r(~late).alias("roas_before"))


@part.query("WITH f AS (SELECT sum(cash_in - cash_out) AS net, any_value(opening_cash) + sum(cash_in - cash_out) AS cash, count(*) AS days FROM cashflow, balances) SELECT round(net, 2) AS net, round(cash, 2) AS cash, CASE WHEN cash <= 0 THEN 0.0 WHEN net >= 0 THEN NULL ELSE round(cash / (-net / days * 30.416), 4) END AS runway FROM f")
def d_burn_and_runway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that the cash lasts: 0 without cash, null (endless) without a burn."""
    f = cat.cashflow(spark, sf_dir).agg(F.sum(c("cash_in") - c("cash_out")).alias("net"), F.count(F.lit(1)).alias("days")).crossJoin(cat.balances(spark, sf_dir)).withColumn("cash", c("opening_cash") + c("net"))
    runway = F.when(c("cash") <= 0, 0.0).when(c("net") < 0, F.round(c("cash") / (-c("net") / c("days") * 30.416), 4))
    return f.select(F.round("net", 2).alias("net"), F.round("cash", 2).alias("cash"), runway.alias("runway"))


@part.query("SELECT DISTINCT product_id FROM order_lines WHERE date >= DATE '2001-05-01' AND date < DATE '2001-08-01' AND status <> 'returned'")
def d_recently_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.order_lines(spark, sf_dir).filter("date >= DATE '2001-05-01' AND date < DATE '2001-08-01' AND status <> 'returned'").select("product_id").distinct()


@part.query("""WITH d AS (SELECT DISTINCT customer_id, date FROM order_lines), g AS (SELECT customer_id, date_diff('day', lag(date) OVER (PARTITION BY customer_id ORDER BY date), date) AS gap FROM d),
l AS (SELECT customer_id, list_sort(list(gap)) AS x FROM g WHERE gap > 0 GROUP BY 1), m AS (SELECT customer_id, x[len(x) // 2 + 1] AS median FROM l)
SELECT customer_id, median, CASE WHEN median >= 350 THEN 'year' WHEN median >= 85 THEN 'quarter' WHEN median >= 27 THEN 'month' WHEN median >= 6 THEN 'week' ELSE 'day' END AS grain FROM m""")
def d_grain_by_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grain of each customer's orders by the upper median of the gaps between them."""
    d = cat.order_lines(spark, sf_dir).select("customer_id", "date").distinct()
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("customer_id").orderBy("date")))
    x = F.array_sort(F.collect_list("gap"))
    m = d.withColumn("gap", gap).filter("gap > 0").groupBy("customer_id").agg(F.element_at(x, (F.floor(F.size(x) / 2) + 1).cast("int")).alias("median"))
    v = c("median")
    return m.select("customer_id", v, F.when(v >= 350, "year").when(v >= 85, "quarter").when(v >= 27, "month").when(v >= 6, "week").otherwise("day").alias("grain"))


def _fit(m: DataFrame) -> DataFrame:
    """Least squares of v on x, with n, mean, spread and standard error, in one aggregate."""
    s = m.agg(F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("intercept"), F.regr_r2("v", "x").alias("r2"), F.regr_avgx("v", "x").alias("mx"), F.regr_sxx("v", "x").alias("sxx"), F.regr_syy("v", "x").alias("syy"), F.regr_sxy("v", "x").alias("sxy"), F.count("v").alias("n"), F.max("x").alias("last"))
    return s.withColumn("se", F.sqrt((c("syy") - c("sxy") * c("sxy") / c("sxx")) / (c("n") - 2)))


_XY = f"{_M}, xy AS (SELECT CAST(date_diff('month', DATE '1995-01-01', month) AS DOUBLE) AS x, v FROM m), s AS (SELECT regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, regr_r2(v, x) AS r2, regr_avgx(v, x) AS mx, regr_sxx(v, x) AS sxx, sqrt((regr_syy(v, x) - regr_sxy(v, x) * regr_sxy(v, x) / regr_sxx(v, x)) / (count(*) - 2)) AS se, count(*) AS n, max(x) AS last FROM xy)"


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).select(F.months_between("month", F.lit(date(1995, 1, 1))).alias("x"), "v")


@part.query(f"WITH {_XY} SELECT round(slope, 3) AS slope, round(intercept, 2) AS intercept, round(se, 2) AS stderr, round(r2, 6) AS r2 FROM s")
def d_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(_xy(spark, sf_dir)).select(F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("se", 2).alias("stderr"), F.round("r2", 6).alias("r2"))


@part.query(f"WITH {_XY} SELECT h AS ahead, round(intercept + slope * (last + h), 2) AS forecast, round(se * sqrt(1 + 1.0 / n + (last + h - mx) * (last + h - mx) / sxx), 2) AS band FROM s, range(1, 4) AS t(h) WHERE n >= 3")
def d_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three months with the width of the prediction interval's standard deviation."""
    s = _fit(_xy(spark, sf_dir)).filter("n >= 3").withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(3))))
    x = c("last") + c("ahead")
    return s.select(c("ahead").cast("long").alias("ahead"), F.round(c("intercept") + c("slope") * x, 2).alias("forecast"), F.round(c("se") * F.sqrt(1 + 1.0 / c("n") + (x - c("mx")) * (x - c("mx")) / c("sxx")), 2).alias("band"))


@part.query(f"WITH {_M}, g AS (SELECT month, v, v / lag(v) OVER (ORDER BY month) - 1 AS g FROM m) SELECT round(arg_max(v, month) * (1 + avg(g)), 2) AS projection, round(stddev_samp(v), 2) AS band FROM g")
def d_naive_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _monthly(spark, sf_dir).withColumn("g", c("v") / F.lag("v").over(Window.orderBy("month")) - 1)
    return g.agg(F.round(F.max_by("v", "month") * (1 + F.avg("g")), 2).alias("projection"), F.round(F.stddev_samp("v"), 2).alias("band"))


@part.query("""WITH a AS (SELECT max(date) AS d FROM order_lines WHERE date <= DATE '2001-08-15')
SELECT (SELECT d FROM a) AS last_active_day, round(sum(subtotal) FILTER (date = d), 2) AS day_revenue, round(sum(subtotal) FILTER (date > d - 7 AND date <= d), 2) AS week_revenue, round(sum(subtotal) FILTER (date >= DATE '2001-07-01' AND date <= DATE '2001-07-31'), 2) AS month_revenue FROM order_lines, a""")
def d_report_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir)
    last = o.filter(c("date") <= cat.ORDERS_AS_OF).agg(F.max("date").alias("d"))
    s = lambda w: F.round(F.sum(F.when(w, c("subtotal"))), 2)
    x = o.crossJoin(F.broadcast(last)).agg(F.first("d").alias("last_active_day"), s(c("date") == c("d")).alias("day_revenue"), s((c("date") > F.date_sub("d", 7)) & (c("date") <= c("d"))).alias("week_revenue"), s(c("date").between("2001-07-01", "2001-07-31")).alias("month_revenue"))
    return x


@part.query("""WITH r AS (SELECT 'orders' AS src, min(date) AS a, max(date) AS b FROM order_lines UNION ALL SELECT 'payroll', min(period), max(period) FROM payroll), c AS (SELECT date_trunc('month', max(a))::DATE AS a, date_trunc('month', min(b))::DATE AS b FROM r)
SELECT a AS first_month, b AS last_month, a > b AS is_empty, round((SELECT sum(subtotal) FROM order_lines WHERE date_trunc('month', date) BETWEEN a AND b), 2) AS revenue FROM c""")
def d_common_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are compared on the months that all of them cover."""
    o, p = cat.order_lines(spark, sf_dir), cat.payroll(spark, sf_dir)
    ends = o.agg(F.min("date").alias("a"), F.max("date").alias("b")).unionAll(p.agg(F.min("period"), F.max("period")))
    common = ends.agg(month(F.max("a")).alias("first_month"), month(F.min("b")).alias("last_month"))
    both = common.crossJoin(o.groupBy(month("date").alias("m")).agg(F.sum("subtotal").alias("v")))
    return both.groupBy("first_month", "last_month").agg((F.first("first_month") > F.first("last_month")).alias("is_empty"), F.round(F.sum(F.when(c("m").between(c("first_month"), c("last_month")), c("v"))), 2).alias("revenue"))


@part.query("WITH b AS (SELECT date, (SELECT opening_cash FROM balances) + sum(cash_in - cash_out) OVER (ORDER BY date) AS v FROM cashflow) SELECT max(date) AS date, round(arg_max(v, date), 2) AS balance FROM b")
def d_latest_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing balance of the last day on the statement."""
    f = cat.cashflow(spark, sf_dir).crossJoin(cat.balances(spark, sf_dir))
    b = f.select("date", (c("opening_cash") + F.sum(c("cash_in") - c("cash_out")).over(Window.orderBy("date"))).alias("v"))  # one row a day
    return b.agg(F.max("date").alias("date"), F.round(F.max_by("v", "date"), 2).alias("balance"))


@part.query(f"WITH {_M}, r AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS i FROM m) SELECT round(max(v) FILTER (i = 1), 2) AS last_value, round(max(v) FILTER (i = 2), 2) AS previous_value FROM r")
def d_last_and_previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last complete month and the one before."""
    r = _monthly(spark, sf_dir).withColumn("i", F.row_number().over(Window.orderBy(F.desc("month"))))  # one row a month
    return r.agg(F.round(F.max(F.when(c("i") == 1, c("v"))), 2).alias("last_value"), F.round(F.max(F.when(c("i") == 2, c("v"))), 2).alias("previous_value"))
