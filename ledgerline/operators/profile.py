"""What a table's columns hold: profiles, compatibility, dimensions, keys, formulas and foreign keys.

Each operator is one aggregate over all columns of a frame, whatever they are; cells are looked at as text. Distinct counts
are exact: the cells are unpivoted and grouped, so that no column's values come together in one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import parsing as P

c = F.col


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, value: one row a cell, as text; blanks are null."""
    names = columns or df.columns
    texts = df.select(*(P.blank_to_null(c(f"`{n}`").cast("string")).alias(n) for n in names))
    return texts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c(f"`{n}`").alias("value")) for n in names))).alias("x")).select("x.*")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Name, n, nulls, n_distinct, uniqueness, least, greatest, mean, n_numbers, n_dates, logical_type,
    is_dimension.

    The logical type is the first of integer, number, date and text that nine in ten filled cells fit, or category where it
    is a dimension: at least eight in ten cells text, 1 to 50 distinct values, some repeated.
    """
    number = P.parse_number(c("value"))
    plain = c("value").rlike(r"^[-+(]?[$€£]?\s*[0-9][0-9 .,' ]*\)?\s*[%$€£]?$")
    kinds = cells(df, columns).groupBy("name", "value").agg(F.count(F.lit(1)).alias("k"))
    kinds = kinds.withColumns({"number": F.when(plain, number), "date": P.parse_date(c("value"))})
    filled = c("value").isNotNull()
    count = lambda x: F.coalesce(F.sum(F.when(x, c("k"))), F.lit(0))
    g = kinds.groupBy("name").agg(
        F.sum("k").alias("n"), count(~filled).alias("nulls"), F.count("value").alias("n_distinct"), F.min("value").alias("least"), F.max("value").alias("greatest"), (F.sum(c("number") * c("k")) / F.sum(F.when(c("number").isNotNull(), c("k")))).alias("mean"),
        count(c("number").isNotNull()).alias("n_numbers"), count(c("number") == F.floor("number")).alias("n_integers"), count(c("date").isNotNull() & ~plain).alias("n_dates"), count(filled & c("number").isNull() & c("date").isNull()).alias("n_texts"),
    )
    full = c("n") - c("nulls")
    dimension = (c("n_texts") >= 0.8 * full) & c("n_distinct").between(1, 50) & (c("n_distinct") < full)
    kind = F.when(full == 0, "empty").when(c("n_integers") >= 0.9 * full, "integer").when(c("n_numbers") >= 0.9 * full, "number").when(c("n_dates") >= 0.9 * full, "date").when(dimension, "category").otherwise("text")
    return g.select("name", "n", "nulls", "n_distinct", F.round(c("n_distinct") / F.nullif(full, F.lit(0)), 6).alias("uniqueness"), "least", "greatest", F.round("mean", 4).alias("mean"), "n_numbers", "n_dates", kind.alias("logical_type"), F.coalesce(dimension, F.lit(False)).alias("is_dimension"))


def compatibility(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Name, ratio: the share of filled cells that can be read as the kind each column is meant to have."""
    rows = [F.struct(F.lit(n).alias("name"), (F.count_if(P.blank_to_null(c(f"`{n}`").cast("string")).isNotNull() & P.coerce(c(f"`{n}`").cast("string"), k).isNotNull()) / F.nullif(F.count_if(P.blank_to_null(c(f"`{n}`").cast("string")).isNotNull()), F.lit(0))).alias("ratio")) for n, k in kinds.items()]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.name", F.round("x.ratio", 6).alias("ratio"))


def key_candidates(df: DataFrame, columns: list[str], pairs: bool = True) -> DataFrame:
    """Columns and pairs of columns with their share of distinct values, and whether they are a key (no two rows alike,
    none blank).

    Each set of columns is grouped by its own values, apart from the others: short rows, and one set's groups in a task's
    memory at a time. The frame is read once a set."""
    sets = [(n,) for n in columns] + (list(combinations(columns, 2)) if pairs else [])

    def one(s: tuple[str, ...]) -> DataFrame:
        keys = [c(f"`{n}`") if isinstance(df.schema[n].dataType, IntegralType) else c(f"`{n}`").cast("string").alias(n) for n in s]
        g = df.select(*keys).groupBy(*(f"`{n}`" for n in s)).agg(F.count(F.lit(1)).alias("__k"))
        g = g.agg(F.count_if(_filled(s)).alias("n_distinct"), F.coalesce(F.sum("__k"), F.lit(0)).alias("n")).filter("n > 0")
        return g.select(F.lit("+".join(s)).alias("name"), F.round(c("n_distinct") / c("n"), 6).alias("uniqueness"), (c("n_distinct") == c("n")).alias("is_key"))

    return reduce(DataFrame.unionAll, map(one, sets))


def _filled(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & c(f"`{n}`").isNotNull()
    return out


#: Name, result, terms, optional terms (0 where missing), formula; pct: the result may be written in percent.
FORMULAS = [
    ("quantity_price_revenue", "total_revenue", ("quantity", "unit_price"), ("discount",), "quantity * unit_price - discount", False),
    ("quantity_price_total", "total", ("quantity", "unit_price"), ("discount",), "quantity * unit_price - discount", False),
    ("quantity_price_subtotal", "subtotal", ("quantity", "unit_price"), ("discount",), "quantity * unit_price - discount", False),
    ("quantity_cost_total", "total_cost", ("quantity", "unit_cost"), (), "quantity * unit_cost", False),
    ("gross_profit", "gross_profit", ("total_revenue", "total_cost"), (), "total_revenue - total_cost", False),
    ("gross_margin", "gross_margin", ("gross_profit", "total_revenue"), (), "gross_profit / nullif(total_revenue, 0)", True),
    ("total_with_taxes", "total", ("subtotal", "tax"), ("shipping", "discount"), "subtotal + tax + shipping - discount", False),
    ("stock", "closing_stock", ("opening_stock",), ("purchases", "returns", "units_sold", "losses"), "opening_stock + purchases + returns - units_sold - losses", False),
    ("stock_value", "inventory_value", ("closing_stock", "unit_cost"), (), "closing_stock * unit_cost", False),
    ("net_flow", "net_cash_flow", ("cash_in", "cash_out"), (), "cash_in - cash_out", False),
    ("treasury", "closing_cash", ("opening_cash", "net_cash_flow"), (), "opening_cash + net_cash_flow", False),
    ("roas", "roas", ("revenue", "spend"), (), "revenue / nullif(spend, 0)", False),
    ("cac", "cac", ("spend", "conversions"), (), "spend / nullif(conversions, 0)", False),
]


def column_relations(df: DataFrame, least_rate: float = 0.9) -> DataFrame:
    """relation, n (rows where it can be tested), n_holds, rate, holds: formulas between the frame's columns, within 0.011
    or one percent. A relation holds from two rows and a rate of `least_rate`. With a tax column, total is with taxes."""
    have = set(df.columns)
    taxed = bool(have & {"tax", "tax_federal", "tax_provincial"})
    out = []
    for name, result, terms, optional, formula, pct in FORMULAS:
        if not have >= {result, *terms} or name == "quantity_price_total" and taxed:
            continue
        values = [c(result).cast("double").alias("__r"), *(c(t).cast("double").alias(t) for t in terms), *((F.coalesce(c(o).cast("double"), F.lit(0.0)) if o in have else F.lit(0.0)).alias(o) for o in optional)]
        x = df.select(*values).withColumn("__e", F.when(_filled(terms), F.expr(formula))).filter("__r IS NOT NULL AND __e IS NOT NULL")
        near = lambda e: F.abs(e - c("__r")) <= F.greatest(F.lit(0.011), F.abs(e) * 0.01)
        ok = near(c("__e")) | near(c("__e") * 100) if pct else near(c("__e"))
        one = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_holds"))
        out.append(one.select(F.lit(name).alias("relation"), "n", "n_holds", F.round(c("n_holds") / F.nullif("n", F.lit(0)), 6).alias("rate"), ((c("n") >= 2) & (c("n_holds") >= least_rate * c("n"))).alias("holds")))
    result = out[0]
    for o in out[1:]:
        result = result.unionAll(o)
    return result


def foreign_keys(tables: dict[str, tuple[DataFrame, list[str]]], keys: dict[str, tuple[DataFrame, str]], least: float = 0.8) -> DataFrame:
    """From, to, n_distinct, overlap, linked: every column of `tables` against every key, by the share of its distinct
    values that the key has; a link needs two values and `least`. Both sides are sets of (name, value), joined by value."""
    told = None
    for name, (df, columns) in tables.items():
        one = cells(df, columns).filter("value IS NOT NULL").select(F.concat(F.lit(f"{name}."), c("name")).alias("from"), F.lower("value").alias("value")).distinct()
        told = one if told is None else told.unionAll(one)
    known = None
    for name, (df, column) in keys.items():
        one = df.select(F.lit(f"{name}.{column}").alias("to"), F.lower(F.trim(c(column).cast("string"))).alias("value")).filter("value IS NOT NULL").distinct()
        known = one if known is None else known.unionAll(one)
    hits = told.join(known, "value").groupBy("from", "to").agg(F.count(F.lit(1)).alias("found"))
    sizes = told.groupBy("from").agg(F.count(F.lit(1)).alias("n_distinct"))
    every = sizes.crossJoin(known.select("to").distinct())  # names of columns and of keys
    out = every.join(hits, ["from", "to"], "left").withColumn("found", F.coalesce("found", F.lit(0))).filter(F.split("from", r"\.")[0] != F.split("to", r"\.")[0])
    return out.select("from", "to", "n_distinct", F.round(c("found") / c("n_distinct"), 6).alias("overlap"), ((c("n_distinct") >= 2) & (c("found") >= least * c("n_distinct"))).alias("linked"))
