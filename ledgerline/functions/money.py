"""Currency normalisation and ex-tax amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import strip_accents

#: Reference currency and rates to it; a currency without a rate takes its rows out and makes results partial.
REFERENCE = "CAD"
RATES = {"CAD": 1.0, "USD": 1.35}


def rate(currency: Column, rates: dict[str, float] | None = None) -> Column:
    """Rate of a row's currency, null where there is none; no currency is the reference's."""
    rates = RATES if rates is None else rates
    table = F.create_map(*(F.lit(x) for kv in rates.items() for x in kv))
    return table[F.coalesce(F.upper(F.trim(currency)), F.lit(REFERENCE))]


def ex_tax(total_revenue: Column, subtotal: Column, total: Column, tax: Column, discount: Column, quantity: Column, unit_price: Column) -> Column:
    """total_revenue; else the subtotal, less the discount only where the row proves that it is gross; else total less tax.

    A discount under 1 is a rate. A subtotal is gross where it equals quantity x unit price, or where subtotal less
    discount plus tax is the total, within 0.05.
    """
    off = F.when(discount.isNull(), F.lit(0.0)).when(F.abs(discount) < 1, subtotal * discount).otherwise(discount)
    near = lambda a, b: F.coalesce(F.abs(a - b) <= 0.05, F.lit(False))
    gross = near(subtotal - off + F.coalesce(tax, F.lit(0.0)), total) | (near(subtotal, quantity * unit_price) & ~near(subtotal + F.coalesce(tax, F.lit(0.0)), total))
    return F.coalesce(total_revenue, F.when(gross & (off != 0), subtotal - off).otherwise(subtotal), total - F.coalesce(tax, F.lit(0.0)))


def depreciation_rate(r: Column) -> Column:
    """Over 1 it is a percentage; negative is none."""
    return F.when(r > 1, r / 100).when(r >= 0, r)


# Currency codes, and the currency of a country.
CODES = "CAD USD EUR GBP AUD CHF JPY MXN NZD INR CNY BRL MAD XOF TND DZD".split()
COUNTRIES = {
    "CAD": ["canada"],
    "USD": ["united states", "usa", "us", "etats unis", "america"],
    "GBP": ["united kingdom", "uk", "royaume uni", "england", "great britain"],
    "EUR": ["france", "germany", "allemagne", "spain", "espagne", "italy", "italie", "belgium", "belgique", "netherlands", "pays bas", "ireland", "irlande", "portugal", "austria", "autriche", "luxembourg", "finland", "finlande"],
    "AUD": ["australia", "australie"], "CHF": ["switzerland", "suisse"], "JPY": ["japan", "japon"], "MXN": ["mexico", "mexique"], "NZD": ["new zealand", "nouvelle zelande"], "INR": ["india", "inde"], "CNY": ["china", "chine"],
    "BRL": ["brazil", "bresil"], "MAD": ["morocco", "maroc"], "XOF": ["senegal", "cote d ivoire", "burkina faso", "mali"], "TND": ["tunisia", "tunisie"], "DZD": ["algeria", "algerie"],
}
# An order's columns of money.
MONEY_COLUMNS = ["subtotal", "total", "tax", "tax_federal", "tax_provincial", "total_revenue", "total_cost", "cost", "unit_price", "unit_cost", "gross_profit", "discount", "shipping"]


def currency_code(x: Column) -> Column:
    """The code that a currency cell means, or null."""
    t = F.upper(F.trim(strip_accents(x)))
    return F.when(t.isin(*CODES), t).when(t.rlike("^(€|EUROS?)$"), "EUR").when(t.rlike("^(£|(LIVRES?|POUNDS?)( STERLING)?)$"), "GBP").when(t.rlike(r"^((DOLLARS? )?(CANADIENS?|CANADIAN)|CA\$|C\$)$"), "CAD").when(t.rlike(r"^((DOLLARS? )?(US|AMERICAINS?|AMERICAN)|US\$)$"), "USD")


def currency_of_country(x: Column) -> Column:
    """The currency of a country, or null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(x)), "[^a-z ]+", " "), " +", " "))
    table = F.create_map(*(F.lit(v) for code, names in COUNTRIES.items() for name in names for v in (name, code)))
    return table[t]


def row_currency(currency: Column, store_country: Column) -> Column:
    """The row's currency, else that of the country of the point of sale; the customer's country says nothing."""
    return F.coalesce(currency_code(currency), currency_of_country(store_country))


def normalise_currencies(orders: DataFrame, company: str | None = None, rates: dict[str, float] | None = None) -> DataFrame:
    """Every money column in one reference currency, with `reference`, `origin` (where converted) and `left_out`.

    The reference is the company's currency if sales are in it, else the most frequent one, the first in alphabetical
    order at a tie. A row in another currency is converted by the rate to the reference; without one it is left out.
    Rows without a currency are in the reference. Rates are units of the company's books for one unit.
    """
    if "reference" in orders.columns:
        return orders  # done already
    rates = RATES if rates is None else rates
    counts = orders.filter("currency IS NOT NULL").groupBy("currency").agg(F.count(F.lit(1)).alias("n"))  # one row a currency
    own = F.lit(company)
    reference = counts.agg(F.coalesce(F.max(F.when(F.col("currency") == own, own)), F.min_by("currency", F.struct(-F.col("n"), "currency"))).alias("reference"))
    table = F.create_map(*(F.lit(v) for kv in rates.items() for v in kv))
    both = orders.crossJoin(F.broadcast(reference))  # one row
    other = F.col("currency").isNotNull() & (F.col("currency") != F.col("reference"))
    r = F.when(~other | F.col("currency").isNull(), F.lit(1.0)).otherwise(table[F.col("currency")] / F.coalesce(table[F.col("reference")], F.lit(1.0)))
    both = both.withColumn("__rate", r).withColumn("left_out", F.col("__rate").isNull()).withColumn("origin", F.when(other & F.col("__rate").isNotNull(), F.col("currency")))
    money = {k: F.when(F.col("left_out"), F.col(k)).otherwise(F.col(k) * F.col("__rate")) for k in MONEY_COLUMNS if k in orders.columns}
    return both.withColumns(money).withColumn("currency", F.when(F.col("left_out"), F.col("currency")).otherwise(F.col("reference"))).drop("__rate")


def product_margin_pct(margin: Column, cost: Column, price: Column) -> Column:
    """T5: a product's margin in percent, whether its column holds a ratio, a percentage or an amount of money.

    With price and cost: a ratio (within -1 and 1) times 100; over 100, or within 1 of price less cost, it is money and the
    rate is worked out; else it is a percentage; none or 0 gives the rate. Without: a ratio times 100, else as it is.
    """
    known = F.coalesce((price > 0) & (cost > 0), F.lit(False))
    rate_pct = (price - cost) * 100 / price
    said = margin.isNotNull() & ~F.isnan(margin) & (margin != 0)
    ratio = margin.between(-1, 1)
    return (
        F.when(known & said & ratio, margin * 100).when(known & said & ((margin > 100) | (F.abs(margin - (price - cost)) < 1)), rate_pct).when(known & said, margin).when(known, rate_pct)
        .when(said & ratio, margin * 100).otherwise(margin)
    )


# What a header says when its amounts hold the taxes.
TAX_INCLUDED = r"ttc|tax(es)?[\s_-]*incl|incl[\s_-]*tax"


def revenue_base(orders: DataFrame) -> DataFrame:
    """T8, one row: base, n. HT where any row has a subtotal or a tax, TTC where the raw rows (original_data, JSON) have a
    header that says so, else null: nothing tells."""
    given = [F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in ("subtotal", "tax") if k in orders.columns]
    net = F.count(F.coalesce(*given)) > 0 if given else F.lit(False)
    keys = F.array_join(F.json_object_keys("original_data"), "|") if "original_data" in orders.columns else F.lit("")
    gross = F.coalesce(F.max(F.lower(keys).rlike(TAX_INCLUDED)), F.lit(False))
    return orders.agg(F.when(net, "HT").when(gross, "TTC").alias("base"), F.count(F.lit(1)).alias("n"))
