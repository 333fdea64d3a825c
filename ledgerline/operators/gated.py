"""A0: the generic aggregator with its gate and its fallback.

A measure that some entity declares is aggregated over that entity, and only if the field that is read is of sufficient
quality; its observations, which were derived from the same rows, are never added or put in its place. A measure that
no entity declares comes from observations over a trust, else it is unknown. The choice is made in the plan: declared
is what a frame's columns say; quality, values and trust are columns of one-row frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import FLOW, STOCK, STOCK_KEYS, Measure, check, combine
from .quality import FieldRule, field_quality

c = F.col

# Name spaces that an observation's concept may stand in, and what is no revenue of the company.
SPACES = ("", "finance.", "customer.", "marketing.")
CAMPAIGNS = ("Campaign", "CampaignDaily", "campaign", "campaign_daily")
LEAST_TRUST = 0.6


def _of(m: Measure, df: DataFrame, as_of: str) -> DataFrame:
    """One row: value of the first field with any value, its quality and how many rows it rests on."""
    check(m)
    fields = [f for f in m.fields if f in df.columns]
    rules = [FieldRule(f, amount=m.role in (FLOW, STOCK), identifier=m.how == "count_distinct") for f in fields]
    quality = field_quality(df, rules, as_of, "date" if "date" in df.columns else None)
    quality = quality.agg(*(F.max(F.when(c("field") == f, c("score"))).alias(f"q{i}") for i, f in enumerate(fields)))
    counted = df
    if m.role == STOCK and m.entity in STOCK_KEYS:
        counted = df.groupBy(*STOCK_KEYS[m.entity]).agg(*(F.max_by(f, "date").alias(f) for f in fields))
        values = [F.sum(f).cast("double") for f in fields]
    else:
        values = [combine(m, f) for f in fields]
    row = counted.agg(*(v.alias(f"v{i}") for i, v in enumerate(values)), *(F.count(f).alias(f"n{i}") for i, f in enumerate(fields))).crossJoin(F.broadcast(quality))  # rows of one
    first = lambda k: F.coalesce(*(F.when(c(f"n{i}") > 0, c(f"{k}{i}")) for i in range(len(fields))))
    field = F.coalesce(*(F.when(c(f"n{i}") > 0, F.lit(f)) for i, f in enumerate(fields)), F.lit(fields[0]))
    return row.select(first("v").alias("v"), first("q").alias("quality"), first("n").alias("n"), field.alias("field"))


def _observed(key: str, observations: DataFrame | None, spark) -> DataFrame:
    """One row: the sum of the trusted observations, how many there are and how many of them are trusted."""
    if observations is None:
        return spark.range(1).select(F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_trusted"))
    own = observations.filter(c("concept").isin(*(s + key for s in SPACES)))
    if key == "revenue":
        near = [c(k).isin(*CAMPAIGNS) for k in ("entity", "grain") if k in observations.columns]
        for x in [c("concept").startswith("marketing."), *near]:
            own = own.filter(~F.coalesce(x, F.lit(False)))
    trusted = F.coalesce(c("confidence") >= LEAST_TRUST, F.lit(False))
    return own.agg(F.sum(F.when(trusted, F.coalesce(c("value"), F.lit(0.0)))).alias("v"), F.count(F.lit(1)).alias("n"), F.count_if(trusted).alias("n_trusted"))


def gated_aggregate(m: Measure, frames: dict[str, DataFrame], as_of: str, observations: DataFrame | None = None, spark=None) -> DataFrame:
    """One row: key, value, status, source (the field, 'observations' or null), quality, reason.

    reason: null, or why there is no value: 'no source', 'no value', 'quality', 'trust'.
    """
    df = frames.get(m.entity)
    if df is not None and any(f in df.columns for f in m.fields):
        one = _of(m, df, as_of)
        good = F.coalesce(c("quality") >= 60, F.lit(False))
        why: Column = F.when(c("n").isNull(), "no value").when(~good, "quality")
        row = one.select(F.when(why.isNull(), c("v")).alias("value"), F.concat(F.lit(f"{m.entity}."), "field").alias("source"), c("quality"), why.alias("reason"))
    else:
        spark = spark or next(iter(frames.values())).sparkSession
        one = _observed(m.key, observations, spark)
        why = F.when(c("n") == 0, "no source").when(c("n_trusted") == 0, "trust")
        row = one.select(F.when(why.isNull(), c("v")).alias("value"), F.when(c("n") > 0, "observations").alias("source"), F.lit(None).cast("double").alias("quality"), why.alias("reason"))
    status = F.when(c("value").isNull(), "NOT_MEASURED").when(c("value") == 0, "VALID_ZERO").otherwise("VALID")
    return row.select(F.lit(m.key).alias("key"), "value", status.alias("status"), "source", "quality", "reason")
