"""The import of a table's rows: read, derived, judged. Every row gets exactly one status, and the counters add up.

Raw rows are texts with a unique row_no. Conventions of dates and numbers are proven column by column in one pass over
the table; all else is one projection, the deduplication engine, and no row is lost on the way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from .dedup_engine import deduplicate
from .derive import DERIVE, fallback_id

c = F.col

STATUSES = ("IMPORTED", "POTENTIAL_DUPLICATE", "DUPLICATE", "CONFLICT", "QUARANTINED", "SUMMARY_ROW")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"  # string, number, date, boolean, enum
    required: bool = False
    values: tuple[str, ...] = ()
    translations: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Entity:
    """fallback: the id column and the columns that name a row without one."""

    name: str
    fields: tuple[Field, ...]
    fallback: tuple[str, ...] = ()


def conventions(raw: DataFrame, entity: Entity) -> DataFrame:
    """One row with the proven convention of every date and number column."""
    cells = [P.date_convention(c(f.name)).alias(f"__c_{f.name}") if f.kind == "date" else P.number_convention(c(f.name)).alias(f"__c_{f.name}") for f in entity.fields if f.kind in ("date", "number") and f.name in raw.columns]
    return raw.agg(*cells) if cells else raw.sparkSession.range(1).drop("id")


def typed(f: Field) -> Column:
    """A cell by its field's kind."""
    x = c(f"`{f.name}`")
    if f.kind == "date":
        return F.when(c(f"__c_{f.name}") == "MDY", P.parse_date(x, "MDY")).otherwise(P.parse_date(x))
    if f.kind == "number":
        return P.parse_number_by(x, c(f"__c_{f.name}"))
    if f.kind == "enum":
        return P.coerce_enum(x, f.translations, list(f.values), by_word=True)
    return P.coerce(x, f.kind)


def reason(entity: Entity) -> Column:
    """The first required field that is missing, or that is there and cannot be read."""
    out = F.lit(None).cast("string")
    for f in reversed([f for f in entity.fields if f.required]):
        blank = P.blank_to_null(c(f"__raw.`{f.name}`")).isNull()
        kind = {"date": "DATE", "number": "NUMBER", "enum": "ENUM"}.get(f.kind, "VALUE")
        out = F.when(c(f"`{f.name}`").isNull() & blank, f"MISSING_{kind}:{f.name}").when(c(f"`{f.name}`").isNull(), f"INVALID_{kind}:{f.name}").otherwise(out)
    return out


def normalise(raw: DataFrame, entity: Entity) -> DataFrame:
    """row_no, the typed and derived columns, reason, is_summary; the raw row stays in original_data."""
    known = [f for f in entity.fields if f.name in raw.columns]
    names = [n for n in raw.columns if n != "row_no"]
    filled = [P.blank_to_null(c(f"`{n}`")) for n in names]
    blanks = sum((x.isNull().cast("int") for x in filled), F.lit(0))
    summary = P.is_summary_row(F.coalesce(*filled), blanks, F.lit(len(names)))
    # one projection reads the cells, a second one names them: derived columns never read a cell twice. Rows are dealt out
    # first, for a file may come as one block, and reading cells and telling contents apart cost far more than their texts
    both = raw.repartition("row_no").crossJoin(F.broadcast(conventions(raw, entity)))
    both = both.select("row_no", F.struct(*(c(f"`{n}`") for n in names)).alias("__raw"), summary.alias("is_summary"), *(typed(f).alias(f.name) for f in known), *(F.lit(None).cast({"number": "double", "date": "date", "boolean": "boolean"}.get(f.kind, "string")).alias(f.name) for f in entity.fields if f not in known))
    data = [f.name for f in entity.fields]
    both = both.withColumn("original_data", F.to_json("__raw"))
    if entity.fallback:
        key, *parts = entity.fallback
        both = both.withColumn(key, F.coalesce(c(key), fallback_id([c(p) for p in parts])))
    judged = both.withColumn("reason", reason_of(entity, raw)).drop("__raw")
    derive = DERIVE.get(entity.name)
    if derive is None:
        return judged
    apart = judged.select("row_no", "is_summary", "reason", "original_data", *data)
    return derive(apart)


def reason_of(entity: Entity, raw: DataFrame) -> Column:
    known = Entity(entity.name, tuple(f for f in entity.fields if f.name in raw.columns))
    missing = [f for f in entity.fields if f.required and f.name not in raw.columns and f.name not in entity.fallback[:1]]
    return F.lit(f"MISSING_COLUMN:{missing[0].name}") if missing else reason(known)


def import_rows(raw: DataFrame, entity: Entity, stored: DataFrame | None = None) -> DataFrame:
    """Every raw row once, with its status and reason; rows to keep are IMPORTED or POTENTIAL_DUPLICATE."""
    rows = normalise(raw, entity).persist()  # read once, judged twice
    out = F.when(c("is_summary"), "SUMMARY_ROW").when(c("reason").isNotNull(), "QUARANTINED")
    apart = rows.filter(out.isNotNull()).withColumn("status", out)
    data = rows.filter(out.isNull()).drop("is_summary", "reason")
    told = deduplicate(data, entity.name, stored)
    status = F.when(c("status") == "new", "IMPORTED").otherwise(F.upper("status"))
    told = told.withColumn("status", status).withColumn("reason", F.when(c("status").isin("DUPLICATE", "CONFLICT"), c("status"))).withColumn("is_summary", F.lit(False))
    return told.unionByName(apart)


def counters(judged: DataFrame) -> DataFrame:
    """How many rows each status has; the sum is the number of raw rows."""
    return judged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def reprocess(quarantine: DataFrame, entity: Entity, stored: DataFrame | None = None) -> DataFrame:
    """Rows in quarantine, from the raw texts kept with them, through the import again."""
    schema = ", ".join(f"`{f.name}` string" for f in entity.fields)
    raw = quarantine.select("row_no", F.from_json("original_data", schema).alias("r")).select("row_no", "r.*").persist()  # read twice, for conventions and for rows
    return import_rows(raw, entity, stored)
