"""A read plan, as data, applied to a table of texts.

A plan says for every header which field it is, how its dates are written and which house codes mean what. Applying it
is one aggregate (the conventions that whole columns prove, two words a column, which the driver reads, so that only
columns with dates or decimals are parsed), a join for each column with codes, and one projection.
Rows that the reading sets aside, ignored ones and totals, go to a journal with their reason; all others keep their
raw texts. What cannot be read stays as it was: the import judges it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P

c = F.col


@dataclass(frozen=True)
class PlanColumn:
    """source: the header. field: what it is; None where it matches nothing. date: DMY or MDY where the plan says so.
    coded: its cells are codes, which the plan's code table translates. excluded: set aside whatever the plan's origin."""

    source: str
    field: str | None = None
    date: str | None = None
    coded: bool = False
    excluded: bool = False


@dataclass(frozen=True)
class Plan:
    """by_rules: columns without a field were not looked at, so they keep their headers; else they match nothing and go."""

    columns: tuple[PlanColumn, ...]
    by_rules: bool = False

    def column(self, header: str) -> PlanColumn | None:
        return next((p for p in self.columns if p.source == header.strip()), None)

    def kept(self, header: str) -> str | None:
        """The name under which a column goes on, or None."""
        p = self.column(header)
        if p is not None and p.field:
            return p.field
        return header if p is None or self.by_rules and not p.excluded else None


def signature(headers: list[str], sheet: str = "") -> Column:
    """Names a kind of file by its headers, whatever their order, case, accents and outer blanks: a plan made for one fits all."""
    keys = F.array_sort(F.transform(F.array(*map(F.lit, headers)), lambda h: P.strip_accents(F.lower(F.trim(h)))))
    return F.sha2(F.concat_ws("|", F.lower(F.trim(F.lit(sheet))), F.array_join(keys, "|")), 256)


def _is_total(cells: list[Column]) -> Column:
    filled = [P.blank_to_null(x) for x in cells]
    return P.is_summary_row(F.coalesce(*filled), sum((x.isNull().cast("int") for x in filled), F.lit(0)), F.lit(len(cells)))


def _read(x: Column, date: str | None, number: str | None) -> Column:
    """A cell by its column's conventions; as it was where it cannot be read by them."""
    out = x if number is None else F.coalesce(P.parse_number_by(x, F.lit(number)).cast("string"), x)
    if date is None:
        return out
    short = F.trim(x).rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}")
    read = P.parse_date(x, "MDY") if date == "MDY" else P.parse_date(x)
    return F.when(F.coalesce(short, F.lit(False)), F.coalesce(read.cast("string"), x)).otherwise(out)


def apply_plan(raw: DataFrame, plan: Plan, codes: DataFrame | None = None, ignored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, journal). raw: texts and a unique row_no. codes: column, code, value. ignored: row_no of rows to set aside.

    rows: row_no, the fields, and original_data (the raw row as JSON). journal: row_no, reason ('total' or 'ignored'),
    preview. Blank rows are neither. Of two columns of one field the later one counts.
    """
    headers = [n for n in raw.columns if n != "row_no"]
    cells = [c(f"`{h}`") for h in headers]
    out = raw.withColumn("__raw", F.struct(*cells))
    if ignored is not None:
        out = out.join(ignored.select("row_no").distinct().withColumn("__ignored", F.lit(True)), "row_no", "left")
    skipped = F.coalesce(c("__ignored"), F.lit(False)) if ignored is not None else F.lit(False)
    proven = out.filter(~skipped).agg(*(P.date_convention(x).alias(f"__d{i}") for i, x in enumerate(cells)), *(P.number_convention(x).alias(f"__n{i}") for i, x in enumerate(cells)))
    proven = proven.first()
    for i, h in enumerate(headers):
        p = plan.column(h)
        if p is not None and p.coded and codes is not None:
            own = codes.filter(c("column") == h).groupBy(c("code").alias(f"__code{i}")).agg(F.min("value").alias(f"__value{i}"))
            out = out.join(own, F.trim(c(f"`{h}`")) == c(f"__code{i}"), "left").withColumn(h, F.coalesce(f"__value{i}", c(f"`{h}`")))
    fields: dict[str, Column] = {}
    for i, h in enumerate(headers):
        if (name := plan.kept(h)) is not None:
            p = plan.column(h)
            fields[name] = _read(c(f"`{h}`"), p.date if p is not None and p.date else proven[f"__d{i}"], proven[f"__n{i}"])
    raw_cells = [c(f"__raw.`{h}`") for h in headers]
    blank = F.coalesce(*(P.blank_to_null(x) for x in raw_cells)).isNull()
    # a row may turn out a total when only the plan's fields are looked at
    kept = [c(f"`{h}`") for h in headers if plan.kept(h) is not None]
    total = _is_total(raw_cells) | ~skipped & _is_total(kept) if kept else _is_total(raw_cells)
    reason = F.when(total, "total").when(skipped, "ignored")
    preview = F.substring(F.array_join(F.slice(F.filter(F.array(*raw_cells), lambda x: F.trim(x) != ""), 1, 4), " | "), 1, 80)
    read = out.filter(~blank).select("row_no", F.struct(*(x.alias(n) for n, x in fields.items())).alias("f"), F.to_json("__raw").alias("original_data"), reason.alias("reason"), preview.alias("preview"))
    return read.filter("reason IS NULL").select("row_no", "f.*", "original_data"), read.filter("reason IS NOT NULL").select("row_no", "reason", "preview")
