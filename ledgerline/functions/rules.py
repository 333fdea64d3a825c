"""Predicates and row amounts of the business rules, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import strip_accents

# Fragments of a status that take an order out of revenue.
EXCLUDED_STATUS = "annul|cancel|void|brouillon|draft|rembours|refund|retour|return"


def out_of_revenue(status: Column, unit_price: Column) -> Column:
    """The status holds an excluding fragment, or the unit price is negative."""
    return F.coalesce(F.lower(status).rlike(EXCLUDED_STATUS), F.lit(False)) | F.coalesce(unit_price < 0, F.lit(False))


def is_credit_note(quantity: Column, amount: Column) -> Column:
    """A negative quantity or a negative ex-tax amount."""
    return F.coalesce(quantity < 0, F.lit(False)) | F.coalesce(amount < 0, F.lit(False))


def is_sale(excluded: Column, credit: Column, amount: Column) -> Column:
    """Neither excluded nor a credit note, and the amount is not zero; an unknown amount counts."""
    return ~excluded & ~credit & F.coalesce(amount != 0, F.lit(True))


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounding with halves toward plus infinity."""
    p = 10.0**digits
    return F.floor(x * p + 0.5) / p


def is_refunded(return_status: Column, payment_status: Column, fulfillment_status: Column) -> Column:
    """Any return status but 'aucun', or paid back, or returned."""
    said = F.coalesce((return_status != "") & (return_status != "aucun"), F.lit(False))
    return said | F.coalesce(payment_status == "rembourse", F.lit(False)) | F.coalesce(fulfillment_status == "retourne", F.lit(False))


# What a class of status (see parsing.classify_status) means; a status that is not given counts, an unknown one does not.
def is_revenue_order(status_class: Column) -> Column:
    return status_class.isNull() | status_class.isin("completed", "pending")


def is_order_for_stock(status_class: Column) -> Column:
    return is_revenue_order(status_class)


def is_cancelled(status_class: Column) -> Column:
    return F.coalesce(status_class == "cancelled", F.lit(False))


def is_returned(status_class: Column) -> Column:
    return F.coalesce(status_class == "refunded", F.lit(False))


def is_draft(status_class: Column) -> Column:
    return F.coalesce(status_class == "draft", F.lit(False))


def is_cleared(status_class: Column) -> Column:
    """A transaction that has happened: not pending, cancelled or a draft."""
    return ~F.coalesce(status_class.isin("pending", "cancelled", "draft"), F.lit(False))


# What the type of a transaction holds, accents off; and statuses of money that hasn't moved.
EXPENSE_TYPES = "expense|sortie|debit|depense|decaissement|charge|cash-out|cash_out"
INCOME_TYPES = "income|entree|credit|revenu|encaissement|vente|cash-in|cash_in"
NOT_MOVED = "attente|pending|annul|draft"


def is_expense(kind: Column) -> Column:
    """By the type alone."""
    return F.coalesce(strip_accents(F.lower(kind)).rlike(EXPENSE_TYPES), F.lit(False))


def is_income(kind: Column) -> Column:
    """By the type alone; what says both is an expense."""
    return ~is_expense(kind) & F.coalesce(strip_accents(F.lower(kind)).rlike(INCOME_TYPES), F.lit(False))


def has_moved(status: Column) -> Column:
    """Neither pending, cancelled nor a draft; a status that isn't given counts."""
    return ~F.coalesce(F.lower(status).rlike(NOT_MOVED), F.lit(False))
