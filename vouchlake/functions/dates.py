"""Dates out of text, by lists of formats tried in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

ISO_THEN_DAY_FIRST = ["y-M-d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yy", "d/M/yy", "d.M.yy", "d-MMM-yyyy", "d MMM yyyy", "d-MMM-yy", "d MMM yy", "d MMMM yyyy"]
MONTH_FIRST = ["M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "M/d/yy", "M-d-yy", "M.d.yy"]
VOUCHER = ["d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "d-MMM-yyyy", "d MMM yyyy"]
EXPIRY = ["yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d"]


def first_date(x: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_date(x, f) for f in formats])


def normalized_date(x: Column) -> Column:
    """yyyy-MM-dd: ISO first, then day-first formats, then month-first ones where the day comes second; null where none fits."""
    return F.date_format(first_date(x, ["yyyy-M-d", *ISO_THEN_DAY_FIRST[1:], *MONTH_FIRST]), "yyyy-MM-dd")


def voucher_date(x: Column) -> Column:
    """yyyyMMdd, else the first eight digits, else empty."""
    t = strip(F.coalesce(x, F.lit("")))
    return F.coalesce(F.date_format(first_date(t, VOUCHER), "yyyyMMdd"), F.substring(F.regexp_replace(t, r"\D", ""), 1, 8))


def expiry_date(x: Column) -> Column:
    return first_date(x, EXPIRY)


def license_state(machine: Column, own_machine: Column, expiry: Column, today: Column, warn_days: int = 3) -> Column:
    """valid and message of a license: machine, expiry format, days left."""
    at = expiry_date(expiry)
    left = F.datediff(at, today)
    # The messages.
    state = lambda ok, text: F.struct(F.lit(ok).alias("valid"), text.alias("message"))
    return (
        F.when(machine.isNull() & expiry.isNull(), state(False, F.lit("License file not found")))
        .when(~machine.eqNullSafe(own_machine), state(False, F.lit("License invalid – machine mismatch")))
        .when(at.isNull(), state(False, F.lit("License expiry format invalid")))
        .when(left < 0, state(False, F.lit("License expired. Please renew.")))
        .when(left <= warn_days, state(True, F.concat(F.lit("License will expire in "), left.cast("string"), F.lit(" day(s). Please renew soon."))))
        .otherwise(state(True, F.lit("License valid")))
    )
