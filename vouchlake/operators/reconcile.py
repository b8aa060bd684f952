"""Predicates and decision ladders over extracted invoices: tolerance, tax check, status, audit, retry, choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY
from ..sources.shared import written

__all__ = ["audit", "better_of", "choose", "confidence_mean", "gst_total", "is_close", "is_non_gst", "quota_single", "quota_bulk", "status", "tax_math"]

FIRST = "__first"


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast(MONEY))


def is_close(a: Column, b: Column, tolerance: float = 1.5) -> Column:
    return F.abs(_zero(a) - _zero(b)) <= F.lit(tolerance).cast(MONEY)


def gst_total(cgst: Column, sgst: Column, igst: Column) -> Column:
    return (_zero(cgst) + _zero(sgst) + _zero(igst)).cast(MONEY)


def confidence_mean(confidence: Column) -> Column:
    """Mean of a map's values in per cent, two decimals; null for an empty or null map."""
    values = F.map_values(confidence)
    return F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values) * 100, 2))


def is_non_gst(gst_number: Column, cgst: Column, sgst: Column, igst: Column) -> Column:
    return (F.coalesce(gst_number, F.lit("")) == "") & (_zero(cgst) == 0) & (_zero(sgst) == 0) & (_zero(igst) == 0)


def tax_math(inv: Column, tolerance: float = 0.01) -> Column:
    """valid, expected and difference: taxable, the total tax (or inter-state, or both halves) and round-off against the final amount."""
    igst = _zero(inv["igst_amount"])
    tax = F.coalesce(inv["total_tax_amount"], F.when(igst > 0, igst).otherwise(_zero(inv["cgst_amount"]) + _zero(inv["sgst_amount"])))
    expected = (_zero(inv["taxable_amount"]) + tax + _zero(inv["round_off"])).cast(MONEY)
    known = inv["final_amount"].isNotNull()
    zero = F.lit(0).cast(MONEY)
    difference = (inv["final_amount"] - expected).cast(MONEY)
    return F.struct(
        (known & (F.abs(difference) <= F.lit(tolerance).cast(MONEY))).alias("valid"),
        F.when(known, expected).otherwise(zero).alias("expected"),
        F.when(known, difference).otherwise(zero).alias("difference"),
    )


def status(inv: Column) -> Column:
    """The status ladder of an invoice struct."""
    gst = gst_total(inv["cgst_amount"], inv["sgst_amount"], inv["igst_amount"])
    base = F.coalesce(F.when(inv["sub_total"] != 0, inv["sub_total"]), F.when(inv["taxable_amount"] != 0, inv["taxable_amount"]), F.lit(0).cast(MONEY))
    expected = (base + gst).cast(MONEY)
    # Plain digits with one decimal place at least, whatever the size.
    plain = lambda x: F.regexp_replace(x.cast(MONEY).cast("string"), "0$", "")
    return (
        F.when(inv.isNull(), "INVALID DATA")
        .when((inv["invoice_type"] == "Non-GST Invoice") | (inv["validation"] == "Non GST Invoice"), "Non GST Invoice")
        .when(inv["requires_manual_review"], "REQUIRES MANUAL REVIEW")
        .when(inv["final_amount"].isNull() | (inv["final_amount"] == 0), "FINAL AMOUNT MISSING")
        .when(~F.coalesce(inv["is_gst_invoice"], F.lit(False)), "VALID (NON-GST)")
        .when(gst == 0, "GST DETECTED BUT TAX AMOUNT MISSING")
        .when(F.abs(expected - inv["final_amount"]) > 2, F.concat(F.lit("TAX MISMATCH (Expected "), plain(expected), F.lit(", Found "), plain(inv["final_amount"]), F.lit(")")))
        .otherwise("VALID")
    )


# The sentences of the audit notes.
AUDIT = {
    "gst_number": "Matched standard GSTIN regex pattern",
    "taxable_amount": "Derived using largest valid pre-tax amount rule",
    "final_amount": "Recovered from TOTAL / computed fallback logic",
}


def audit(inv: Column) -> Column:
    """A map of the fields that were found, with a sentence each."""
    there = {"gst_number": F.coalesce(inv["gst_number"], F.lit("")) != ""} | {k: _zero(inv[k]) != 0 for k in ("taxable_amount", "final_amount")}
    return F.map_filter(F.create_map(*[x for k, v in AUDIT.items() for x in (F.lit(k), F.when(there[k], v))]), lambda _, v: v.isNotNull())


def better_of(first: Column, second: Column) -> Column:
    """The retried invoice where the first needs review and the retry does not; else the first."""
    return F.when(first["requires_manual_review"] & ~F.coalesce(second["requires_manual_review"], F.lit(True)), second).otherwise(first)


def choose(model: Column, rules: Column) -> Column:
    """The model's record where it gave one, else the rules'."""
    return F.coalesce(model, rules)


def quota_single(usage: Column, pro: Column, most: int = 10) -> Column:
    return pro | (F.coalesce(usage, F.lit(0)) < most)


def quota_bulk(usage: Column, batch: Column, most: int = 10) -> Column:
    """allowed, remaining and requested of a batch."""
    used = F.coalesce(usage, F.lit(0))
    return F.struct((used + batch <= most).alias("allowed"), F.greatest(F.lit(0), F.lit(most) - used).alias("remaining"), batch.alias("requested"))


def retried(first: DataFrame, rescan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Second pass for the rows that need review: improvements replace their invoices.

    The first pass is written once. rescan gets the rows to review, without their invoice, and gives them back with the
    `invoice` of the second scan; it keeps rows and their other columns as they are. Rows are never joined, so repeated rows
    and keys stay as they are. A null invoice needs no review.
    """
    names = first.columns
    done = written(first, "first_pass")
    review = F.coalesce(F.col("invoice.requires_manual_review"), F.lit(False))
    again = rescan(done.where(review).withColumnRenamed("invoice", FIRST))
    better = again.withColumn("invoice", better_of(F.col(FIRST), F.col("invoice"))).select(*[f"`{c}`" for c in names])
    return done.where(~review).unionByName(better)
