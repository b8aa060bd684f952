"""Report rows, batch summaries and ledger vouchers from extracted invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY
from ..functions.dates import normalized_date, voucher_date
from ..functions.text import confidence_label, file_base, gstin_valid, percent
from .reconcile import confidence_mean, gst_total

# The columns of the three reports, in order.
SHEET = ["Voucher Type", "Date", "HSN Code", "Particulars", "Party Name", "GSTIN", "Taxable Value", "CGST", "SGST", "IGST", "Total Amount", "Source File Name", "Invoice Number", "Validation Status", "Confidence Score", "Validation"]
BATCH = ["Vendor", "Invoice No", "Date", "Taxable", "GST", "Total", "Source File Name", "Validation Status", "Confidence Score"]
BULK = ["Source File Name", "Invoice No", "Date", "GSTIN", "Taxable Value", "CGST", "SGST", "IGST", "Total", "Validation Status", "Confidence Score", "Rules Applied", "Output File"]


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def sheet_rows(df: DataFrame, status: Column, source: Column) -> DataFrame:
    """The 16-column report row of each `invoice`. Taxes are 0 and a missing taxable is the final amount outside the tax regime."""
    i = F.col("invoice")
    non = (i["invoice_type"] == "Non-GST Invoice") | (i["validation"] == "Non GST Invoice")
    tax = lambda k: F.when(non, F.lit(0).cast(MONEY)).otherwise(i[k]).cast("double")
    taxable = F.when(non, F.coalesce(i["taxable_amount"], i["final_amount"])).otherwise(i["taxable_amount"])
    values = [
        F.lit("Purchase"), normalized_date(i["invoice_date"]), _none(), _none(), _none(), F.upper(F.nullif(i["gst_number"], F.lit(""))),
        taxable.cast("double"), tax("cgst_amount"), tax("sgst_amount"), tax("igst_amount"), i["final_amount"].cast("double"), F.nullif(file_base(source), F.lit("")),
        i["invoice_number"], status, confidence_mean(i["confidence"]), F.coalesce(i["validation"], F.lit("Math Mismatch")),
    ]
    return df.select(*[v.alias(n) for v, n in zip(values, SHEET, strict=True)])


def sheet_marks(rows: DataFrame) -> DataFrame:
    """What a styled sheet shows in colour: validation and identifier checks."""
    ok = F.lower(F.coalesce("Validation", F.lit(""))).isin("verified", "non gst invoice")
    return rows.withColumns({"validation_ok": ok, "gstin_ok": F.col("GSTIN").isNull() | gstin_valid(F.col("GSTIN"))})


def bulk_rows(df: DataFrame, name: Column, status: Column, error: Column, output: Column) -> DataFrame:
    """The 13-column batch row of each `invoice`; a row with an error has only its name, FAILED and the message."""
    i, ok = F.col("invoice"), error.isNull()
    good = [name, i["invoice_number"], i["invoice_date"], i["gst_number"], *[i[k].cast("double") for k in ("taxable_amount", "cgst_amount", "sgst_amount", "igst_amount", "final_amount")], status, confidence_mean(i["confidence"]), F.array_join(i["rules_applied"], ", "), output]
    bad = {0: name, 9: F.lit("FAILED"), 11: error}
    return df.select(*[(F.when(ok, v).otherwise(bad[k]) if k in bad else F.when(ok, v)).alias(n) for k, (v, n) in enumerate(zip(good, BULK, strict=True))])


def batch_summary(bulk: DataFrame, *more: str) -> DataFrame:
    """The 9-column summary of bulk rows: taxes added up, numbers and dates coerced; with `more` columns of theirs, as they are."""
    gst = gst_total(*[F.col(k).cast(MONEY) for k in ("CGST", "SGST", "IGST")]).cast("double")
    values = [_none(), F.col("Invoice No"), normalized_date(F.col("Date")).cast("date"), F.col("Taxable Value").try_cast("double"), gst, F.col("Total").try_cast("double"), F.col("Source File Name"), F.col("Validation Status"), F.col("Confidence Score").try_cast("double")]
    return bulk.select(*[v.alias(n) for v, n in zip(values, BATCH, strict=True)], *[F.col(f"`{m}`") for m in more])


def column_widths(df: DataFrame) -> DataFrame:
    """One row: the longest value of each column as text, its name included."""
    return df.agg(*[F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))).alias(c) for c in df.columns])


def field_values(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, Field and Value: a report's columns as rows."""
    return df.select(*keys, *[F.col(f"`{f}`").cast("string").alias(f) for f in fields]).unpivot(keys, fields, "Field", "Value")


def confidence_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each field's confidence, with a percentage and a label."""
    rows = df.select(*keys, F.explode("invoice.confidence").alias("Field", "score"))
    return rows.select(*keys, "Field", percent(F.col("score")).alias("Confidence"), confidence_label(F.col("score")).alias("Status"))


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _tag(name: str, value: Column) -> Column:
    """An element; empty text gives an empty tag."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text == "", f"<{name} />").otherwise(F.concat(F.lit(f"<{name}>"), _escaped(text), F.lit(f"</{name}>")))


def _entry(ledger: str, positive: str, amount: Column) -> Column:
    text = amount.cast(MONEY).cast("string")
    return F.concat(F.lit(f"<ALLLEDGERENTRIES.LIST><LEDGERNAME>{ledger}</LEDGERNAME><ISDEEMEDPOSITIVE>{positive}</ISDEEMEDPOSITIVE><AMOUNT>"), text, F.lit("</AMOUNT></ALLLEDGERENTRIES.LIST>"))


# The fixed parts of a ledger import document.
HEAD = (
    "<?xml version='1.0' encoding='utf-8'?>\n<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA>"
    '<REQUESTDESC><REPORTNAME>Vouchers</REPORTNAME></REQUESTDESC><REQUESTDATA><TALLYMESSAGE xmlns:UDF="TallyUDF">'
    '<VOUCHER VCHTYPE="Sales" ACTION="Create" OBJVIEW="Invoice Voucher View">'
)
TAIL = "</VOUCHER></TALLYMESSAGE></REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>"


def _voucher(date: Column, number: Column | None, gstin: Column, narration: Column, total: Column, sales: Column, taxes: list[tuple[str, Column]]) -> Column:
    parts = [F.lit(HEAD), _tag("DATE", date), F.lit("<VOUCHERTYPENAME>Sales</VOUCHERTYPENAME>")]
    parts += [_tag("VOUCHERNUMBER", number)] if number is not None else []
    minus = F.concat(F.lit("-"), total.cast(MONEY).cast("string"))
    debtors = F.concat(F.lit("<ALLLEDGERENTRIES.LIST><LEDGERNAME>Sundry Debtors</LEDGERNAME><ISDEEMEDPOSITIVE>Yes</ISDEEMEDPOSITIVE><AMOUNT>"), minus, F.lit("</AMOUNT></ALLLEDGERENTRIES.LIST>"))
    parts += [_tag("PARTYGSTIN", gstin), _tag("NARRATION", narration), debtors, _entry("Sales", "No", sales)]
    parts += [F.when(x != 0, _entry(ledger, "No", x)).otherwise("") for ledger, x in taxes]
    return F.concat(*parts, F.lit(TAIL))


def _amounts(i: Column) -> tuple[Column, ...]:
    zero = F.lit(0).cast(MONEY)
    return tuple(F.coalesce(i[k].cast(MONEY), zero) for k in ("final_amount", "taxable_amount", "cgst_amount", "sgst_amount", "igst_amount"))


def voucher_xml(i: Column, narration: str = "Imported invoice", gstin: Column | None = None) -> Column:
    """A sales voucher with a ledger entry for each tax; a missing taxable is the total less taxes."""
    total, taxable, cgst, sgst, igst = _amounts(i)
    sales = F.when((taxable <= 0) & (total > 0), total - (cgst + sgst + igst)).otherwise(taxable)
    return _voucher(voucher_date(i["invoice_date"]), i["invoice_number"], gstin if gstin is not None else F.lit(""), F.lit(narration), total, sales, [("Output CGST", cgst), ("Output SGST", sgst), ("Output IGST", igst)])


def merged_voucher_xml(i: Column, narration: str = "Import for invoice ") -> Column:
    """A voucher without number, the taxes in one entry, the invoice number in the narration."""
    total, taxable, cgst, sgst, igst = _amounts(i)
    tax = (cgst + sgst + igst).cast(MONEY)
    date = F.coalesce(F.replace(normalized_date(i["invoice_date"]), F.lit("-"), F.lit("")), F.lit(""))
    text = F.trim(F.concat(F.lit(narration), F.coalesce(i["invoice_number"], F.lit(""))))
    return _voucher(date, None, i["gst_number"], text, F.when(total != 0, total).otherwise(taxable + tax), taxable, [("Output GST", F.greatest(tax, F.lit(0).cast(MONEY)))])


def simple_voucher_xml(gstin: Column, date: Column, total: Column, tax: Column, narration: str = "Imported invoice") -> Column:
    """A voucher from a total and a tax: sales are their difference, the date only loses its dashes."""
    zero = F.lit(0).cast(MONEY)
    t, x = F.coalesce(total.cast(MONEY), zero), F.coalesce(tax.cast(MONEY), zero)
    return _voucher(F.replace(F.coalesce(date, F.lit("")), F.lit("-"), F.lit("")), None, gstin, F.lit(narration), t, (t - x).cast(MONEY), [("Output GST", F.greatest(x, zero))])


def write_vouchers(df: DataFrame, xml: Column, path: str) -> None:
    """One document a line."""
    df.select(F.replace(xml, F.lit("\n"), F.lit("")).alias("value")).write.text(path)


def write_sheet(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A report as CSV with a header, Parquet or JSON; styled workbooks are not Spark's to write."""
    rows.write.format(form).option("header", True).save(path)
