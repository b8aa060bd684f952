"""The library's text rules as SQL functions and SQL table functions of a session, for plain SQL without Python.

`register(spark)` makes temporary functions from the same SQL text that extraction uses; the optimizer inlines them, and a table function
stands in a lateral join.

    SELECT d.doc_id, l.n, l.amounts FROM documents d, LATERAL document_lines(d.text) l WHERE size(l.amounts) > 0
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import extraction as X
from . import amounts as A
from .text import SPACE

#: `normalize`, as SQL text.
NORMALIZED = A.strip(rf"regexp_replace(regexp_replace(replace(replace(regexp_replace(upper(input), {A.quoted('₹|INR|RS\\.?')}, ''), ',', ''), chr(13), chr(10)), {A.quoted('[^\\x00-\\x7F]+')}, ' '), {A.quoted('\n+')}, chr(10))")
DIRTY = "length(input) <> octet_length(input) OR contains(input, ',') OR contains(input, chr(13)) OR contains(input, concat(chr(10), chr(10))) OR contains(upper(input), 'INR') OR contains(upper(input), 'RS')"
NORMALIZED = f"CASE WHEN {DIRTY} THEN {NORMALIZED} ELSE btrim(upper(input), concat({', '.join(f'chr({ord(c)})' for c in SPACE)})) END"
AMOUNTS = f"ARRAY<{A.MONEY.upper()}>"
LINES = f"transform(split({NORMALIZED}, '\\n', -1), line -> named_struct('line', line, 'amts', {A.line_amounts('line')}))"
#: The lines with a label, the only ones whose amounts are read.
LABELLED = f"transform(filter(split({NORMALIZED}, '\\n', -1), line -> contains(line, label)), line -> named_struct('line', line, 'amts', {A.line_amounts('line')}))"

#: Signature, and the value's SQL text. Null texts give null, or no rows.
SCALARS = [
    ("normalized_text(input STRING)", "STRING", NORMALIZED),
    ("line_amounts(input STRING)", AMOUNTS, A.line_amounts("input")),
    ("text_amounts(input STRING)", AMOUNTS, A.all_amounts(LINES)),
    ("labelled_amount(input STRING, label STRING)", A.MONEY.upper(), A.first_here(LABELLED, A.last("x.amts"))),
    ("tax_sum(input STRING, label STRING)", A.MONEY.upper(), A.tax_sum(LABELLED, "LABEL").replace(A.quoted("LABEL"), "label")),
    ("closest_amount(candidates " + AMOUNTS + f", target {A.MONEY.upper()}, tolerance {A.MONEY.upper()})", A.MONEY.upper(), A.closest("candidates", "target", "tolerance")),
    ("is_close(first_value DECIMAL(18,2), second_value DECIMAL(18,2))", "BOOLEAN", A.is_close("first_value", "second_value")),
    ("invoice_number(input STRING)", "STRING", f"coalesce({X.invoice_number(NORMALIZED)}, {X.invoice_number_fallback(NORMALIZED)})"),
    ("gstin(input STRING)", "STRING", X.gstin(NORMALIZED)),
]
TABLES = [
    ("document_lines(input STRING)", f"n INT, line STRING, amounts {AMOUNTS}", f"SELECT pos, col.line, col.amts FROM posexplode({LINES})"),
    (
        "item_rows(input STRING)",
        "n INT, hsn_code STRING, description STRING, amount DECIMAL(18,2)",
        f"SELECT pos, col.hsn_code, col.description, col.amount FROM posexplode({X.items(LINES)})",
    ),
]


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the functions of the session, their names after a prefix; their names. Functions of the same names are replaced."""
    made = []
    for signature, kind, value in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS {kind} RETURN {value}")
        made.append(prefix + signature.split("(")[0])
    for signature, columns, value in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS TABLE ({columns}) RETURN {value}")
        made.append(prefix + signature.split("(")[0])
    return made
