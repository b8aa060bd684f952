"""Field extraction from document text, and its arithmetic check, as staged DataFrame projections.

No stage shuffles: a document's lines stay one array in its row. Each stage is a select of its own, so that the
line analysis, the costly expression, is computed once. Look-ups stand behind a test whether the text has their
labels at all, and what only a missing value needs is computed only there. Stages are SQL text, parsed at once.

`strict` repairs two defects that the compatible mode keeps: a total that a comma-aware pattern cuts after
three digits, and an inter-state tax that the expected total leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions.amounts import MONEY, ZERO, quoted
from ..functions.text import GSTIN, OTHER_IDENTIFIERS, gstin_valid, normalize, normalized_again, words_to_number

# Labels, patterns and rule names of the extraction rules.
TAXABLE_LABELS = ["TAXABLE AMOUNT", "TAXABLE VALUE", "SUB TOTAL", "BASIC AMOUNT"]
FINAL_LABELS = ["TOTAL", "GRAND TOTAL", "AMOUNT PAYABLE"]
BLOCK_FINAL_LABELS = ["GRAND TOTAL", "AMOUNT PAYABLE", "FINAL TOTAL", "NET PAYABLE", "TOTAL"]
ORDER_VALUE_LABELS = ["TOTAL ORDER VALUE (EXCLUDING TAX)", "TOTAL ORDER VALUE EXCLUDING TAX"]
ITEM_ANCHORS = ["DESCRIPTION", "HSN", "QTY", "RATE", "AMOUNT"]
TAX_ANCHORS = ["CGST", "SGST", "IGST"]
TOTAL_ANCHORS = ["GRAND TOTAL", "AMOUNT PAYABLE", "TOTAL"]
ITEM_ROW_STOPS = ["DESCRIPTION", "SUB TOTAL", "TOTAL TAXABLE", "CGST", "SGST", "IGST", "TOTAL"]
DATE_LABELS = ["PI DATE", "ORDER REF DATE"]
NO_DATE_LABELS = ["PRICE IS VALID TILL", "WARRANTY"]
NUMBER_TAIL = r"\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]*)"
INVOICE_LABEL = r"(?=[IBDVS])(?:INVOICE|INV|BILL|DOC|VOUCHER|S\.?NO)\s*(?:NO|NUMBER)?\.?\s*[:\-]?\s*"
LABELLED_NUMBERS = {"PI": r"\bPI\s*NO\b" + NUMBER_TAIL, "ESTIMATION": r"\bESTIMATION\s*NO\b" + NUMBER_TAIL}
INVOICE_NUMBERS = [r"INVOICE\s+NUMBER\s*[:\-]\s*([A-Z0-9][A-Z0-9\-/]*)", INVOICE_LABEL + r"([A-Z0-9\-/]+)"]
FALLBACK_NUMBERS = [INVOICE_LABEL + r"([A-Z0-9][A-Z0-9\-/]*\d(?:[A-Z0-9\-/]*))", r"\b(\d{3,8}/\d{2}-\d{2})\b"]
DATES = [r"(?=\d)\b\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b", r"(?=\d)\b\d{1,2}\s+[A-Z]{3,9}\s+\d{2,4}\b", r"(?=\d)\b\d{1,2}-[A-Z]{3}-\d{2,4}\b"]
SHORT_NUMBER = r"(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\d+\.\d{2})"
FULL_NUMBER = r"(\d+(?:,\d{3})*(?:\.\d{1,2})?)"
FINALS = [
    ("GRAND_TOTAL_PRIORITY", r"(?=G)\bGRAND\s*TOTAL\b[^\d]{0,25}"),
    ("AMOUNT_PAYABLE_PRIORITY", r"(?=A)\bAMOUNT\s*PAYABLE\b[^\d]{0,25}"),
    ("NET_PAYABLE_PRIORITY", r"(?=N)\bNET\s*PAYABLE\b[^\d]{0,25}"),
    ("TOTAL_RUPEE_PRIORITY", r"(?=T)\bTOTAL\s*₹?\s*"),
    ("TOTAL_AMOUNT_PRIORITY", r"(?=T)\bTOTAL\s*AMOUNT\b[^\d]{0,25}"),
]
GENERIC_TOTAL = r"TOTAL\s*[:\-]?\s*(\d+(?:,\d{3})*(?:\.\d{1,2})?)"
SUBTOTAL = r"(?=[STBN])(?:SUB\s*TOTAL|TAXABLE\s*VALUE|TAXABLE\s*AMOUNT|BASIC\s*AMOUNT|NET\s*AMOUNT)[^\d]{0,40}(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+\.\d{1,2}|\d+)"
LINE_TAX = r"\b{tax}\b[^\d]{{0,20}}(\d{{1,3}}(?:,\d{{3}})+(?:\.\d{{1,2}})?|\d+\.\d{{1,2}})"
TABLE_HEADER = ["HSN/SAC", "TAXABLE VALUE"]
TABLE_AMOUNT = r"\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+\.\d{1,2}|\d+"
TABLE_IGST = r"^\s*\d{4,8}\s+(\d+(?:,\d{3})*(?:\.\d{1,2})?)\s+\d{1,2}(?:\.\d{1,2})?\s*%?\s+(\d+(?:,\d{3})*(?:\.\d{1,2})?)"
TABLE_LINES = 45
SUMMARY_SEGMENT = r"HSN/SAC\s+TAXABLE\s+VALUE[\s\S]{0,1200}?\bTOTAL\b[\s\S]{0,200}"
SUMMARY_ROW = r"\bTOTAL\b\s+([\d,.]+)\s+([\d,.]+)\s+([\d,.]+)"
RETRY_TAXABLE = r"(?:TAXABLE\s*VALUE|TAXABLE\s*AMOUNT|SUB\s*TOTAL|BASIC\s*AMOUNT)[^\d]{0,20}(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)"
WORDS_MASTER = r"(TOTAL\s+INVOICE\s+VALUE\s*\(IN\s+WORDS\)|AMOUNT\s+IN\s+WORDS|TOTAL\s+IN\s+WORDS)"
WORDS_ANYWHERE = r"AMOUNT IN WORDS:\s*(.*)"
WORDS_INLINE = ("AMOUNT IN WORDS", r"AMOUNT\s+IN\s+WORDS\s*[:\-]\s*(.+)$")
WORDS_CHARGEABLE = ("AMOUNT CHARGEABLE (IN WORDS)", r"AMOUNT\s+CHARGEABLE\s*\(IN\s+WORDS\)\s*[:\-]?\s*(.+)$")
ENGINE_NUMBER = r"\bINVOICE\s*(?:NO|NUMBER)?" + NUMBER_TAIL
ENGINE_DATE = r"\bINVOICE\s*DATE\s*[:\-]?\s*(\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4})"
ENGINE_GSTIN = rf"\bGSTIN\s*[:\-]?\s*({GSTIN})\b"
CONF = ["invoice_number", "invoice_date", "gst_number", "taxable_amount", "cgst_amount", "sgst_amount", "igst_amount", "total_tax_amount", "round_off", "final_amount", "amount_in_words"]


def found(x: str, pattern: str, group: int = 1) -> str:
    """A group of the first match; null where nothing matches or the group is empty."""
    return f"nullif(regexp_extract({x}, {quoted(pattern)}, {group}), '')"


def _zero(x: str) -> str:
    return f"coalesce({x}, {ZERO})"


def _missing(x: str) -> str:
    return f"({x} IS NULL OR {x} = 0)"


def _at_least(conf: str, value: float) -> str:
    return f"greatest(coalesce({conf}, 0.0D), {value}D)"


def _when(condition: str, value: str, other: str | None = None) -> str:
    return f"CASE WHEN {condition} THEN {value}{f' ELSE {other}' if other else ''} END"


def _if_any(text: str, labels: list[str], value: str) -> str:
    """A look-up that can find something only where the text has one of the labels."""
    return _when(A.has_any(text, labels), value)


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {quoted('^[ \\-:/]+|[ \\-:/]+$')}, '')"


def invoice_number(text: str) -> str:
    """By the priority labels: purchase, estimation, invoice number, any invoice label; the latter two need a digit."""
    cands = [f"filter(array({_if_any(text, [label], trimmed(found(text, p)))}), c -> NOT c RLIKE {quoted(OTHER_IDENTIFIERS)})" for label, p in LABELLED_NUMBERS.items()]
    cands += [f"filter(array({trimmed(found(text, p))}), c -> c <> '' AND c RLIKE '[0-9]' AND NOT c RLIKE {quoted(OTHER_IDENTIFIERS)})" for p in INVOICE_NUMBERS]
    return f"coalesce({', '.join(f'get({c}, 0)' for c in cands)})"


def invoice_number_fallback(text: str) -> str:
    cands = [f"get(filter(array({trimmed(found(text, p))}), c -> c RLIKE '[0-9]' AND NOT c RLIKE {quoted(OTHER_IDENTIFIERS)}), 0)" for p in FALLBACK_NUMBERS]
    return f"coalesce({', '.join(cands)})"


def priority_date(L: str) -> str:
    return A.first_here(L, _when(f"{A.has_any('x.line', DATE_LABELS)} AND NOT {A.has_any('x.line', NO_DATE_LABELS)}", found("x.line", DATES[0], 0)), "string")


def any_date(L: str) -> str:
    dates = f"coalesce({', '.join(found('x.line', d, 0) for d in DATES)})"
    return A.first_here(L, _when(f"x.line RLIKE '[0-9]' AND NOT {A.has_any('x.line', NO_DATE_LABELS)}", dates), "string")


def gstin(text: str) -> str:
    """The first identifier-shaped word; its check character is looked at apart."""
    return found(text, rf"(?=\d)\b{GSTIN}\b", 0)


def word_readings(text: str, L: str) -> str:
    """What may be an amount in words, in the order of the four readings: in the line, or in the one after it."""
    def reading(anchor: str, pattern: str, group: int) -> str:
        return f"flatten({A.there(f'transform({L}, (x, i) -> {_when(anchor, f"array({found('x.line', pattern, group)}, get({L}, i + 1).line)")})')})"

    ways = [reading(f"x.line RLIKE {quoted(WORDS_MASTER)}", WORDS_MASTER + "(.*)$", 2), f"array({found(text, WORDS_ANYWHERE)})"]
    ways += [reading(f"contains(x.line, {quoted(label)})", pattern, 1) for label, pattern in (WORDS_INLINE, WORDS_CHARGEABLE)]
    return _when(f"{text} RLIKE {quoted('IN\\s+WORDS')}", f"flatten(array({', '.join(ways)}))")


def amount_in_words(readings: Column) -> Column:
    """The first reading that has a number word."""
    return F.get(F.array_compact(F.transform(readings, words_to_number)), F.lit(0)).cast(MONEY)


def tax_summary(L: str) -> str:
    """Totals, line sums and the inter-state sum of a product-code tax table of up to 45 lines; fields are null where absent."""
    header = " AND ".join([f"contains(x.line, {quoted(h)})" for h in TABLE_HEADER] + [A.has_any("x.line", TAX_ANCHORS)])
    start = f"CAST(array_position(transform({L}, x -> {header}), true) AS int)"
    nums = A.there(f"transform(regexp_extract_all(x.line, {quoted(TABLE_AMOUNT)}, 0), n -> {A.money('n')})")
    igst = A.money(f"regexp_extract({A.stripped('x.line')}, {quoted(TABLE_IGST)}, 2)")
    read = f"transform(slice({L}, greatest({start}, 1), {TABLE_LINES}), x -> named_struct('nums', {nums}, 'total', contains(x.line, 'TOTAL'), 'igst', {igst}))"
    code = "floor(get(r.nums, 0)) BETWEEN 1000 AND 99999999"
    rows = f"filter({_when(f'{start} > 0', read)}, r -> size(r.nums) >= 2)"
    rows = f"transform({rows}, r -> named_struct('nums', r.nums, 'total', r.total, 'igst', r.igst, 'row', if({code}, slice(r.nums, 2, {TABLE_LINES * 10}), r.nums)))"
    rest = f"aggregate(slice(r.row, 2, {TABLE_LINES * 10}), {ZERO}, (b, v) -> CAST(b + v AS {MONEY}))"
    # One fold over the rows: the last total row, and the sums of the others.
    start_sums = f"named_struct('total', CAST(NULL AS array<{MONEY}>), 'taxable', CAST(NULL AS {MONEY}), 'tax', CAST(NULL AS {MONEY}), 'igst', CAST(NULL AS {MONEY}))"
    item = "NOT r.total AND size(r.row) >= 2"
    plus = lambda field, condition, value: f"if({condition}, CAST({_zero(f'a.{field}')} + {value} AS {MONEY}), a.{field})"
    step = f"named_struct('total', if(r.total, r.nums, a.total), 'taxable', {plus('taxable', item, 'get(r.row, 0)')}, 'tax', {plus('tax', item, rest)}, 'igst', {plus('igst', 'r.igst IS NOT NULL', 'r.igst')})"
    end = f"named_struct('taxable', get(a.total, 0), 'tax', {A.last('a.total')}, 'line_taxable', a.taxable, 'line_tax', a.tax, 'igst', a.igst)"
    return f"aggregate({rows}, {start_sums}, (a, r) -> {step}, a -> {end})"


def summary_row(text: str) -> str:
    """taxable and tax of a tax table's total row of three numbers, by pattern alone."""
    row = found(text, SUMMARY_SEGMENT, 0)
    return f"named_struct('taxable', {A.money(found(row, SUMMARY_ROW, 1))}, 'tax', {A.money(found(row, SUMMARY_ROW, 2))})"


def retried_amounts(text: str, final: str, taxable: str) -> str:
    """final and taxable amounts: a missing one is looked for once more by the priority patterns."""
    finals = f"coalesce({', '.join(A.money(found(text, p + SHORT_NUMBER)) for _, p in FINALS)}, {final})"
    again = f"coalesce({A.money(found(text, RETRY_TAXABLE))}, {taxable})"
    return f"named_struct('final', {_when(_missing(final), finals, final)}, 'taxable', {_when(_missing(taxable), again, taxable)})"


def line_tax(L: str, tax: str) -> str:
    return A.first_here(L, _when(f"contains(x.line, {quoted(tax)})", A.money(found("x.line", LINE_TAX.format(tax=tax)))))


def final_ladder(text: str, L: str, strict: bool = False) -> str:
    """rule and amount of the first total pattern that matches; then the line after GRAND TOTAL; then any total."""
    number = FULL_NUMBER if strict else SHORT_NUMBER
    after = A.first_of(L, lambda x, i: _when("contains(x.line, 'GRAND TOTAL')", A.last(f"get({L}, i + 1).amts")))
    # A step's value is computed only where those before it have none.
    ways = [(quoted(rule), A.money(found(text, p + number))) for rule, p in FINALS] + [("CAST(NULL AS string)", after), ("'TOTAL_GENERIC_FALLBACK'", A.money(found(text, GENERIC_TOTAL)))]
    steps = [f"get(filter(array(named_struct('rule', {rule}, 'amount', {amount})), w -> w.amount IS NOT NULL), 0)" for rule, amount in ways]
    return f"coalesce({', '.join(steps)})"


def sections(L: str) -> str:
    """Start positions (from 1) of the item, tax and total blocks, each looked for from the one before; null where absent."""
    def hits(anchors: list[str]) -> str:
        return " + ".join(f"CAST(contains(x.line, {quoted(a)}) AS int)" for a in anchors)

    # One fold: the block looked for is the first that has not begun; a line may begin several.
    item = f"coalesce(a.item, if({hits(ITEM_ANCHORS)} >= 2, a.at, NULL))"
    mark = f"aggregate({L}, named_struct('at', 1, 'item', CAST(NULL AS int)), (a, x) -> named_struct('at', a.at + 1, 'item', {item}), a -> a.item)"
    first = lambda anchors, start: f"get({A.there(f'transform({L}, (x, i) -> if(i + 1 >= {start} AND {A.has_any("x.line", anchors)}, i + 1, NULL))')}, 0)"
    at_tax = f"transform(array({mark}), m -> named_struct('item', m, 'tax', {first(TAX_ANCHORS, 'coalesce(m, 1)')}))"
    return f"get(transform({at_tax}, s -> named_struct('item', s.item, 'tax', s.tax, 'total', {first(TOTAL_ANCHORS, 'coalesce(s.tax, s.item, 1)')})), 0)"


def block(L: str, start: str, end: str | None = None) -> str:
    """Lines from start up to end (exclusive), or to the last; none where start is null."""
    stop = f"coalesce({end}, size({L}) + 1)" if end else f"size({L}) + 1"
    return _when(f"{start} IS NOT NULL", f"slice({L}, {start}, greatest({stop} - {start}, 0))", f"slice({L}, 1, 0)")


def item_lines(block: str) -> str:
    """The rows of an item block: lines with an amount and without a stop word."""
    return f"filter({block}, x -> size(x.amts) > 0 AND NOT {A.has_any('x.line', ITEM_ROW_STOPS)})"


def items(block: str) -> str:
    """array<struct<hsn_code, description, amount>> of an item block's rows."""
    # Ends first: then few lines have white space left to fold, and no line needs a pattern for its ends.
    words = f"btrim(regexp_replace({A.stripped('x.line')}, {quoted(A.AMOUNT)}, ' '), concat('-:', chr(9), chr(10), chr(11), chr(12), chr(13), chr(32)))"
    words = A.filled(f"regexp_replace({words}, {quoted('\\s{2,}|[^\\S ]')}, ' ')")
    code = A.filled(f"regexp_extract(x.line, {quoted(r'(?=\d)\b\d{4,8}\b')}, 0)")
    return f"transform({item_lines(block)}, x -> named_struct('hsn_code', {code}, 'description', {words}, 'amount', {A.last('x.amts')}))"


def _rules(*pairs: tuple[str, str]) -> str:
    return A.there(f"array({', '.join(_when(c, r) for c, r in pairs)})")


def _stage(d: DataFrame, keep: list[Column], **columns: str | Column) -> DataFrame:
    return d.select(*keep, *[n if isinstance(c, str) and c == n else (F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def extract(docs: DataFrame, text: str = "text", strict: bool = False, only: list[str] | None = None) -> DataFrame:
    """docs with `invoice`, a struct of every extracted, checked and scored field of its text.

    A null text gives an invoice without fields, as an empty text does. Other columns may have any names; one that is called
    `invoice` is replaced. A filter on them goes to the scan of docs; one on the invoice stays above the extraction.

    only: the names of the invoice's fields to give, where not all are wanted; what no other field needs of the rest is not computed.
    """
    caller = [c for c in docs.columns if c.lower() != "invoice"]
    # Stages name their own columns, so the caller's have reserved names until the end.
    held = [F.col(f"`{c}`").alias(f"__kept{i}") for i, c in enumerate(caller)]
    keep = [F.col(f"__kept{i}") for i in range(len(caller))]
    d = _stage(docs, held, _t=normalize(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    d = _stage(d, keep, _t="_t", _L=A.analyzed("_t", capital=True), _again=normalized_again(F.col("_t")))
    if_any = lambda labels, value: _if_any("_t", labels, value)
    looked = {
        "pri_no": invoice_number("_t"), "shaped_gst": gstin("_t"), "pri_date": if_any(DATE_LABELS, priority_date("_L")), "readings": word_readings("_t", "_L"),
        "s": if_any(TABLE_HEADER[:1], tax_summary("_L")), "order_value": if_any(ORDER_VALUE_LABELS, A.labelled("_L", ORDER_VALUE_LABELS)),
        "net": if_any(["NET AMOUNT"], A.labelled("_L", ["NET AMOUNT"])), "subtotal": A.money(found("_t", SUBTOTAL)), "freight": if_any(["FREIGHT"], A.labelled_here("_L", ["FREIGHT"])),
        "item_sum": if_any(["FREIGHT"], A.item_sum("_L")), "cgst_sum": if_any(["CGST"], A.tax_sum("_L", "CGST")), "sgst_sum": if_any(["SGST"], A.tax_sum("_L", "SGST")),
        "ro": if_any([A.ROUND_OFF], A.round_off("_L")), "f": final_ladder("_t", "_L", strict),
    }
    d = _stage(d, keep, _t="_t", _L="_L", _again="_again", **looked)
    names = [n for n in looked if n not in ("shaped_gst", "readings", "order_value", "net")]
    # What only a missing value needs: a second number, any date, a tax by its line.
    d = _stage(
        d, keep, **{n: n for n in ("_t", "_L", "_again", *names)},
        alt_no=_when("pri_no IS NULL", invoice_number_fallback("_t")), alt_date=_when("pri_date IS NULL", any_date("_L")),
        gst0=F.when(gstin_valid(F.col("shaped_gst")), F.col("shaped_gst")), words=amount_in_words(F.col("readings")),
        line_cgst=_when(f"{_missing('cgst_sum')} AND contains(_t, 'CGST')", line_tax("_L", "CGST")), line_sgst=_when(f"{_missing('sgst_sum')} AND contains(_t, 'SGST')", line_tax("_L", "SGST")),
        line_igst=if_any(["IGST"], line_tax("_L", "IGST")), order_value="order_value", net_wins="net IS NOT NULL AND s.taxable IS NULL",
        tx1=_when("net IS NOT NULL AND s.taxable IS NULL", "net", "coalesce(order_value, s.taxable)"),
    )
    names += ["alt_no", "alt_date", "gst0", "words", "line_cgst", "line_sgst", "line_igst", "order_value", "net_wins", "tx1"]
    kept = {n: n for n in ("_t", "_L", "_again", *names)}
    # Taxable before taxes: order value, table total, net amount, subtotal, share of the words' total.
    near = A.closest(A.all_amounts("_L"), "words * CAST(0.8475 AS decimal(5,4))", f"greatest(CAST(8 AS {MONEY}), words * CAST(0.02 AS decimal(3,2)))")
    d = _stage(d, keep, **kept, near=_when("tx1 IS NULL AND subtotal IS NULL AND words IS NOT NULL", near), tx2="coalesce(tx1, subtotal)")
    freight = "freight IS NOT NULL AND item_sum IS NOT NULL AND (coalesce(tx2, near) IS NULL OR abs(coalesce(tx2, near) - item_sum) > 1)"
    own_tax = lambda t: _when(_missing(f"{t}_sum"), f"coalesce(line_{t}, {_zero(f'{t}_sum')})", f"{t}_sum")
    own_conf = lambda t: f"CASE WHEN {_missing(f'{t}_sum')} AND line_{t} IS NOT NULL THEN 0.9D WHEN {t}_sum IS NOT NULL THEN 0.97D END"
    d = _stage(d, keep, **kept, near="near", with_freight=freight, tx3="coalesce(tx2, near)", cg=own_tax("cgst"), sg=own_tax("sgst"), ig=f"coalesce(s.igst, line_igst, {ZERO})", final0="coalesce(words, f.amount)")
    tx_conf = "CASE WHEN tx1 IS NOT NULL THEN 0.99D WHEN subtotal IS NOT NULL THEN 0.9D WHEN near IS NOT NULL THEN 0.86D END"
    both = "cg <> 0 AND sg <> 0"
    total_tax = f"CAST({_when(both, 'cg + sg', f'coalesce(s.igst, s.tax, {_when("cg + sg + ig > 0", "cg + sg + ig")})')} AS {MONEY})"
    tt_conf = "CASE WHEN s.igst IS NOT NULL THEN 0.99D WHEN s.tax IS NOT NULL THEN 0.97D END"
    kept |= {n: n for n in ("near", "with_freight", "cg", "sg", "ig", "final0")}
    d = _stage(d, keep, **kept, tx=_when("with_freight", "item_sum", "tx3"), tx_conf=_when("with_freight", _at_least(tx_conf, 0.96), tx_conf), both=both, tt=total_tax, tt_conf=_when(both, _at_least(tt_conf, 0.95), tt_conf))
    kept |= {n: n for n in ("both", "tt", "tt_conf")}
    derived = f"final0 - tt - {_zero('ro')}"
    d = _stage(d, keep, **kept, tx="tx", tx_conf="tx_conf", derived=_when(f"tx IS NULL AND {derived} > 0", f"CAST({derived} AS {MONEY})"))
    d = _stage(d, keep, **kept, derived="derived", taxable="coalesce(tx, derived)", taxable_conf=_when("derived IS NOT NULL", _at_least("tx_conf", 0.94), "tx_conf"))
    kept |= {n: n for n in ("derived", "taxable", "taxable_conf")}
    d = _stage(d, keep, **kept, larger=_when("final0 < taxable", A.search_down("_L", "taxable")))
    kept |= {"larger": "larger"}
    final1 = "coalesce(larger, final0)"
    by_column = f"cgst_sum IS NULL AND sgst_sum IS NULL AND {final1} IS NOT NULL AND NOT {A.is_close(f'taxable + cg + sg + {_zero("ro")}', final1, 0.01)}"
    column = lambda t: _when(f"contains(_t, '{t}') AND {by_column}", A.column_tax("_L", t))
    d = _stage(d, keep, **kept, final1=final1, col_cgst=column("CGST"), col_sgst=column("SGST"))
    recon = "s.line_taxable + s.line_tax"
    # The rules' names.
    applied = _rules(
        ("pri_no IS NOT NULL", "'INVOICE_NUMBER_LABEL_PRIORITY'"), ("pri_no IS NULL AND alt_no IS NOT NULL", "'INVOICE_NO_WITH_SUFFIX'"),
        ("pri_date IS NOT NULL", "'PI_OR_ORDER_REF_DATE_PRIORITY'"), ("words IS NOT NULL", "'MASTER_TOTAL_FROM_WORDS'"),
        ("order_value IS NOT NULL", "'TOTAL_ORDER_VALUE_EXCLUDING_TAX_PRIORITY'"), ("order_value IS NULL AND s.taxable IS NOT NULL", "'SUMMARY_TABLE_TOTAL_ROW_PRIORITY'"),
        ("s.igst IS NOT NULL", "'IGST_SUM_FROM_HSN_SAC_TABLE'"), ("net_wins", "'NET_AMOUNT_PRIORITY'"), ("near IS NOT NULL", "'TAXABLE_FROM_MASTER_TOTAL_RATIO'"),
        ("with_freight", "'TAXABLE_INCLUDES_FREIGHT_FROM_ITEMS'"), ("cgst_sum IS NOT NULL", "'CGST_MULTI_LINE_SUM'"), ("sgst_sum IS NOT NULL", "'SGST_MULTI_LINE_SUM'"),
        ("both", "'TOTAL_TAX_FROM_9_PERCENT_COMPONENTS'"), ("ro IS NOT NULL", "'ROUND_OFF_CAPTURED'"), ("f.rule IS NOT NULL", "f.rule"),
        ("words IS NOT NULL", "'FINAL_FROM_AMOUNT_IN_WORDS_ANCHOR'"), ("derived IS NOT NULL", "'TAXABLE_DERIVED_FROM_MASTER_TOTAL_MINUS_TAX'"),
        ("larger IS NOT NULL", "'REJECT_SMALL_TOTAL_AND_SEARCH_DOWN'"), (f"{recon} IS NOT NULL AND final1 IS NOT NULL", "'MATHEMATICAL_RECONCILIATION'"),
        ("col_cgst IS NOT NULL OR col_sgst IS NOT NULL", "'GST_FROM_TAX_AMOUNT_COLUMN_FALLBACK'"),
    )
    conf = {
        "invoice_number": "CASE WHEN pri_no IS NOT NULL THEN 0.99D WHEN alt_no IS NOT NULL THEN 0.95D END", "invoice_date": "CASE WHEN pri_date IS NOT NULL THEN 0.99D WHEN alt_date IS NOT NULL THEN 0.95D END",
        "gst_number": _when("gst0 IS NOT NULL", "0.95D"), "taxable_amount": "taxable_conf", "cgst_amount": _when("col_cgst IS NOT NULL", _at_least(own_conf("cgst"), 0.85), own_conf("cgst")),
        "sgst_amount": _when("col_sgst IS NOT NULL", _at_least(own_conf("sgst"), 0.85), own_conf("sgst")), "igst_amount": "CASE WHEN s.igst IS NOT NULL THEN 0.99D WHEN line_igst IS NOT NULL THEN 0.9D END",
        "total_tax_amount": "tt_conf", "round_off": _when("ro IS NOT NULL", "0.95D"), "amount_in_words": _when("words IS NOT NULL", "0.98D"),
        "final_amount": "CASE WHEN larger IS NOT NULL THEN 0.92D WHEN words IS NOT NULL THEN 0.98D WHEN f.amount IS NOT NULL THEN 0.9D END",
    }
    record = {
        "invoice_number": "coalesce(pri_no, alt_no)", "invoice_date": "coalesce(pri_date, alt_date)", "gst_number": "gst0", "taxable_amount": "taxable", "sub_total": "taxable",
        "cgst_amount": "coalesce(col_cgst, cg)", "sgst_amount": "coalesce(col_sgst, sg)", "igst_amount": "ig", "total_tax_amount": "tt", "round_off": _zero("ro"), "final_amount": "final1",
        "amount_in_words": "words", "line_item_taxable_sum": "s.line_taxable", "line_item_tax_sum": "s.line_tax", "freight_charges": "freight",
        "reconciliation_total": _when("final1 IS NOT NULL", f"CAST({recon} AS {MONEY})"), "reconciliation_passed": _when(f"{recon} IS NOT NULL AND final1 IS NOT NULL", A.is_close(recon, "final1", 0.01)),
        "label_match": "coalesce(pri_no, alt_no) IS NOT NULL", "conf": _struct(conf), "rules": applied,
    }
    checked = validate(_stage(d, keep, _t="_t", _L="_L", _again="_again", r=_struct(record)), keep, strict, only)
    return checked.select(*[F.col(f"__kept{i}").alias(c) for i, c in enumerate(caller)], "invoice")


def _struct(fields: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{n}', {x}" for n, x in fields.items())})"


def validate(d: DataFrame, keep: list[Column], strict: bool = False, only: list[str] | None = None) -> DataFrame:
    """The checking engine over _t, _L, _again (the text normalized once more) and r: fallbacks by label and section, the sum, the last resort, confidence and rules."""
    own = ("taxable", "cgst", "sgst", "igst", "final")
    labels = {"taxable": TAXABLE_LABELS, "cgst": ["CGST"], "sgst": ["SGST"], "igst": ["IGST"], "final": FINAL_LABELS}
    blocks = {"taxable": TAXABLE_LABELS, "cgst": ["CGST"], "sgst": ["SGST"], "igst": ["IGST"], "final": BLOCK_FINAL_LABELS}
    d = _stage(
        d, keep, _L="_L", r="r", _S=_when("_again = _t", "_L", A.analyzed("_again", capital=True)),
        **{f"l_{k}": _when(f"{_missing(f'r.{k}_amount')} AND {A.has_any('_t', labels[k])}", A.labelled("_L", labels[k])) for k in own},
        **{f"has_{k}": A.has_any("_again", blocks[k]) for k in own}, has_ro=A.has_any("_again", [A.ROUND_OFF]),
        e_no=_when("r.invoice_number IS NULL", trimmed(found("_t", ENGINE_NUMBER))), e_date=_when("r.invoice_date IS NULL", found("_t", ENGINE_DATE)), e_gst=_when("r.gst_number IS NULL AND contains(_t, 'GSTIN')", found("_t", ENGINE_GSTIN)),
    )
    kept = {n: n for n in ("_L", "r", "_S", "e_no", "e_date", "e_gst", "has_ro")}
    v1 = {k: _when(f"{_missing(f'r.{k}_amount')} AND l_{k} IS NOT NULL", f"l_{k}", f"r.{k}_amount") for k in own}
    k1 = {k: _when(f"{_missing(f'r.{k}_amount')} AND l_{k} IS NOT NULL", _at_least(f"r.conf.{k}_amount", 0.88), f"r.conf.{k}_amount") for k in own}
    d = _stage(d, keep, **kept, **{f"v1_{k}": v1[k] for k in own}, **{f"k1_{k}": k1[k] for k in own}, **{f"has_{k}": f"has_{k}" for k in own})
    kept |= {f"{x}1_{k}": f"{x}1_{k}" for x in "vk" for k in own}
    d = _stage(d, keep, **kept, **{f"want_{k}": f"{_missing(f'v1_{k}')} AND has_{k}" for k in own})
    kept |= {f"want_{k}": f"want_{k}" for k in own}
    # The sections are those of the text normalized once more; they are looked for where something is to be read in them.
    wanted = sections("_S") if only is None or "items" in only else _when(f"has_ro OR {_missing('v1_taxable')} OR {' OR '.join(f'want_{k}' for k in own)}", sections("_S"))
    d = _stage(d, keep, **kept, at=wanted)
    del kept["_S"]
    d = _stage(d, keep, **kept, item_block=block("_S", "at.item", "coalesce(at.tax, at.total)"), tax_block=block("_S", "at.tax", "at.total"), total_block=block("_S", "coalesce(at.tax, at.total)"))
    sums = {k: A.tax_sum("tax_block", k.upper()) for k in ("cgst", "sgst", "igst")} | {"taxable": A.labelled("total_block", TAXABLE_LABELS), "final": A.labelled("total_block", BLOCK_FINAL_LABELS)}
    kept = {n: n for n in ("_L", "r", "item_block", "e_no", "e_date", "e_gst", *(f"{x}1_{k}" for x in "vk" for k in own))}
    d = _stage(d, keep, **kept, v_ro=f"coalesce({_when('has_ro', A.round_off('total_block'))}, r.round_off)", b_items=_when(_missing("v1_taxable"), A.total(item_lines("item_block"), A.last("x.amts"))), **{f"b_{k}": _when(f"want_{k}", sums[k]) for k in own})
    fill = {k: f"{_missing(f'v1_{k}')} AND b_{k} IS NOT NULL" for k in own}
    kept = {n: n for n in ("_L", "r", "item_block", "e_no", "e_date", "v_ro")}
    second = {f"v2_{k}": _when(fill[k], f"b_{k}", f"v1_{k}") for k in own} | {f"k2_{k}": _when(fill[k], _at_least(f"k1_{k}", 0.88), f"k1_{k}") if k != "final" else "k1_final" for k in own}
    d = _stage(d, keep, **kept, **second, b_items="b_items", v_sub1=_when(fill["taxable"], "b_taxable", "r.sub_total"), v_gst="coalesce(r.gst_number, e_gst)")
    use_items = f"{_missing('v2_taxable')} AND b_items IS NOT NULL"
    kept |= {n: n for n in (*second, "v_gst")}
    d = _stage(d, keep, **kept, v_taxable=_when(use_items, "b_items", "v2_taxable"), v_sub_total=_when(use_items, "b_items", "v_sub1"))
    kept |= {n: n for n in ("v_taxable", "v_sub_total")}
    taxes = f"{_zero('v2_cgst')} + {_zero('v2_sgst')} + {_zero('v2_igst') if strict else ZERO}"
    d = _stage(d, keep, **kept, expected=f"CAST({_zero('v_taxable')} + ({taxes}) + {_zero('v_ro')} AS {MONEY})")
    part = _when(_missing("v2_igst"), f"{_zero('v2_cgst')} + {_zero('v2_sgst')}", "v2_igst")
    d = _stage(d, keep, **kept, expected="expected", resort=_when(f"abs({_zero('v2_final')} - expected) > 1", A.near_totals("_L", f"{_zero('v_taxable')} + {part}")))
    del kept["_L"], kept["e_no"]
    d = _stage(d, keep, **kept, e_no="e_no", expected="expected", resort="resort", v_final="coalesce(resort, v2_final)", difference=f"CAST({_zero('coalesce(resort, v2_final)')} - expected AS {MONEY})", v_no="coalesce(r.invoice_number, e_no)")
    words_ok = f"coalesce({A.is_close('r.amount_in_words', 'v_final', 1.0)} AND r.amount_in_words IS NOT NULL AND v_final IS NOT NULL, false)"
    is_gst = f"v_gst IS NOT NULL OR NOT {_missing('v2_cgst')} OR NOT {_missing('v2_sgst')} OR NOT {_missing('v2_igst')}"
    kept |= {n: n for n in ("expected", "resort", "v_final", "difference", "v_no")}
    d = _stage(d, keep, **kept, label_match="r.label_match OR e_no IS NOT NULL", math_ok="abs(difference) <= 1", words_ok=words_ok, is_gst=is_gst, gst_ok=gstin_valid(F.col("v_gst")))
    # The checking rules' names.
    first = _rules(("true", "'MATH_VALIDATION'"), ("resort IS NOT NULL", "'TOTAL_BLOCK_PRIORITY'"), ("words_ok", "'WORDS_TOTAL_MATCH'"))
    later = _rules(("resort IS NULL", "'TOTAL_BLOCK_PRIORITY'"), ("NOT words_ok", "'WORDS_TOTAL_MATCH'"))
    default = lambda k: f"coalesce(k2_{k}, if({f'v_{k}' if k in ('taxable', 'final') else f'v2_{k}'} IS NULL, 0.4D, 0.7D))"
    conf = {k: f"r.conf.{k}" for k in CONF} | {f"{k}_amount": default(k) for k in own}
    confidence = f"map_filter(map({', '.join(f"'{k}', CAST({conf[k]} AS double)" for k in CONF)}), (k, v) -> v IS NOT NULL)"
    overall = "CASE WHEN label_match THEN 0.95D WHEN coalesce(v_no, '') <> '' THEN 0.7D ELSE 0.2D END + if(gst_ok, 0.95D, 0.2D) + if(math_ok, 0.1D, 0.0D) + if(words_ok, 0.1D, 0.0D)"
    invoice = {
        "invoice_number": "v_no", "invoice_date": "coalesce(r.invoice_date, e_date)", "gst_number": "v_gst", "taxable_amount": "v_taxable", "sub_total": "v_sub_total", "cgst_amount": "v2_cgst",
        "sgst_amount": "v2_sgst", "igst_amount": "v2_igst", "total_tax_amount": "r.total_tax_amount", "round_off": "v_ro", "final_amount": "v_final",
        **{x: f"r.{x}" for x in ("amount_in_words", "line_item_taxable_sum", "line_item_tax_sum", "freight_charges", "reconciliation_total", "reconciliation_passed")},
        "math_expected_total": "expected", "math_difference": "difference", "tax_math_match": "math_ok", "words_match": "words_ok", "is_gst_invoice": "is_gst",
        "invoice_type": "if(is_gst, 'GST Invoice', 'Non-GST Invoice')", "validation": "CASE WHEN NOT is_gst THEN 'Non GST Invoice' WHEN math_ok THEN 'Verified' ELSE 'Math Mismatch' END",
        "requires_manual_review": f"{_missing('v_final')} OR NOT math_ok", "overall_confidence": f"round(({overall}) / 4, 4)", "confidence": confidence,
        "rules_applied": f"concat(r.rules, {first}, {later})", "invoice_number_label_match": "label_match", "items": items("item_block"),
    }
    if only is not None:
        if unknown := set(only) - set(invoice):
            raise ValueError(f"no fields of an invoice: {sorted(unknown)}")
        invoice = {k: v for k, v in invoice.items() if k in only}
    # Generated as the one element of an array: a filter on the invoice stays above a generator, as it would
    # otherwise copy every stage's expressions into itself, and a filter on other columns passes it.
    return d.select(*keep, F.explode(F.array(F.expr(_struct(invoice)))).alias("invoice"))
