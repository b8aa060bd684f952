"""Money in lines of text, as SQL expressions. Amounts are DECIMAL(18,2): every amount that the tokenizer accepts has at most two decimals.

A document's lines stay one array in its row, so that looking at neighbouring lines needs no shuffle:
`analyzed` turns text into array<struct<line, amts>>, and the look-ups below are expressions over that array.
Functions take and give SQL text, for `F.expr`: one parse builds what would be thousands of calls into the JVM.
Their lambda variables are single small letters, `line` and `num`: columns given to them need other names.
"""

from __future__ import annotations

from collections.abc import Callable

from .text import SPACE

# Money, the patterns of amounts and of what is no amount, stop words and total words.
MONEY = "decimal(18,2)"
#: The digit is looked for before the costlier word border.
AMOUNT = r"(?=\d)\b\d+(?:,\d{3})*(?:\.\d{1,2})?\b"
CODE = r"\b(HSN|SAC)\b"
COUNTED = "^(NOS|UNITS|PCS|QTY)"
POSTAL = "PIN|TAMIL|NADU|CHENNAI|BANGALORE"
#: What a line may end in, after a space or a hyphen, to end in a whole amount that fits MONEY.
PLAIN = r"^\d{1,16}(?:\.\d{1,2})?\z"
SUSPECT = "HSN|SAC|NOS|UNITS|PCS|QTY|PIN|TAMIL|NADU|CHENNAI|BANGALORE"
ITEM_STOPS = ["SUB TOTAL", "TOTAL TAXABLE", "CGST", "SGST", "IGST", "TOTAL IN WORDS", "AMOUNT IN WORDS"]
ITEM_HEADER = ["DESCRIPTION", "AMOUNT"]
TOTAL_WORD = r"\b(TOTAL|GRAND TOTAL|AMOUNT PAYABLE|NET PAYABLE)\b"
TOTAL_NEAR = r"\b(TOTAL|AMOUNT\s+PAYABLE|GRAND\s+TOTAL)\b"
TAX_COLUMN = "TAX AMOUNT"
ROUND_OFF = "ROUND OFF"
SIGNED = r"[+-]?\d+(?:,\d{3})*(?:\.\d{1,2})?"
#: White space as stripping sees it: ASCII white space with the four separator controls.
STRIP = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

ZERO = f"CAST(0 AS {MONEY})"


def quoted(text: str) -> str:
    """A raw SQL literal, without escapes."""
    return f'r"{text}"' if "'" in text else f"r'{text}'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quoted(STRIP)}, '')"


def stripped(x: str) -> str:
    """`strip` of an ASCII line, without a pattern."""
    return f"btrim({x}, concat({', '.join(f'chr({ord(c)})' for c in SPACE)}))"


def filled(x: str) -> str:
    """x, or null where it is empty. Inside a lambda, where `nullif` would make x twice."""
    return f"get(filter(array({x}), w -> w <> ''), 0)"


def money(x: str) -> str:
    """A matched number as money."""
    return f"try_cast(replace({x}, ',', '') AS {MONEY})"


def there(xs: str) -> str:
    """The elements that are not null."""
    return f"array_compact({xs})"


def placed(line: str, pattern: str = AMOUNT) -> str:
    """array<struct<num, at>> of the matches and their offsets (from 0): the pieces between matches give the offsets."""
    nums, pieces = f"regexp_extract_all({line}, {quoted(pattern)}, 0)", f"split({line}, {quoted(pattern)}, -1)"
    size = lambda xs: f"aggregate({xs}, 0, (a, s) -> a + length(s))"
    return f"transform({nums}, (num, k) -> named_struct('num', num, 'at', {size(f'slice({pieces}, 1, k + 1)')} + {size(f'slice({nums}, 1, k)')}))"


def _is_money(line: str, m: str) -> str:
    """Whether a placed number is money: no count, product code or postal code by its surroundings."""
    num, at, upper = f"{m}.num", f"{m}.at", f"upper({line})"
    end = f"({at} + length({num}))"
    digits = f"length(replace(substring_index({num}, '.', 1), ',', ''))"
    around = f"substr({upper}, greatest({at} - 20, 0) + 1, {end} + 20 - greatest({at} - 20, 0))"
    prefix = f"substr({upper}, greatest({at} - 12, 0) + 1, {at} - greatest({at} - 12, 0))"
    after = f"upper({strip(f'substr({line}, {end} + 1, 10)')})"
    code = f"{digits} BETWEEN 4 AND 8 AND ({around} RLIKE {quoted(CODE)} OR {prefix} RLIKE {quoted(CODE + '\\s*[:\\-/]*\\s*$')})"
    return f"NOT ({after} RLIKE {quoted(COUNTED)} OR ({code}) OR ({digits} = 6 AND {around} RLIKE {quoted(POSTAL)}))"


def line_amounts(line: str, suspect: bool = True, capital: bool = False) -> str:
    """The money amounts of a line, in order. Lines without a digit, most of a text, skip the work; only lines with a suspect word look at surroundings.

    suspect: false where no line has a suspect word; capital: the line is in upper case.
    """
    every = there(f"transform(regexp_extract_all({line}, {quoted(AMOUNT)}, 0), m -> {money('m')})")
    kept = there(f"transform(filter({placed(line)}, m -> {_is_money(line, 'm')}), m -> {money('m.num')})")
    chosen = f"WHEN NOT {has_any(line if capital else f'upper({line})', SUSPECT.split('|'))} THEN {every} ELSE {kept}" if suspect else f"ELSE {every}"
    return f"CASE WHEN NOT {line} RLIKE '[0-9]' THEN CAST(array() AS array<{MONEY}>) {chosen} END"


def last_amount(line: str, capital: bool = False) -> str:
    """The last of `line_amounts`. Most lines with one end in it: that is read without a list, unless a word before it may tell that it is no money."""
    end, words = f"substring_index(substring_index({line}, ' ', -1), '-', -1)", ["HSN", "SAC", *POSTAL.split("|")]
    plain = f"{end} RLIKE {quoted(PLAIN)} AND NOT {has_any(line if capital else f'upper({line})', words)}"
    return f"coalesce(CASE WHEN {plain} THEN try_cast({end} AS {MONEY}) END, {last(line_amounts(line, capital=capital))})"


def analyzed(text: str, capital: bool = False) -> str:
    """array<struct<line, amts>> of a text's lines. Suspect words are looked for in the whole text once; capital: it is in upper case."""
    lines = lambda suspect: f"transform(split({text}, '\\n', -1), line -> named_struct('line', line, 'amts', {line_amounts('line', suspect)}))"
    return f"CASE WHEN {has_any(text if capital else f'upper({text})', SUSPECT.split('|'))} THEN {lines(True)} ELSE {lines(False)} END"


def last(xs: str) -> str:
    return f"try_element_at({xs}, -1)"


def first_of(xs: str, value: Callable[[str, str], str]) -> str:
    """The first value over the elements (x, their index i) that is not null."""
    return f"get({there(f'transform({xs}, (x, i) -> {value("x", "i")})')}, 0)"


def first_here(xs: str, value: str, kind: str = MONEY) -> str:
    """The first value over the elements x that is not null, of a kind; the elements after it are not looked at."""
    return f"aggregate({xs}, CAST(NULL AS {kind}), (a, x) -> coalesce(a, {value}))"


def has_any(line: str, labels: list[str]) -> str:
    return "(" + " OR ".join(f"contains({line}, {quoted(x)})" for x in labels) + ")"


def labelled(L: str, labels: list[str]) -> str:
    """The first line with a label and an amount in it, or else in the next line: its last amount."""
    return first_of(L, lambda x, i: f"CASE WHEN {has_any(f'{x}.line', labels)} THEN coalesce({last(f'{x}.amts')}, {last(f'get({L}, {i} + 1).amts')}) END")


def labelled_here(L: str, labels: list[str]) -> str:
    """As `labelled`, without the next line."""
    return first_here(L, f"CASE WHEN {has_any('x.line', labels)} THEN {last('x.amts')} END")


def total(xs: str, value: str = "x") -> str:
    """The sum of a value over the elements x; null where there is none."""
    return f"CASE WHEN size({xs}) > 0 THEN aggregate({xs}, {ZERO}, (a, x) -> CAST(a + {value} AS {MONEY})) END"


def tax_sum(L: str, label: str) -> str:
    """Sum over the label's lines of their last amount; only where there is none, the most of its TOTAL lines."""
    here = f"contains(x.line, {quoted(label)}) AND size(x.amts) > 0"
    fold = lambda when, value: f"aggregate({L}, CAST(NULL AS {MONEY}), (a, x) -> if({when}, {value}, a))"
    own = fold(f"{here} AND NOT contains(x.line, 'TOTAL')", f"CAST(coalesce(a, {ZERO}) + {last('x.amts')} AS {MONEY})")
    return f"coalesce({own}, {fold(here, f'greatest(a, {last("x.amts")})')})"


def item_sum(L: str) -> str:
    """Sum of the last amounts of the lines after the first item header, up to a stop word; later headers are skipped."""
    header = lambda x: " AND ".join(f"contains({x}.line, {quoted(h)})" for h in ITEM_HEADER)
    step = f"""CASE WHEN a.done THEN a
      WHEN {header('x')} THEN named_struct('open', true, 'done', false, 'sum', a.sum)
      WHEN NOT a.open THEN a
      WHEN {has_any('x.line', ITEM_STOPS)} THEN named_struct('open', true, 'done', true, 'sum', a.sum)
      WHEN size(x.amts) > 0 THEN named_struct('open', true, 'done', false, 'sum', CAST(coalesce(a.sum, {ZERO}) + {last('x.amts')} AS {MONEY}))
      ELSE a END"""
    return f"aggregate({L}, named_struct('open', false, 'done', false, 'sum', CAST(NULL AS {MONEY})), (a, x) -> {step}, a -> a.sum)"


def closest(values: str, target: str, tolerance: str | None = None) -> str:
    """The value nearest to the target, the first of equals; null beyond the tolerance."""
    best = f"array_min(transform({values}, (v, k) -> named_struct('gap', abs(v - ({target})), 'k', k, 'v', v)))"
    return f"{best}.v" if tolerance is None else f"CASE WHEN {best}.gap <= {tolerance} THEN {best}.v END"


def all_amounts(L: str) -> str:
    return f"flatten(transform({L}, x -> x.amts))"


def near_totals(L: str, target: str) -> str:
    """The amount nearest to the target among the lines around each total keyword."""
    around = f"transform({L}, (x, i) -> CASE WHEN x.line RLIKE {quoted(TOTAL_NEAR)} THEN flatten(transform(slice({L}, greatest(i, 1), if(i > 0, 3, 2)), y -> y.amts)) END)"
    return closest(f"flatten({there(around)})", target)


def search_down(L: str, least: str) -> str:
    """From the bottom, right to left, the first amount of a total line that is over `least`."""
    found = f"transform(filter(reverse({L}), x -> x.line RLIKE {quoted(TOTAL_WORD)}), x -> reverse(x.amts))"
    return f"get(filter(flatten({found}), v -> v > {least}), 0)"


def column_tax(L: str, label: str) -> str:
    """The label's amount in a TAX AMOUNT column: by offset within four lines, else the last number."""
    anchor = f"(nullif(locate({quoted(TAX_COLUMN)}, x.line), 0) - 1)"
    row = money(f"coalesce({last(f'filter({placed("y.line")}, m -> m.at >= {anchor})')}.num, {last(placed('y.line'))}.num)")
    window = f"get({there(f'transform(slice({L}, i + 1, 4), y -> {row})')}, 0)"
    return first_of(L, lambda x, i: f"CASE WHEN contains(x.line, {quoted(label)}) THEN {window} END")


def near_label_tax(L: str, pattern: str) -> str:
    """The last amount of the three lines after a label, else of its own line."""
    after = f"get({there(f'transform(slice({L}, i + 2, 3), y -> {last("y.amts")})')}, 0)"
    return first_of(L, lambda x, i: f"CASE WHEN x.line RLIKE {quoted(pattern)} THEN coalesce({after}, {last('x.amts')}) END")


def rate_tax(L: str, tax: str) -> str:
    """A tax at nine per cent near its label, else by column."""
    return f"coalesce({near_label_tax(L, rf'(?:9\s*%\s*{tax}|{tax}\s*[:\-]?\s*9\s*%)')}, {column_tax(L, tax)})"


def round_off(L: str) -> str:
    """The last signed number of the first ROUND OFF line that has one."""
    return first_here(L, f"CASE WHEN contains(x.line, {quoted(ROUND_OFF)}) THEN {money(last(f'regexp_extract_all(x.line, {quoted(SIGNED)}, 0)'))} END")


def is_close(a: str, b: str, tolerance: float = 1.5) -> str:
    return f"(abs(coalesce({a}, {ZERO}) - coalesce({b}, {ZERO})) <= CAST({tolerance} AS {MONEY}))"
