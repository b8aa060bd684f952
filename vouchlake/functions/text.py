"""Scalar text functions as Column expressions: normalization, identifiers, names, number words, JSON."""

from __future__ import annotations

import functools
import itertools
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as stripping sees it: ASCII white space with the four separator controls.
STRIP = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, STRIP, "")


def first_available(*values: Column, default: Column | None = None) -> Column:
    """The first value that is neither null nor empty, else the default."""
    return F.coalesce(*[F.when(v.cast("string") != "", v) for v in values], *([default] if default is not None else []))


def first_group(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null where nothing matches."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


#: White space that stripping takes off.
SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"


def normalize(text: Column) -> Column:
    """Upper case, currency marks and commas gone, ASCII only, single line ends, stripped. A plain text takes the short way."""
    x = F.regexp_replace(F.upper(text), "₹|INR|RS\\.?", "")
    x = F.replace(F.replace(x, F.lit(","), F.lit("")), F.lit("\r"), F.lit("\n"))
    x = F.regexp_replace(F.regexp_replace(x, r"[^\x00-\x7F]+", " "), "\n+", "\n")
    u = F.upper(text)
    there = [F.contains(text, F.lit(c)) for c in (",", "\r", "\n\n")] + [F.contains(u, F.lit(w)) for w in ("INR", "RS")]
    dirty = functools.reduce(lambda p, q: p | q, there, F.length(text) != F.octet_length(text))
    return F.when(dirty, strip(x)).otherwise(F.btrim(u, F.lit(SPACE)))


def normalized_again(text: Column) -> Column:
    """`normalize` of a normalized text: only currency marks that removing others has made are left to remove."""
    return F.when(F.contains(text, F.lit("INR")) | F.contains(text, F.lit("RS")), normalize(text)).otherwise(text)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


# Number words of the Indian scale.
NUMBER_WORDS = {
    "ZERO": 0, "ONE": 1, "TWO": 2, "THREE": 3, "FOUR": 4, "FIVE": 5, "SIX": 6, "SEVEN": 7, "EIGHT": 8, "NINE": 9,
    "TEN": 10, "ELEVEN": 11, "TWELVE": 12, "THIRTEEN": 13, "FOURTEEN": 14, "FIFTEEN": 15, "SIXTEEN": 16,
    "SEVENTEEN": 17, "EIGHTEEN": 18, "NINETEEN": 19, "TWENTY": 20, "THIRTY": 30, "FORTY": 40, "FIFTY": 50,
    "SIXTY": 60, "SEVENTY": 70, "EIGHTY": 80, "NINETY": 90,
}
SCALES = {"THOUSAND": 1_000, "LAKH": 100_000, "CRORE": 10_000_000}


HUNDRED = -1
#: What a word does to the fold: add its value, multiply by a hundred, or by its scale (negative).
CODES = NUMBER_WORDS | {"HUNDRED": HUNDRED} | {w: -v for w, v in SCALES.items()}
#: Each word's code stands at the word's checksum modulo the least length at which no two words meet, so a token is looked up at once.
SLOTS = next(m for m in itertools.count(len(CODES)) if len({zlib.crc32(w.encode()) % m for w in CODES}) == len(CODES))


def _code(token: Column) -> Column:
    """A token's code; null for other words."""
    slot = {zlib.crc32(w.encode()) % SLOTS: w for w in CODES}
    words = F.expr(f"array({', '.join(repr(slot.get(i, '')) for i in range(SLOTS))})")
    codes = F.expr(f"array({', '.join(f'{CODES[slot[i]]}L' if i in slot else 'NULL' for i in range(SLOTS))})")
    at = F.pmod(F.crc32(token.cast("binary")), F.lit(SLOTS)).cast("int")
    return F.when(F.get(words, at) == token, F.get(codes, at))


def words_to_number(words: Column) -> Column:
    """Number words to a number, in one fold over the tokens; null where no token is a number word.

    A scale word multiplies what was collected since the last one (or 1); other words are ignored.
    """
    codes = F.array_compact(F.transform(F.split(F.upper(words), "[^A-Z]+"), _code))
    zero, some = F.lit(0).cast("long"), lambda x: F.greatest(x, F.lit(1).cast("long"))

    def step(acc: Column, c: Column) -> Column:
        total = F.when(c < HUNDRED, acc["total"] - some(acc["part"]) * c).otherwise(acc["total"])
        part = F.when(c >= 0, acc["part"] + c).when(c == HUNDRED, some(acc["part"]) * 100).otherwise(zero)
        return F.struct(total.alias("total"), part.alias("part"))

    # The list of one binds the codes; without any there is no number.
    start = F.struct(zero.alias("total"), zero.alias("part"))
    return F.get(F.transform(F.filter(F.array(codes), lambda c: F.size(c) > 0), lambda c: F.aggregate(c, start, step, lambda acc: acc["total"] + acc["part"])), F.lit(0))


def coerce_double(x: Column) -> Column:
    """A number out of free text; null for empty, `null` and what is no number after removing other characters."""
    cleaned = F.regexp_replace(x, r"[^\d.-]", "")
    return F.when(~x.isin("", "null") & (cleaned != ""), cleaned.try_cast("double"))


def json_object(payload: Column) -> Column:
    """The JSON object text in a fenced block, else from the first { to the last }; null where it does not parse."""
    fenced = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
    body = F.coalesce(first_group(payload, fenced), payload)
    first, last = F.locate("{", body), F.length(body) - F.locate("}", F.reverse(body)) + 1
    found = F.when((first > 0) & F.contains(body, F.lit("}")) & (last > first), F.substring(body, first, last - first + 1))
    return F.when(F.try_parse_json(found).isNotNull(), found)


# The alphabet of the identifier's check character.
GSTIN_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN = r"\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]"


#: By place in it, what twice a character's value counts, its two base-36 digits summed: the even values, then the odd ones.
GSTIN_DOUBLED = "".join(GSTIN_ALPHABET[v // 2 + v % 2 * 18] for v in range(36))


def gstin_valid(gstin: Column) -> Column:
    """Whether the 15th character is the modulo-36 check of the first 14; false for null or malformed values."""

    def checked(x: Column) -> Column:
        value = lambda i, alphabet: F.position(F.substr(x, F.lit(i), F.lit(1)), F.lit(alphabet)) - 1
        total = functools.reduce(lambda a, b: a + b, [value(i, GSTIN_ALPHABET if i % 2 else GSTIN_DOUBLED) for i in range(1, 15)])
        return x.rlike("^[0-9A-Z]{15}$") & (value(15, GSTIN_ALPHABET) == (F.lit(36) - total % 36) % 36)

    # The list of one binds the value: it is made once a row, not once a character.
    return F.coalesce(F.get(F.transform(F.array(F.upper(strip(gstin))), checked), F.lit(0)), F.lit(False))


# Names of registrations other than an invoice; status words of the badges, in order.
OTHER_IDENTIFIERS = "UDYAM|MSME|LUT|ARN"
BADGES = {"VALID": "success", "MISSING": "warning", "MISMATCH": "error"}


def other_identifier(x: Column) -> Column:
    """Whether a value names a registration other than an invoice."""
    return x.rlike(OTHER_IDENTIFIERS)


def email_key(email: Column) -> Column:
    return F.lower(strip(F.coalesce(email, F.lit(""))))


def file_base(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/", -1), -1)


def _extension(name: Column) -> Column:
    """The last dot and what follows it, unless only dots stand before it."""
    return F.regexp_extract(name, r"[^./][^/]*?(\.[^./]*)$", 1)


def xlsx_name(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    ext = _extension(n)
    stem = F.substring(n, F.lit(1), F.length(n) - F.length(ext))
    return F.when(F.lower(ext) == ".xlsx", n).otherwise(F.concat(F.when(stem == "", "invoice").otherwise(stem), F.lit(".xlsx")))


def safe_name(name: Column, default: str = "invoice") -> Column:
    n = file_base(name)
    ext = _extension(n)
    stem = F.regexp_replace(F.substring(n, F.lit(1), F.length(n) - F.length(ext)), "[^A-Za-z0-9._-]+", "_")
    stem = F.regexp_replace(stem, r"^[._-]+|[._-]+$", "")
    return F.concat(F.when(stem == "", default).otherwise(stem), F.regexp_replace(ext, "[^A-Za-z0-9.]", ""))


def machine_hash(host: Column) -> Column:
    return F.sha2(host.cast("binary"), 256)


def confidence_label(score: Column) -> Column:
    # The labels and their bounds.
    return F.when(score >= 0.95, "✅ High").when(score >= 0.85, "⚠️ Medium").otherwise("❌ Review")


def percent(score: Column) -> Column:
    return F.concat((score * 100).cast("int").cast("string"), F.lit("%"))


def status_badge(status: Column) -> Column:
    """The badge of the first word that the status contains, else `info`."""
    return F.coalesce(*[F.when(F.contains(status, F.lit(word)), badge) for word, badge in BADGES.items()], F.lit("info"))
