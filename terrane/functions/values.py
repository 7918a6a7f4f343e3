"""Value semantics of the record model: blank, falsy, text of a value, digits, padding, exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """All Unicode white space at both ends goes, not blanks alone."""
    return F.regexp_replace(c, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def present(c: Column) -> Column:
    """Neither null nor blank; 0 and false are values."""
    return c.isNotNull() & (strip(c.cast("string")) != "")


def falsy(c: Column, dtype: T.DataType) -> Column:
    """Null, empty text, zero, false, empty array or map; a blank text is not."""
    if isinstance(dtype, T.BooleanType):
        return c.isNull() | ~c
    if isinstance(dtype, T.NumericType):
        return c.isNull() | (c == 0)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "")
    return c.isNull()


def text_of(c: Column) -> Column:
    """The value as a record store prints it: a missing one is `None`."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def positive_integer(c: Column) -> Column:
    """ASCII digits alone, not all zero; null is false."""
    return F.coalesce(c.rlike(r"\A[0-9]+\z") & c.rlike("[1-9]"), F.lit(False))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def integer_text(c: Column) -> Column:
    """The digits of a value as an integer without leading zeros; null if there is none."""
    d = digits(c)
    return F.when(d != "", F.coalesce(F.nullif(F.regexp_replace(d, r"\A0+", ""), F.lit("")), F.lit("0")))


def zfill(c: Column, width: int) -> Column:
    """Zeros from the left up to width, behind a leading sign; longer texts stay whole."""
    sign = F.regexp_extract(c, r"\A[+-]", 0)
    body = F.regexp_replace(c, r"\A[+-]", "")
    pad = F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(c)))
    return F.concat(sign, pad, body)


def half_even(num: Column, den: Column, places: int = 4) -> Column:
    """num / den of whole numbers, rounded half to even exactly; 0.0 for an empty denominator."""
    scaled = num.cast("decimal(28,0)") * F.lit(10**places).cast("decimal(9,0)")
    d = den.cast("decimal(28,0)")
    q = F.floor(scaled / d).cast("decimal(28,0)")
    r = scaled - q * d
    up = (2 * r > d) | ((2 * r == d) & (q % 2 == 1))
    return F.when(den > 0, (q + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(10**places))).otherwise(F.lit(0.0))


# Patterns of personal data: fixed values. Digits, blanks and word ends are Unicode ones.
PII = {
    "ssn": r"(?U)\b\d{3}-\d{2}-\d{4}\b",
    "email": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?U)\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
}


def email_norm(c: Column) -> Column:
    """Lower case, outer blanks and a plus tag gone."""
    return F.regexp_replace(F.lower(strip(c)), r"\+[^@]*@", "@")


def phone_digits(c: Column) -> Column:
    """The last ten digits; null if there are fewer."""
    d = digits(c)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10)))


def customer_code(c: Column) -> Column:
    """Free-form customer codes brought to their number: ADV-1001, ADV1001 and 1001 are one."""
    return integer_text(F.regexp_replace(F.upper(strip(c)), r"\A[A-Z]+[-_ ]?", ""))


def email_masked(c: Column) -> Column:
    """First two characters, two stars, the domain; null where there is no address."""
    return F.when(c.contains("@"), F.concat(F.substring(c, 1, 2), F.lit("**@"), F.substring_index(c, "@", -1)))


def without_zone(c: Column) -> Column:
    """A timestamp text as tills write it: no zone, no fraction of a second."""
    return F.regexp_replace(F.regexp_replace(c, r"(?:Z|[+-]00:?00)\z", ""), r"\.[0-9]+\z", "")


def table_of(path: str) -> str | None:
    """The table that a path of the Gold zone names: the segment after `gold`, without its extension; None elsewhere."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    at = next((i for i, p in enumerate(parts) if p.lower() == "gold"), None)
    return parts[at + 1].partition(".")[0] if at is not None and at + 1 < len(parts) else None
