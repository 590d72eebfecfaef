"""String helpers shared by the extraction expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware "strip" removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as the inside of a Java regex character class.
WHITESPACE_CLASS = r"\x09-\x0d\x1c-\x20\x85\p{Z}"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove Unicode white space at both ends (Spark's trim removes spaces only)."""
    return F.btrim(as_column(value), F.lit(WHITESPACE))


def url_unquote(value: Column | str) -> Column:
    """Percent-decode: ``+`` stays a plus sign and malformed escapes stay as they are."""
    text = as_column(value)
    guarded = F.replace(
        F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")
    )
    return F.when(text.contains("%"), F.try_url_decode(guarded)).otherwise(text)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a let-binding inside one expression)."""
    return F.transform(F.array(value), body)[0]


def string_array(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def split_list(value: Column | str) -> Column:
    """An option written as one string: a JSON array of strings, or parts between commas and semicolons."""
    value = as_column(value)
    listed = F.from_json(value, "array<string>")
    return F.when(strip(value).startswith("["), F.coalesce(listed, F.split(value, "[,;]"))).otherwise(F.split(value, "[,;]"))


def literal_map(table: dict[str, str]) -> Column:
    """A constant MAP<STRING,STRING>, written as one literal which the optimizer folds."""
    packed = "\x02".join(f"{k}\x03{v}" for k, v in table.items())
    return F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x03"))


def lookup_weight(table: dict[str, int], key: Column) -> Column:
    """The integer of a key in a constant table, 0 for other keys."""
    found = F.try_element_at(literal_map({k: str(v) for k, v in table.items()}), key)
    return F.coalesce(found.cast("int"), F.lit(0))
