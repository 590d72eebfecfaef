"""Hide secrets in maps, structs and tables before they are shown or logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_column, strip

# Parts of a key that mark its value as secret, and the mask.
SENSITIVE_MARKERS = (
    "token", "secret", "password", "api_key", "apikey", "cookie", "authorization", "proxy",
)
MASK = "***"
SHORT_VALUE = 6


def is_sensitive_key(key: Column | str) -> Column:
    return F.lower(strip(key)).rlike("|".join(SENSITIVE_MARKERS))


def mask_value(value: Column | str) -> Column:
    """First three and last two characters around the mask; only the mask for short values."""
    text = strip(as_column(value).cast("string"))
    shown = F.concat(F.substring(text, 1, 3), F.lit(MASK), F.substring(text, -2, 2))
    return F.when(F.length(text) > SHORT_VALUE, shown).otherwise(F.lit(MASK))


def mask_map(data: Column | str) -> Column:
    """Mask the values of sensitive keys of a ``MAP<STRING,STRING>``."""
    return F.transform_values(as_column(data), lambda k, v: F.when(is_sensitive_key(k), mask_value(v)).otherwise(v))


def _sensitive_name(name: str) -> bool:
    lowered = name.strip().lower()
    return any(marker in lowered for marker in SENSITIVE_MARKERS)


def _mask(value: Column, kind: T.DataType) -> Column:
    """Walk a type: structs by field name, maps by key, arrays by element."""
    if isinstance(kind, T.StructType):
        fields = [
            (mask_value(_as_text(value[f.name], f.dataType)) if _sensitive_name(f.name) else _mask(value[f.name], f.dataType)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        inner = kind.valueType
        if isinstance(inner, T.StringType):
            return mask_map(value)
        if isinstance(inner, (T.StructType, T.MapType)):
            return F.transform_values(value, lambda k, v: F.when(is_sensitive_key(k), _hide(v, inner)).otherwise(_mask(v, inner)))
        # A mask is text, so numbers, arrays and the like become text in a map that may have secret keys.
        return F.transform_values(
            value,
            lambda k, v: F.when(is_sensitive_key(k), mask_value(_as_text(v, inner))).otherwise(_as_text(_mask(v, inner), inner).cast("string")),
        )
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _mask(v, kind.elementType))
    return value


def _hide(value: Column, kind: T.DataType) -> Column:
    """Mask all text below a secret key; what isn't text is taken out."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_hide(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _hide(v, kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _hide(v, kind.elementType))
    return mask_value(value) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)


def _as_text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else value


def mask_columns(table: DataFrame) -> DataFrame:
    """Mask sensitive columns of a table and sensitive parts of its nested columns, whatever their types.

    Maps of numbers or arrays become ``MAP<STRING,STRING>``; below a secret key of a map of maps or
    structs all text is masked and the rest is taken out.
    """
    return table.select(
        *[
            (mask_value(_as_text(F.col(f.name), f.dataType)) if _sensitive_name(f.name) else _mask(F.col(f.name), f.dataType)).alias(f.name)
            for f in table.schema.fields
        ]
    )
