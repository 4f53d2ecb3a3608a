"""Normalising and casting raw text columns.

Contracts have dozens of columns, so each expression is written as SQL over a
column name: one call instead of one per function.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_LABEL = "<NULL>"

# Spark casts '2023' and '2023-01' to dates and '1d' to a double; ledgers must
# hold ISO dates and plain numbers, so text is matched before it is cast.
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
PLAIN_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def normalised(name: str) -> Column:
    """Trimmed text of a column, with empty text as NULL."""
    return F.expr(_normalised(name))


def null_label(name: str) -> Column:
    """Normalised text with NULL shown as a label, for grouping and display."""
    return F.expr(f"coalesce({_normalised(name)}, '{NULL_LABEL}')")


def lenient_cast(name: str, data_type: T.DataType) -> Column:
    """Normalise and cast, giving NULL for values that do not fit the type."""
    return F.expr(_lenient(_normalised(name), data_type))


def strict_cast(name: str, data_type: T.DataType, label: str) -> Column:
    """Normalise and cast, failing the job on a value that does not fit the type."""
    text = _normalised(name)
    if isinstance(data_type, T.StringType):
        return F.expr(text)
    kind = data_type.simpleString()
    message = f"concat('{label} holds a value that is not {kind}: ', {text})"
    refused = f"CASE WHEN {text} IS NOT NULL THEN raise_error({message}) END"
    return F.expr(f"coalesce({_lenient(text, data_type)}, CAST({refused} AS {kind}))")


def normalise_table(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as normalised text, each trimmed once for all that follows."""
    return raw.selectExpr(*[f"{_normalised(name)} AS {_quoted(name)}" for name in columns])


def lenient_table(raw: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Normalised text and, next to it as ``<name>__typed``, the leniently cast values."""
    return normalise_table(raw, list(types)).selectExpr(
        "*",
        *[
            f"{_lenient(_quoted(name), kind)} AS {_quoted(typed_name(name))}"
            for name, kind in types.items()
            if not isinstance(kind, T.StringType)
        ],
    )


def typed_name(name: str) -> str:
    """Name of the typed column next to a text column."""
    return f"{name}__typed"


def _quoted(name: str) -> str:
    return f"`{name}`"


def _normalised(name: str) -> str:
    return f"nullif(trim({_quoted(name)}), '')"


def _lenient(text: str, data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return text
    cast = f"try_cast({text} AS {data_type.simpleString()})"
    if isinstance(data_type, T.DateType):
        return f"CASE WHEN {text} RLIKE '{ISO_DATE}' THEN {cast} END"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN {text} RLIKE '{PLAIN_NUMBER}' THEN {cast} END"
    return cast
