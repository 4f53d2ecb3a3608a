"""A row hash that does not depend on the engine that computes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the row text: any engine that writes rows this way gets the
# same hash. A separator inside a value is escaped, and NULL has its own mark.
SEPARATOR = "|"
ESCAPE = "\\"
NULL_MARK = "\\N"


def row_text(fields: Sequence[T.StructField]) -> Column:
    """The row as one line of text, distinct rows giving distinct lines."""
    parts = []
    for field in fields:
        text = F.col(field.name).cast("string")
        if isinstance(field.dataType, T.StringType):
            text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE))
            text = F.replace(text, F.lit(SEPARATOR), F.lit(ESCAPE + SEPARATOR))
        parts.append(F.coalesce(text, F.lit(NULL_MARK)))
    return F.concat_ws(SEPARATOR, *parts)


def row_hash(fields: Sequence[T.StructField]) -> Column:
    """First 60 bits of the MD5 of the row text, as a bigint."""
    digits = F.substring(F.md5(row_text(fields)), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")
