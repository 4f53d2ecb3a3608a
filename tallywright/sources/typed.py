"""Typed tables from raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallywright.contracts import LedgerColumns, SourceContract
from tallywright.functions.text import strict_cast
from tallywright.operators.repeats import flag_repeats
from tallywright.operators.rowkey import SOURCE_TAGS, number_rows
from tallywright.sources.scratch import stage


def typed_columns(raw: DataFrame, contract: SourceContract) -> DataFrame:
    """Every column with its declared type; a value that does not fit fails the job."""
    return raw.select(
        *[
            strict_cast(name, kind, f"{contract.key}.{name}").alias(name)
            for name, kind in contract.types.items()
        ]
    )


def typed_ledger(
    staged: DataFrame, contract: SourceContract, columns: LedgerColumns = LedgerColumns()
) -> DataFrame:
    """The ledger with types, names, sequential row key and repeat flag.

    ``staged`` is the staged raw ledger with its positions. The typed rows are
    written once; the flag and the key are then added by joins against short
    lists, so the rows themselves are not shuffled.
    """
    typed = staged.select(
        *[
            strict_cast(raw, contract.types[raw], f"{contract.key}.{raw}").alias(name)
            for name, raw in _raw_names(contract, columns).items()
        ],
        *SOURCE_TAGS,
    )
    flagged = flag_repeats(
        stage(typed, "typed_ledger"), columns.repeat_keys, columns.repeat_flag
    )
    return number_rows(flagged, columns.row_key)


def ledger_schema(
    contract: SourceContract, columns: LedgerColumns = LedgerColumns()
) -> T.StructType:
    """Names and types of the typed ledger, in order."""
    return T.StructType(
        [
            T.StructField(columns.row_key, T.LongType()),
            *[
                T.StructField(name, contract.types[raw])
                for name, raw in _raw_names(contract, columns).items()
            ],
            T.StructField(columns.repeat_flag, T.BooleanType()),
        ]
    )


def _raw_names(contract: SourceContract, columns: LedgerColumns) -> dict[str, str]:
    return {
        columns.customer: contract.id_column,
        columns.day: contract.day_column,
        columns.amount: contract.amount_column,
        columns.kind: contract.kind_column,
    }
