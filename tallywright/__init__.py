"""Ledger quality and recency operators for Spark DataFrames."""

from tallywright.contracts import LedgerColumns, RecencyWindows, SourceContract

__all__ = ["LedgerColumns", "RecencyWindows", "SourceContract"]
