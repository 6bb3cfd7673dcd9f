"""Column selection and renaming; Catalyst carries it down to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tributary.functions.rowid import SYSTEM_COLUMNS
from tributary.types import destination_names


def selected(columns: list[str], chosen: list[str] | None, known: list[str] | None = None, sync_new: bool = True) -> list[str]:
    """Columns to keep: all without a choice; new ones (not in ``known``) too if they are synced; system columns always."""
    if not chosen:
        return list(columns)
    seen = set(known if known is not None else columns)
    return [c for c in columns if c in chosen or c in SYSTEM_COLUMNS or (sync_new and c not in seen)]


def project(df: DataFrame, chosen: list[str] | None, known: list[str] | None = None, sync_new: bool = True, keep_source_names: bool = True) -> DataFrame:
    kept = selected(df.columns, chosen, known, sync_new)
    names = destination_names(kept, keep_source_names)
    return df.select(*[df[f"`{c}`"].alias(names[c]) for c in kept])
