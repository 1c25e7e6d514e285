"""Who may see what: scopes, fresh snapshots, search filters, and rows whose evidence is all visible.

These come before any statistics, so that no document frequency or average length tells of hidden rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(context: Sequence[str], scopes: str = "acl_scopes") -> Column:
    """True if a row's scopes are all among the context's; rows without scopes are open, null scopes are hidden."""
    return F.coalesce(F.size(F.array_except(F.col(scopes), F.array(*map(F.lit, context)).cast("array<string>"))) == 0, F.lit(False))


def fresh(now: Column) -> Column:
    """Of a snapshot: configured, or captured by now and not yet expired."""
    return F.coalesce(F.col("configuration_owned") | ((F.col("captured_at") <= now) & (F.col("expires_at") > now)), F.lit(False))


def visible(units: DataFrame, context: Sequence[str], snapshots: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Rows that the context may see; with snapshots, those whose snapshot is fresh (a missing one is not)."""
    out = units.where(scoped(context))
    if snapshots is not None:
        live = snapshots.where(fresh(now if now is not None else F.current_timestamp())).select(F.col("id").alias("acl_snapshot_id"))
        out = out.join(live, "acl_snapshot_id", "left_semi")
    return out


def filtered(units: DataFrame, **wanted: Sequence[str]) -> DataFrame:
    """Rows whose columns have one of the values asked for; an empty list asks for nothing."""
    for column, values in wanted.items():
        if values:
            units = units.where(F.col(column).isin(list(values)))
    return units


def fully_evidenced(rows: DataFrame, key: str, evidence: DataFrame, units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Rows without a piece of evidence outside ``units``: relational division by two anti joins. No evidence is fine."""
    hidden = evidence.join(units.select(unit), unit, "left_anti").select(key).distinct()
    return rows.join(hidden, key, "left_anti")


def valid_at(now: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity, null for unbounded."""
    return (F.col(start).isNull() | (F.col(start) <= now)) & (F.col(end).isNull() | (F.col(end) > now))


def overlap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Half-open intervals that share a moment; null for unbounded."""

    def before(end: Column, start: Column) -> Column:
        return F.coalesce(end <= start, F.lit(False))

    return ~before(a[1], b[0]) & ~before(b[1], a[0])
