"""Search filters: checked on the driver, applied as column predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CONFIDENCE, STATUSES, suggest

SCALARS = ("type", "scope", "agent", "profile", "status", "confidence")
KEYS = (*SCALARS, "tags", "min_confidence")


class FilterError(ValueError):
    """A filter names something that does not exist."""


def _values(value: Any) -> list[str]:
    return [value] if isinstance(value, str) else [str(v) for v in value] if isinstance(value, Iterable) else [str(value)]


def check(filters: Mapping[str, Any] | None) -> dict[str, list[str]]:
    """Filters as lists; None values are ignored, anything unknown or empty is an error."""
    clean: dict[str, list[str]] = {}
    for key, value in (filters or {}).items():
        if value is None:
            continue
        if key not in KEYS:
            raise FilterError(f"unknown filter {key!r}{suggest(key, list(KEYS))}")
        clean[key] = _values(value)
        if not clean[key]:
            raise FilterError(f"filter {key!r} is an empty list")
        allowed = STATUSES if key == "status" else CONFIDENCE if key in ("confidence", "min_confidence") else None
        if bad := [v for v in clean[key] if allowed and v not in allowed]:
            raise FilterError(f"{key}: unknown value {bad[0]!r}{suggest(bad[0], list(allowed))}")
    return clean


def tags_all(tags: Column, wanted: list[str]) -> Column:
    """Every wanted tag is there."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def at_least(confidence: Column, floor: str) -> Column:
    """Confidence not below the floor; null and unknown levels never pass."""
    return confidence.isin(*CONFIDENCE[CONFIDENCE.index(floor) :])


def live(status: Column) -> Column:
    """Neither archived nor deprecated; no status counts as active."""
    return ~F.coalesce(status, F.lit("ativo")).isin("arquivado", "deprecado")


def apply(rows: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """Rows that pass all filters; without a status filter only live rows do."""
    clean = check(filters)
    for key, values in clean.items():
        if key in SCALARS:
            rows = rows.where(F.col(key).isin(values))
        elif key == "tags":
            rows = rows.where(tags_all(F.col("tags"), values))
        else:
            rows = rows.where(at_least(F.col("confidence"), values[0]))
    return rows if "status" in clean else rows.where(live(F.col("status")))


def metadata(rows: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Rows that pass filters on any columns: all of them, each by any of its values.

    A column of arrays passes if it holds one of the values.  A filter of None is
    ignored, an empty list is an error, and a column that does not exist passes nothing.
    """
    kinds = dict(rows.dtypes)
    for key, value in filters.items():
        if value is None:
            continue
        if not (wanted := _values(value)):
            raise FilterError(f"filter {key!r} is an empty list")
        if key not in kinds:
            rows = rows.where(F.lit(False))
        elif kinds[key].startswith("array"):
            rows = rows.where(F.arrays_overlap(F.col(key).cast("array<string>"), F.array(*map(F.lit, wanted))))
        else:
            rows = rows.where(F.col(key).cast("string").isin(wanted))
    return rows


def browse(notes: DataFrame, text: str = "", **equal: str | None) -> DataFrame:
    """Notes with equal fields and the text somewhere in title, id, agent or scope."""
    for key, value in equal.items():
        if value is not None:
            notes = notes.where(F.col(key) == value)
    return notes.where(F.contains(F.lower(F.concat_ws(" ", "title", "note_id", "agent", "scope")), F.lit(text.lower()))) if text else notes
