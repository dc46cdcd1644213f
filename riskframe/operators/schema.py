"""Projections, filters and column-set rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import scalars

META_PREFIX = "__meta_"


def require_columns(df: DataFrame, cols: Iterable[str], min_rows: int = 0) -> DataFrame:
    """Return the frame, or raise with the list of missing columns or too few rows."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if min_rows and df.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} rows")
    return df


def drop_columns(df: DataFrame, names: Sequence[str] = (), name_contains: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in names or any(part in c for part in name_contains)])


def non_null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and non-NULL count of every column, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return row["_rows"], {c: row[c] for c in df.columns}


def prune_sparse_columns(df: DataFrame, min_ratio: float = 0.7, keep: Sequence[str] = ()) -> DataFrame:
    """Keep columns that are filled in at least ``min_ratio`` of rows, or listed."""
    rows, counts = non_null_counts(df)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep or counts[c] >= rows * min_ratio])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: scalars.to_double(F.col(f"`{c}`")) for c in cols})


def normalize_missing(df: DataFrame) -> DataFrame:
    """Spellings of "missing" become NULL in every text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: scalars.missing_to_null(F.col(f"`{c}`")) for c in text}) if text else df


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(scalars.to_double(F.col(f"`{target}`")).isNotNull())


class Named(NamedTuple):
    """What a column's name says: position of its day in time order, outcome or not, provenance or not."""

    name: str
    day: int | None
    outcome: bool
    provenance: bool


def parse_columns(columns: Iterable[str], prefixes: Sequence[str], outcomes: Iterable[str] = ()) -> dict[str, Named]:
    days, known = {p: i for i, p in enumerate(prefixes)}, set(outcomes)
    lead = re.compile("|".join(f"({re.escape(p)})_" for p in prefixes) or "(?!)")
    found = {c: lead.match(c) for c in columns}
    return {c: Named(c, days[m[0][:-1]] if m else None, c in known, c.startswith(META_PREFIX)) for c, m in found.items()}


# May a column be a feature of the target?  Rules per mode, for columns other than the target and provenance.
FEATURE_RULES = {
    "strict": lambda c, t: not (c.outcome and t.outcome),
    "all": lambda c, t: True,
    "temporal": lambda c, t: not c.outcome or None not in (c.day, t.day) and c.day < t.day,
}
FEATURE_RULES["strong_signal_temporal"] = FEATURE_RULES["temporal"]


def temporal_filter(columns: Sequence[str], target: str, prefixes: Sequence[str], strict_past_only: bool = True,
                    manual: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Kept and dropped features: dated columns must lie before the target's day (or on it)."""
    model = parse_columns(columns, prefixes)
    if unknown := sorted({target, *(manual or [])} - model.keys()):
        raise ValueError(f"columns not found: {unknown}")
    end = len(prefixes) if model[target].day is None else model[target].day + (not strict_past_only)
    parts = {True: [], False: []}
    for c in manual or columns:
        if c != target:
            parts[model[c].day is None or model[c].day < end].append(c)
    return parts[True], parts[False]


def select_features(columns: Sequence[str], target: str, outcomes: Sequence[str], prefixes: Sequence[str],
                    mode: str = "temporal") -> list[str]:
    """Feature names for a target by the rule of ``mode``; provenance columns never qualify."""
    if mode not in FEATURE_RULES:
        raise ValueError(f"unknown feature mode: {mode}")
    model = parse_columns([*columns, target], prefixes, outcomes)
    rule, goal = FEATURE_RULES[mode], model[target]
    return [c for c in columns if c != target and not model[c].provenance and rule(model[c], goal)]


def shared_features(columns: Sequence[str], targets: Sequence[str], outcomes: Sequence[str],
                    prefixes: Sequence[str], mode: str = "temporal") -> list[str]:
    """Features allowed for every target, in table order."""
    if not targets:
        return []
    common = set.intersection(*[set(select_features(columns, t, outcomes, prefixes, mode)) for t in targets])
    return [c for c in columns if c in common]


def align_union(frames: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Stack frames by name into one column order; absent columns are NULL."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.select(*[F.col(f"`{c}`") for c in columns]) if columns else stacked


def attach_provenance(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Add ``__meta_`` columns; a value is a constant or a Column."""
    return df.withColumns({
        f"{META_PREFIX}{k}": v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def infer_binary_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at least one number and no number other than 0 and 1."""
    checks = []
    for c in cols:
        v = scalars.to_double(F.col(f"`{c}`"))
        checks += [F.count(v).alias(f"n_{c}"), F.count_if(~v.isin(0.0, 1.0)).alias(f"bad_{c}")]
    row = df.agg(*checks).first()
    return [c for c in cols if row[f"n_{c}"] > 0 and row[f"bad_{c}"] == 0]


def round_binary_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: scalars.round_binary(F.col(f"`{c}`")) for c in cols if c in df.columns})


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], variable: str = "variable",
            value: str = "value") -> DataFrame:
    """One row per (id, column); the layout per-target work runs on."""
    typed = df.select(*ids, *[scalars.to_double(F.col(f"`{c}`")).alias(c) for c in cols])
    return typed.unpivot(list(ids), list(cols), variable, value)


def target_dim(df: DataFrame, dim: DataFrame, on: str = "target") -> DataFrame:
    """Add day, metric, name and tier of each target from the small dimension."""
    return df.join(F.broadcast(dim), on, "left")
