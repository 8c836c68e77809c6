"""A declarative list of cleaning steps folded into one logical plan.

Whether a step applies is decided before anything runs, against the schema and parameters
(or a small probe), because a lazy plan cannot fail half-way and continue.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from tidewell.operators import columns as cols
from tidewell.operators import duplicates, missing, outliers
from tidewell.operators.resample import resample


@dataclass(frozen=True)
class Ordering:
    """Row order for order-dependent steps, and the group it applies within."""

    order_by: tuple[str, ...] = ("timestamp",)
    partition_by: tuple[str, ...] = ()


@dataclass
class StepReport:
    operation: str
    applied: bool
    reason: str | None = None


@dataclass
class Cleaned:
    df: DataFrame
    report: list[StepReport] = field(default_factory=list)


class StepSkipped(ValueError):
    pass


Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Register ``DataFrame, params, Ordering -> DataFrame`` under a name."""

    def add(function: Step) -> Step:
        STEPS[name] = function
        return function

    return add


def _need(df: DataFrame, names: Sequence[str] | None) -> None:
    absent = [n for n in names or [] if n not in df.columns]
    if absent:
        raise StepSkipped(f"unknown column {', '.join(absent)}")


@step("drop_na")
def _drop_na(df, params, at):
    _need(df, params.get("subset"))
    return missing.drop_missing(df, params.get("subset"), params.get("how", "any"))


@step("fill_na")
def _fill_na(df, params, at):
    method, columns = params.get("method", "ffill"), params.get("columns")
    if method in ("ffill", "bfill"):
        _need(df, at.order_by)
        return missing.fill_along(df, at.order_by, at.partition_by, backward=method == "bfill")
    _need(df, columns)
    match method:
        case "value" if params.get("value") is not None:
            return missing.fill_value(df, params["value"], columns)
        case "mean":
            return missing.fill_mean(df, columns)
        case "median":
            return missing.fill_median(df, columns)
        case "mode":
            return missing.fill_mode(df, columns) if columns else df
    raise StepSkipped(f"no such fill: {method}")


@step("remove_duplicates")
def _remove_duplicates(df, params, at):
    _need(df, params.get("subset"))
    order = [c for c in at.order_by if c in df.columns]
    return duplicates.remove_duplicates(df, params.get("subset"), params.get("keep", "first"), order)


@step("remove_outliers")
def _remove_outliers(df, params, at):
    method, columns = params.get("method", "iqr"), params.get("columns")
    if method == "iqr":
        return outliers.remove_outliers_iqr(df, columns, params.get("sequential", True))
    if method == "zscore":
        return outliers.remove_outliers_zscore(df, columns, params.get("threshold", 3))
    return df


@step("normalize_timestamps")
def _normalize_timestamps(df, params, at):
    column = params.get("column", "timestamp")
    return cols.normalize_timestamps(df, column) if column in df.columns else df


@step("filter_rows")
def _filter_rows(df, params, at):
    column, condition = params.get("column"), params.get("condition")
    return cols.filter_rows(df, column, condition) if column and condition else df


@step("rename_columns")
def _rename_columns(df, params, at):
    return cols.rename_columns(df, params.get("mapping", {}))


@step("drop_columns")
def _drop_columns(df, params, at):
    return cols.drop_columns(df, params.get("columns", []))


@step("add_column")
def _add_column(df, params, at):
    if not params.get("column"):
        return df
    return cols.add_column(df, params["column"], params.get("value"), params.get("expression"))


@step("convert_type")
def _convert_type(df, params, at):
    if params.get("column") not in df.columns:
        return df
    return cols.convert_type(df, params["column"], params.get("dtype", "float"))


@step("resample")
def _resample(df, params, at):
    column = params.get("column", "timestamp")
    if column not in df.columns:
        return df
    order = [c for c in at.order_by if c in df.columns] or [column]
    values = [c for c in df.columns if c != column and c not in (*at.partition_by, *order)]
    return resample(
        df, column, params.get("freq", "1H"), params.get("method", "mean"),
        at.partition_by, params.get("values", values), order,
    )


@step("interpolate")
def _interpolate(df, params, at):
    _need(df, at.order_by)
    wanted = params.get("columns") or missing.numeric_columns(df)
    wanted = [c for c in wanted if c in df.columns and c not in (*at.order_by, *at.partition_by)]
    return missing.interpolate(df, wanted, at.order_by, at.partition_by, params.get("method", "linear"))


@step("clip_values")
def _clip_values(df, params, at):
    if params.get("column") not in df.columns:
        return df
    return cols.clip_values(df, params["column"], params.get("min"), params.get("max"))


@step("round_values")
def _round_values(df, params, at):
    return cols.round_values(df, params.get("columns"), params.get("decimals", 2))


# Step names of the batch job, which differ from the editor's in one place.
BATCH_STEPS = {
    "drop_na": "drop_na",
    "fill_na": "fill_na",
    "filter": "filter_rows",
    "rename_columns": "rename_columns",
    "drop_columns": "drop_columns",
    "add_column": "add_column",
}


def clean(
    df: DataFrame,
    operations: Sequence[Mapping],
    order_by: Sequence[str] = ("timestamp",),
    partition_by: Sequence[str] = (),
    on_error: str = "skip",
) -> Cleaned:
    """Apply ``[{"operation": name, "params": {...}}, ...]`` in order.

    With ``on_error="skip"`` a step that cannot apply is left out and reported; with
    ``"raise"`` it ends the job. An unknown name does nothing either way.
    """
    at = Ordering(tuple(order_by), tuple(partition_by))
    done = Cleaned(df)
    for op in operations:
        name = op.get("operation")
        if name not in STEPS:
            done.report.append(StepReport(str(name), False, "unknown operation"))
            continue
        try:
            done.df = STEPS[name](done.df, op.get("params", {}), at)
            done.report.append(StepReport(name, True))
        except (ValueError, TypeError, KeyError, AnalysisException) as bad:
            if on_error == "raise":
                raise
            done.report.append(StepReport(name, False, str(bad)))
    return done
