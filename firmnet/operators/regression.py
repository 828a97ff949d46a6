"""R² of each focal metric on its rivals' mean and the monopolist flag, from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmnet.schemas import METRICS, REPORT_LABELS

_FLAT = "1e-12D"  # relative size below which a variance or determinant counts as zero


def _moments(metric: str, flag: str) -> list[Column]:
    """Variances and covariances of target y, predictor x and flag m over the rows that have all three."""
    of = {"y": f"CAST(focal_{metric} AS DOUBLE)", "x": f"CAST(rival_{metric} AS DOUBLE)", "m": f"CAST({flag} AS DOUBLE)"}
    complete = f"FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in of.values())})"
    aggs = {a + a: f"var_pop({of[a]})" for a in "yxm"}
    aggs |= {a + b: f"covar_pop({of[a]}, {of[b]})" for a, b in ("xy", "my", "xm")}
    aggs |= {"n": "count(*)", "ay": f"max(abs({of['y']}))", "ax": f"max(abs({of['x']}))"}
    return [F.expr(f"{sql} {complete}").alias(f"{metric}_{name}") for name, sql in aggs.items()]


def _r2(metric: str) -> Column:
    """Least squares with intercept, written out for two predictors.

    A predictor that does not vary, or that repeats the other one, adds nothing and is left out. A
    target that does not vary is fitted exactly by the intercept: 1.
    """
    yy, xx, mm, xy, my, xm, n, ay, ax = (
        f"{metric}_{name}" for name in ("yy", "xx", "mm", "xy", "my", "xm", "n", "ay", "ax"))
    flat_x, flat_m = f"{xx} <= {_FLAT} * {ax} * {ax}", f"{mm} <= {_FLAT}"
    det = f"({xx} * {mm} - {xm} * {xm})"
    only_x = f"try_divide({xy} * {xy}, {xx} * {yy})"
    only_m = f"try_divide({my} * {my}, {mm} * {yy})"
    fitted = f"({xy} * {xy} * {mm} - 2D * {xy} * {my} * {xm} + {my} * {my} * {xx})"
    return F.expr(f"""CASE WHEN {n} = 0 THEN CAST(NULL AS DOUBLE)
                           WHEN {yy} <= {_FLAT} * {ay} * {ay} THEN 1D
                           WHEN {flat_x} AND {flat_m} THEN 0D
                           WHEN {flat_m} THEN {only_x}
                           WHEN {flat_x} THEN {only_m}
                           WHEN {det} <= {_FLAT} * {xx} * {mm} THEN {only_x}
                           ELSE try_divide({fitted}, {det} * {yy}) END""")


def r_squared(df: DataFrame, by: Sequence[str] = (), flag: str = "monopolist") -> DataFrame:
    """One row per ``by`` group with ``no_of_docs`` and the R² of the four metrics and of profits on average."""
    aggs = [agg for m in METRICS for agg in _moments(m, flag)]
    stats = df.groupBy(*by).agg(F.countDistinct("focal_firmid").alias("no_of_docs"), *aggs)
    scored = stats.select(*by, "no_of_docs", *(_r2(m).alias(m) for m in METRICS))
    return scored.select(
        *by,
        "no_of_docs",
        ((F.col("profit_sales") + F.col("profit_assets")) / 2).alias("RSQ_average"),
        F.col("stock_return").alias("RSQ_stock_return"),
        F.col("profit_sales").alias("RSQ_profit_sales"),
        F.col("profit_assets").alias("RSQ_profit_asset"),
        F.col("valuation").alias("RSQ_valuation"),
    )


def similarity_label(input_name: Column) -> Column:
    """First ``_`` part of the input's name, dots removed, in upper case."""
    return F.upper(F.replace(F.split_part(input_name, F.lit("_"), F.lit(1)), F.lit("."), F.lit("")))


def _labelled(scores: DataFrame) -> DataFrame:
    """R² rows with their labels, in the published order of keys."""
    name = F.col("input_file_name")
    return scores.select(
        F.col("no_of_docs").cast("string").alias("no_of_docs"),
        name,
        F.date_format(F.current_timestamp(), "EEE MMM d HH:mm:ss yyyy").alias("date_run"),
        similarity_label(name).alias("similarity"),
        *(F.lit(value).alias(key) for key, value in REPORT_LABELS.items()),
        "RSQ_average", "RSQ_stock_return", "RSQ_profit_sales", "RSQ_profit_asset", "RSQ_valuation",
    )


def r2_report(df: DataFrame, input_name: str) -> DataFrame:
    """The row of one input."""
    return _labelled(r_squared(df).withColumn("input_file_name", F.lit(input_name)))


def r2_reports(df: DataFrame) -> DataFrame:
    """A row for each input, told apart by ``input_file_name``."""
    return _labelled(r_squared(df, ("input_file_name",)))
