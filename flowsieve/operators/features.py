"""Fitted feature specifications and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, q, to_double
from .profile import LABEL_LIKE, category_lists, impute_stats, profile, select_by_profile


def fit_spec(df: DataFrame, exclude: tuple[str, ...] = (), numeric_ratio: float = 0.9, max_categories: int = 80) -> dict:
    """{numeric: {column: {median, mean, std}}, categorical: {column: [values]}} of the rows given."""
    columns = [c for c in df.columns if c not in exclude and c.lower() not in LABEL_LIKE]
    kinds = {r["column_name"]: r["kind"] for r in select_by_profile(profile(df, columns), numeric_ratio, max_categories).collect()}
    numeric = [c for c in columns if kinds[c] == "numeric"]
    categorical = [c for c in columns if kinds[c] == "categorical"]
    if not numeric and not categorical:
        raise ValueError("no usable feature column")
    stats = {r["column_name"]: {k: r[k] for k in ("median", "mean", "std")} for r in impute_stats(df, numeric).collect()} if numeric else {}
    lists = {r["column_name"]: list(r["categories"]) for r in category_lists(df, categorical).collect()} if categorical else {}
    return {"numeric": stats, "categorical": lists}


def feature_names(spec: dict) -> list[str]:
    return [*spec["numeric"], *(f"{c}={v}" for c, values in spec["categorical"].items() for v in values)]


def transform(df: DataFrame, spec: dict, name: str = "features") -> DataFrame:
    """df plus one array: imputed and standardised numbers, then one-hot categories; a projection, no shuffle."""
    numbers = [(F.coalesce(finite(to_double(q(c))), F.lit(s["median"])) - s["mean"]) / s["std"] for c, s in spec["numeric"].items()]
    ones = [(F.coalesce(q(c).cast("string"), F.lit("nan")) == v).cast("double") for c, values in spec["categorical"].items() for v in values]
    return df.withColumn(name, F.array(*numbers, *ones))
