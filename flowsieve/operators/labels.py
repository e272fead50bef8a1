"""Label encoding, label dimensions and held-out families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import q


def label_dimension(train: DataFrame, label: str) -> DataFrame:
    """label, label_id: the sorted distinct labels of the training rows from 0."""
    distinct = train.select(q(label).cast("string").alias("label")).distinct()
    return distinct.withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)


def unseen_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Labels of test that train lacks."""
    return test.select(q(label).cast("string").alias("label")).subtract(train.select(q(label).cast("string").alias("label")))


def encode(df: DataFrame, dimension: DataFrame, label: str, strict: bool = True) -> DataFrame:
    """df plus label_id (J2). Strict: labels that the dimension lacks are an error. The dimension is broadcast if Spark
    finds it small, as it does for all joins here."""
    small = dimension.select(F.col("label").alias("_label"), "label_id")
    out = df.join(small, q(label).cast("string") == F.col("_label"), "left").drop("_label")
    if strict and (missing := [r[0] for r in out.where("label_id IS NULL").select(q(label)).distinct().limit(5).collect()]):
        raise ValueError(f"labels not seen in training: {missing}")
    return out


def map_labels(df: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """df plus the mapping's columns by raw label, null where it has none (J8); mapping: raw, family, ..."""
    return df.join(mapping, q(label) == mapping["raw"], "left").drop("raw")


def unmapped(df: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """Raw labels without a mapping and their counts."""
    return df.join(mapping, q(label) == mapping["raw"], "left_anti").groupBy(q(label).alias("raw")).agg(F.count(F.lit(1)).alias("n"))


def leave_families_out(df: DataFrame, held_out: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """(rows of other families, rows of the families held out) (J9); held_out: column `family`."""
    k = held_out.select(F.col("family").alias("_f"))
    on = q(family) == F.col("_f")
    return df.join(k, on, "left_anti"), df.join(k, on, "left_semi")
