"""The label taxonomy as a literal dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The thirteen classes in order, and the review-only folders.
LABELS = ("bar", "bar_grouped", "bar_stacked", "waterfall", "line", "combo_bar_line", "pie_donut", "scatter", "flow", "map", "table", "photo", "other")
REVIEW_FOLDERS = ("_review", "_unsure", "_broken")
K = len(LABELS)
NONE = "__none__"


def dimension(spark: SparkSession) -> DataFrame:
    """(label_id, label): thirteen rows, always broadcast."""
    return spark.createDataFrame(list(enumerate(LABELS)), "label_id int, label string")


def label_at(i: Column) -> Column:
    """The label with 0-based number ``i``; null outside."""
    return F.try_element_at(F.array(*[F.lit(x) for x in LABELS]), (i + 1).cast("int"))


def known(label: Column) -> Column:
    return label.isin(*LABELS)


def id_of(label: Column) -> Column:
    """0-based number of a label; null when unknown."""
    at = F.array_position(F.array(*[F.lit(x) for x in LABELS]), label)
    return F.when(at > 0, (at - 1).cast("int"))


#: The same dimension for SQL.
SQL = "tax(label_id, label) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS)) + ")"
SQL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
