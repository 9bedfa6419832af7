"""Bounded, repeatable samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo FOLDS, is 0 (an id that is null is never trained on)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


#: Classes of the id's hash that a label's sample is drawn from, so that no task sorts all rows of a label.
CLASSES = 16


def per_label(rows: DataFrame, label: str, most: int, id_col: str = "doc_id", tie: str | None = None) -> DataFrame:
    """At most ``most`` rows of each label (up to rounding): those of lowest hash in each hash class of the id; ``tie`` orders rows of one id.

    Every task keeps only its own lowest rows of a class before the shuffle; ``rows`` should be ids and labels, without texts.
    """
    each = -(-most // CLASSES)
    part = F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(CLASSES))
    order = Window.partitionBy(label, "_class").orderBy(F.xxhash64(id_col), F.col(id_col), *([tie] if tie else []))
    return rows.withColumn("_class", part).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).drop("_rank", "_class")
