"""Label dictionaries, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.operators.indexing import positional_index

# Upper bound on the class names that are held outside a table (``collect_labels``).
MAX_CLASSES = 10_000


def label_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(label_id int, label string): distinct values, sorted, numbered from 0.

    Numbered by ranges (``positional_index``), so a column may have any number of values.
    """
    d = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return positional_index(d, ["label"], "label_id").select(F.col("label_id").cast("int").alias("label_id"), "label")


def fixed_dictionary(spark: SparkSession, labels: list[str]) -> DataFrame:
    """Dictionary from a fixed list: list position is the class id."""
    return spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "label_id int, label string")


def collect_labels(dictionary: DataFrame) -> list[str]:
    """The class names in id order, for models that hold a number per class; bounded (checked)."""
    rows = dictionary.orderBy("label_id").limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return [r["label"] for r in rows]


def label_encode(df: DataFrame, col: str, dictionary: DataFrame, out: str = "label_id",
                 strict: bool = True) -> DataFrame:
    """Replace names by ids via a join with the dictionary. Up to ``MAX_CLASSES`` names are
    broadcast: few classes would deal all rows to as few tasks.

    ``strict``: an unseen (non-null) label fails the job, as the fitted
    encoder does.
    """
    names = dictionary.select(F.col("label").alias("__l"), F.col("label_id").alias(out))
    if names.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES:
        names = F.broadcast(names)
    j = df.join(names, F.col(col) == F.col("__l"), "left")
    if strict:
        j = j.withColumn(out, F.when(F.col(col).isNotNull() & F.col(out).isNull(),
                                     F.raise_error(F.concat(F.lit("unseen label: "), F.col(col))))
                         .otherwise(F.col(out)))
    return j.drop("__l")


def label_decode(df: DataFrame, col: str, dictionary: DataFrame, out: str = "label") -> DataFrame:
    """id -> name; ids outside the dictionary (e.g. -1) become 'unknown'."""
    d = dictionary.select(F.col("label_id").alias("__id"), F.col("label").alias("__name"))
    return (df.join(d, F.col(col) == F.col("__id"), "left")
            .withColumn(out, F.coalesce(F.col("__name"), F.lit("unknown")))
            .drop("__id", "__name"))


def encode_with_list(col, labels: list[str], strict: bool = True):
    """Column: position of ``col`` in the (bounded) class list, 0-based.

    No join: the list is a literal. ``strict`` fails on an unseen label.
    """
    pos = (F.array_position(F.array(*[F.lit(l) for l in labels]), col) - 1).cast("int")
    if not strict:
        return pos
    return F.when(col.isNotNull() & (pos < 0),
                  F.raise_error(F.concat(F.lit("unseen label: "), col.cast("string")))).otherwise(pos)
