"""Classification metrics from confusion counts.

Everything starts from ``confusion`` -- one aggregation to at most
groups x classes^2 rows -- so the per-class sums and averages work on
aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.operators.labels import label_decode
from escalade.schemas import require_columns


def confusion(df: DataFrame, gold: str = "gold_label", pred: str = "prediction",
              group: Sequence[str] = ("config",)) -> DataFrame:
    """Counts per (group, gold, pred); rows with a column ``n`` stand for n answers."""
    require_columns(df, [*group, gold, pred])
    count = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return df.groupBy(*group, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(count.alias("n"))


def per_class(conf: DataFrame, group: Sequence[str] = ("config",)) -> DataFrame:
    """(group, label, tp, support, predicted) over labels seen as gold or prediction."""
    contrib = F.array(
        F.struct(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))
    x = conf.select(*group, F.explode(contrib).alias("c")).select(*group, "c.*")
    return x.groupBy(*group, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                          F.sum("predicted").alias("predicted"))


def _prf(pc: DataFrame) -> DataFrame:
    """precision / recall / f1 with zero_division = 0."""
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    pc = pc.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when((F.col("precision") + F.col("recall")) == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return pc.withColumn("f1", f1)


def macro_f1(df: DataFrame, gold: str = "gold_label", pred: str = "prediction",
             group: Sequence[str] = ("config",)) -> DataFrame:
    """Accuracy and macro-F1 over the union of labels seen in gold or prediction."""
    pc = _prf(per_class(confusion(df, gold, pred, group), group))
    return pc.groupBy(*group).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"))


def macro_f1_fixed(df: DataFrame, labels: DataFrame, gold: str = "gold_label", pred: str = "prediction",
                   group: Sequence[str] = ("config",)) -> DataFrame:
    """Macro-F1 over a fixed label set (``labels.label_id``); predictions
    outside it (e.g. -1 'unknown') count as misses but are not a class.

    A class of the set that never occurs has F1 = 0, so the macro average is
    the sum of F1 over occurring classes of the set divided by the set size.
    """
    conf = confusion(df, gold, pred, group)
    ids = labels.select(F.col("label_id").alias("label"))
    n_labels = labels.select(F.count(F.lit(1))).scalar()
    pc = _prf(per_class(conf, group).join(ids, "label", "left_semi"))
    acc = conf.groupBy(*group).agg((F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
                                    / F.sum("n")).alias("accuracy"))
    f1 = pc.groupBy(*group).agg((F.sum("f1") / n_labels).alias("f1_macro"))
    return acc.join(f1, list(group), "left").fillna(0.0, ["f1_macro"])


def _row(name: str, p: str, r: str, f: str):
    return F.struct(F.lit(name).alias("class"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1"), F.col("n").alias("support"))


def classification_report(df: DataFrame, dictionary: DataFrame, gold: str = "gold_label",
                          pred: str = "prediction", group: Sequence[str] = ("config",)) -> DataFrame:
    """Per class precision, recall, f1, support, then 'accuracy', 'macro avg'
    and 'weighted avg' rows; classes are those seen in gold or prediction."""
    pc = _prf(per_class(confusion(df, gold, pred, group), group))
    named = label_decode(pc, "label", dictionary, out="class")
    rows = named.select(*group, "class", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    tot = pc.groupBy(*group).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = F.col("tp") / F.col("n")
    extra = tot.select(*group, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1"), F.col("n").alias("support")),
        _row("macro avg", "mp", "mr", "mf"), _row("weighted avg", "wp", "wr", "wf"))).alias("r"))
    extra = extra.select(*group, "r.*")
    return rows.unionByName(extra)
