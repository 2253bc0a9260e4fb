"""Probability-vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Stable softmax: exp(x - max) / sum, element-wise over the array."""
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(proba: Column) -> Column:
    """0-based index of the first maximum (ties go to the lowest index)."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def confidence(proba: Column, checked: bool = True) -> Column:
    """Max class probability.

    With ``checked`` the row fails (``raise_error``) when the vector is NULL,
    empty, or its maximum is outside [0, 1] -- NaN included, since
    ``NaN between 0 and 1`` is false.
    """
    m = F.array_max(proba)
    if not checked:
        return m
    bad = proba.isNull() | (F.size(proba) == 0) | m.isNull() | ~m.between(0.0, 1.0)
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid probability vector: "),
                                              F.coalesce(F.to_json(proba), F.lit("null")))
                                     )).otherwise(m)


def round_array(proba: Column, dp: int) -> Column:
    return F.transform(proba, lambda x: F.round(x, dp))


def one_hot(idx: Column, n_classes: int) -> Column:
    """array<double> with 1.0 at ``idx`` (0-based) and 0.0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda i: F.when(i == idx, F.lit(1.0)).otherwise(F.lit(0.0)))


def pseudo_proba(idx: Column, n_classes: int, unparsed: str = "uniform") -> Column:
    """Probability vector for a parsed label id; -1 (unparsed) gives uniform
    1/N (``unparsed='uniform'``) or all zeros (``unparsed='zero'``)."""
    if unparsed not in ("uniform", "zero"):
        raise ValueError("unparsed must be 'uniform' or 'zero'")
    fill = 1.0 / n_classes if unparsed == "uniform" else 0.0
    return F.when((idx < 0) | idx.isNull(), F.array_repeat(F.lit(fill), n_classes)) \
        .otherwise(one_hot(idx, n_classes))


def proba_dense(class_map: Column, n_classes: int) -> Column:
    """map<int,double> (class -> p) to a dense vector ordered by class index;
    a missing class fails the row."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda i: F.coalesce(F.element_at(class_map, i),
                             F.raise_error(F.concat(F.lit("missing class "), i.cast("string")))))
