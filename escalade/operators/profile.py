"""Profile analytics over recorded runs: latency statistics, energy,
resource deltas, and the profile row that combines them.

Input rows are calls: (group, order keys..., value). The warm-up call (the
first in order) is excluded. Three scans, all hash aggregations: the first and
last call of a group; everything that compares with them, with a bracket
around the percentile from a quantile sketch; the exact percentile inside
the bracket. Tables with one row per group are joined as Spark sees fit by their size:
broadcast where there are few groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.session import materialize

# Accuracy of the quantile sketch (rank error 1 / SKETCH) and the half-width of the
# bracket that surely holds the wanted ranks.
SKETCH = 100_000
HALF_WIDTH = 3 / SKETCH


def time_micros(df: DataFrame, col: str) -> Column:
    """Microseconds of a time column; of one without a time zone, by the wall clock."""
    ts, kind = F.col(col), df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        return (F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000
                + F.minute(ts).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long"))
    return F.unix_micros(ts)


def _place(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable value per row. A (timestamp, integer) order is packed into a
    decimal, whose minimum is a hash aggregate; other orders compare as a struct."""
    kinds = [df.schema[c].dataType for c in order]
    if len(order) == 2 and isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType)) and isinstance(kinds[1], T.IntegralType):
        wide = (time_micros(df, order[0]).cast("decimal(19,0)") * F.lit(10).cast("decimal(2,0)")).cast("decimal(20,0)")
        return (wide * F.lit(1_000_000_000_000_000_000).cast("decimal(19,0)") + F.col(order[1])).cast("decimal(38,0)")
    return F.struct(*[F.col(c) for c in order])


def _ends(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """(group, first and last place) of each group; one row per group."""
    return df.groupBy(group).agg(F.min(_place(df, order)).alias("__first"), F.max(_place(df, order)).alias("__last"))


def call_stats(calls: DataFrame, group: str, order: Sequence[str], value: str, q: float = 0.95,
               ends: DataFrame | None = None) -> DataFrame:
    """Per group, in one pass beside the search for the ends: n_samples, mean, population
    std (after the warm-up call), first, last and greatest value, and the rows needed for
    the exact percentile."""
    ends = _ends(calls, group, order, value) if ends is None else ends
    j = calls.withColumn("__at", _place(calls, order)).join(ends, group)
    v = F.col(value)
    rest = F.when(F.col("__at") != F.col("__first"), v)
    return j.groupBy(group).agg(
        F.count(rest).alias("n_samples"), F.avg(rest).alias("mean_latency_ms"), F.stddev_pop(rest).alias("std_latency_ms"),
        F.max(F.when(F.col("__at") == F.col("__first"), v)).alias("first"),
        F.max(F.when(F.col("__at") == F.col("__last"), v)).alias("last"), F.max(v).alias("greatest"),
        F.percentile_approx(rest, _bracket(q), SKETCH).alias("__bracket"))


def _bracket(q: float) -> Column:
    return F.array(F.lit(max(0.0, q - HALF_WIDTH)), F.lit(min(1.0, q + HALF_WIDTH)))


def drop_first(df: DataFrame, group: str, order: Sequence[str], key: str) -> DataFrame:
    """Remove each group's first call (by ``order``; ties fall to the least ``key``)."""
    order = [*order, *([key] if key not in order else [])]
    first = df.groupBy(group).agg(F.min(_place(df, order)).alias("__first"))
    return df.join(first, group).where(_place(df, order) != F.col("__first")).drop("__first")


def exact_quantile(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, n, quantile): linear interpolation between order statistics
    (position q * (n - 1)), exact, without sorting whole groups.

    A quantile sketch brackets the wanted ranks; values below the bracket are only
    counted, and only the distinct values inside it, a share of 2 HALF_WIDTH of the
    rows beside ties, are ranked. Infinite and far-out values change nothing in that.
    """
    st = df.groupBy(group).agg(F.count(value).alias("__n"), F.percentile_approx(value, _bracket(q), SKETCH).alias("__bracket"))
    return _in_bracket(df, st, group, value, q)


def _in_bracket(df: DataFrame, st: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The exact quantile from ``st`` (group, __n, __bracket)."""
    pos = F.lit(q) * (F.col("__n") - 1)
    st = st.select(group, "__n", F.col("__bracket")[0].alias("__lo"), F.col("__bracket")[1].alias("__hi"), pos.alias("__pos"))
    d = df.select(group, F.col(value).alias("__v")).where(F.col(value).isNotNull()).join(st, group)
    # rows below the bracket fall into one class, shown by its greatest value, those above
    # into one, shown by its least: a wanted rank is at most one place outside the bracket
    side = F.when(F.col("__v") < F.col("__lo"), F.lit(-1)).when(F.col("__v") > F.col("__hi"), F.lit(1)).otherwise(F.lit(0))
    vals = d.groupBy(group, side.alias("__side"), F.when(side == 0, F.col("__v")).alias("__inside")).agg(
        F.count(F.lit(1)).alias("__c"), F.max("__v").alias("__top"), F.min("__v").alias("__least"), F.first("__n").alias("__n"), F.first("__pos").alias("__pos"))
    vals = vals.withColumn("__v", F.when(F.col("__side") < 0, F.col("__top")).otherwise(F.col("__least")))
    w = Window.partitionBy(group).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("__end", F.sum("__c").over(w))
    k0 = F.floor("__pos")
    covers = lambda k: (k >= F.col("__end") - F.col("__c")) & (k < F.col("__end"))
    agg = vals.groupBy(group).agg(
        F.first("__n").alias("n"), F.first("__pos").alias("__pos"), F.max(F.when(covers(k0), F.col("__v"))).alias("__v0"),
        F.max(F.when(covers(F.least(k0 + 1, F.col("__n") - 1)), F.col("__v"))).alias("__v1"))
    frac = F.col("__pos") - F.floor("__pos")
    # equal neighbours need no interpolation (and two infinities have none)
    mid = F.when((F.col("__v0") == F.col("__v1")) | (frac == 0), F.col("__v0")) \
        .otherwise(F.col("__v0") + (F.col("__v1") - F.col("__v0")) * frac)
    return agg.select(group, "n", mid.alias("quantile"))


def latency_stats(calls: DataFrame, group: str, order: Sequence[str], key: str, value: str,
                  q: float = 0.95) -> DataFrame:
    """Per group after the warm-up call: n_samples, mean, population std, p95 (linear)."""
    return _report(calls, group, order, value, q).select(
        group, "n_samples", "mean_latency_ms", "std_latency_ms", "p95_latency_ms")


def _report(calls: DataFrame, group: str, order: Sequence[str], value: str, q: float = 0.95) -> DataFrame:
    # two small tables (one row per group) are written, so that the calls are scanned three times in all
    ends = materialize(_ends(calls, group, order, value), "profile-ends")
    st = materialize(call_stats(calls, group, order, value, q, ends), "profile-stats")
    rest = calls.withColumn("__at", _place(calls, order)).join(ends, group) \
        .where(F.col("__at") != F.col("__first"))
    p = _in_bracket(rest, st.select(group, F.col("n_samples").alias("__n"), "__bracket"), group, value, q)
    return st.drop("__bracket").join(p.select(group, F.col("quantile").alias("p95_latency_ms")), group, "left")


def profile(calls: DataFrame, group: str, order: Sequence[str], value: str, q: float = 0.95,
            quality: DataFrame | None = None) -> DataFrame:
    """Per group: latency statistics, load time (the warm-up call), footprint and peak over it,
    and with ``quality`` (group, accuracy, f1_macro) the quality of the run's predictions."""
    r = _report(calls, group, order, value, q)
    out = r.select(group, "n_samples", "mean_latency_ms", "std_latency_ms", "p95_latency_ms",
                   F.col("first").alias("load_time_ms"),
                   F.greatest(F.col("last") - F.col("first"), F.lit(0.0)).alias("footprint"),
                   F.greatest(F.col("greatest") - F.col("first"), F.lit(0.0)).alias("peak"))
    if quality is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in ("accuracy", "f1_macro")})
    return out.join(quality.select(group, "accuracy", "f1_macro"), group, "left")


def energy(mean_latency_ms: Column, watts: float | Column) -> Column:
    """Energy per call in millijoules: (ms / 1000) s x W x 1000."""
    w = F.lit(float(watts)) if not isinstance(watts, Column) else watts
    return mean_latency_ms / F.lit(1000.0) * w * F.lit(1000.0)


def resource_delta(samples: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Per group: footprint = max(last - first, 0) and peak = max(max - first, 0)
    of a sampled resource (first/last by ``order``)."""
    ends = _ends(samples, group, order, value)
    j = samples.withColumn("__at", _place(samples, order)).join(ends, group)
    agg = j.groupBy(group).agg(F.max(F.when(F.col("__at") == F.col("__first"), F.col(value))).alias("__v0"),
                               F.max(F.when(F.col("__at") == F.col("__last"), F.col(value))).alias("__v1"),
                               F.max(value).alias("__max"))
    return agg.select(group, F.greatest(F.col("__v1") - F.col("__v0"), F.lit(0.0)).alias("footprint"),
                      F.greatest(F.col("__max") - F.col("__v0"), F.lit(0.0)).alias("peak"))


def load_time(calls: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """The warm-up (first) call's value per group."""
    ends = _ends(calls, group, order, value)
    j = calls.withColumn("__at", _place(calls, order)).join(ends, group)
    return j.groupBy(group).agg(F.max(F.when(F.col("__at") == F.col("__first"), F.col(value))).alias("load_time_ms"))
