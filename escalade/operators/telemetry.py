"""Telemetry of recorded runs: samples of a resource joined with the time windows of runs.

A sample belongs to a run of its host whose window holds its time (both ends included).
Windows may overlap, nest and be of any length, so joining samples with runs directly could
multiply the two. Instead time is cut into buckets of a power of two microseconds and
a window becomes

* its two edge buckets, where samples are compared with the window one by one, and
* the whole buckets between, as at most two nodes a level of a binary hierarchy over the
  buckets: the nodes' summaries are added up, never their samples.

Samples are summed up once a bucket (map-side first) and the buckets' rows once a level, so
the work is samples + buckets x levels + runs x levels. The only product is of the samples
and the window ends that meet in one bucket of one host; ``bucket_bits`` sets its width.

Defined results: a run without samples, with a NULL in its key columns or with an end before its
start has n_samples 0 and NULLs; samples with a NULL host, time or value belong to no run;
samples of one time are ordered by ``key``; rows with one ``run_id`` are windows of one run, whose
samples are taken together (one that lies in two of them counts twice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.operators.profile import _place, time_micros
from escalade.session import materialize

BUCKET_BITS = 26  # 2^26 microseconds: some 67 seconds


def _summed() -> list[Column]:
    """Aggregates that join the summaries of parts of a run or of a bucket."""
    return [F.sum("n").alias("n"), F.sum("total").alias("total"),
            F.min_by("first", "first_at").alias("first"), F.min("first_at").alias("first_at"),
            F.max_by("last", "last_at").alias("last"), F.max("last_at").alias("last_at"), F.max("top").alias("top")]


def _nodes(lo: Column, hi: Column, levels: int) -> Column:
    """The hierarchy's nodes that make up the buckets lo..hi-1: array<struct<level, node>>.

    At level k the nodes left to cover are ceil(lo / 2^k) .. floor(hi / 2^k) - 1; an odd first node
    and an odd end are nodes of their own, everything else is covered a level higher.
    """
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1

    def level(k: Column) -> Column:
        a = F.call_function("shiftright", lo + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        b = F.call_function("shiftright", hi, k)
        ends = (F.when((a < b) & odd(a), a), F.when((a + odd(a).cast("long") < b) & odd(b), b - 1))
        return F.filter(F.array(*[F.struct(k.alias("level"), x.alias("node")) for x in ends]), lambda x: x["node"].isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), level))


def run_telemetry(samples: DataFrame, runs: DataFrame, host: str, ts: str, key: str, value: str, run_id: str,
                  start: str, end: str, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Per run: (run_id, n_samples, mean, first, last, greatest, footprint, peak) of the samples in its window.

    ``footprint`` is max(last - first, 0), ``peak`` max(greatest - first, 0): growth over the
    run's first sample. ``samples`` has (host, ts, key, value), ``runs`` (run_id, host, start, end).
    """
    if not 0 <= bucket_bits < 60:
        raise ValueError(f"bucket_bits must be in 0..59, not {bucket_bits}")
    bucket = lambda t: F.shiftright(t, bucket_bits)
    s = samples.where(F.col(host).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull()).select(
        F.col(host).alias("host"), time_micros(samples, ts).alias("t"), _place(samples, [ts, key]).alias("at"),
        F.col(value).cast("double").alias("v"))
    s = s.withColumn("b", bucket(F.col("t")))
    r = runs.select(F.col(run_id).alias("run"), F.col(host).alias("host"), time_micros(runs, start).alias("lo"),
                    time_micros(runs, end).alias("hi"))
    r = materialize(r.where(F.col("run").isNotNull() & F.col("host").isNotNull() & (F.col("lo") <= F.col("hi"))), "run-windows")

    one = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"),
           F.min_by("v", "at").alias("first"), F.min("at").alias("first_at"),
           F.max_by("v", "at").alias("last"), F.max("at").alias("last_at"), F.max("v").alias("top")]

    # the ends of a window: samples of its edge buckets, one by one
    edges = r.withColumn("b", F.explode(F.array_distinct(F.array(bucket(F.col("lo")), bucket(F.col("hi"))))))
    parts = s.join(edges, ["host", "b"]).where(F.col("t").between(F.col("lo"), F.col("hi"))).groupBy("run").agg(*one)

    # between them: whole buckets, as nodes of the hierarchy up to the widest window's level
    inner = r.withColumns({"a": bucket(F.col("lo")) + 1, "z": bucket(F.col("hi"))}).where(F.col("a") < F.col("z"))
    widest = inner.agg(F.max(F.col("z") - F.col("a")).alias("w")).first()["w"]
    if widest:
        levels = int(widest).bit_length() - 1
        base = s.groupBy("host", "b").agg(*one)
        up = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))) \
            .withColumn("node", F.expr("shiftright(b, level)")).groupBy("host", "level", "node").agg(*_summed())
        asked = inner.select("run", "host", F.inline(_nodes(F.col("a"), F.col("z"), levels)))
        parts = parts.unionByName(asked.join(up, ["host", "level", "node"]).groupBy("run").agg(*_summed()))
    found = parts.groupBy("run").agg(*_summed())

    grow = lambda x: F.greatest(F.col(x) - F.col("first"), F.lit(0.0))
    rows = runs.select(F.col(run_id).alias("run")).distinct().join(found, "run", "left")
    return rows.select(
        F.col("run").alias(run_id), F.coalesce("n", F.lit(0).cast(T.LongType())).alias("n_samples"),
        (F.col("total") / F.col("n")).alias("mean"), "first", "last", F.col("top").alias("greatest"),
        F.when(F.col("first").isNotNull(), grow("last")).alias("footprint"),
        F.when(F.col("first").isNotNull(), grow("top")).alias("peak"))
