"""Two-sided completeness: does every sample have exactly one score, and every score a sample?

The keys of a side are digested without regard to order: their number and the sums of two
64-bit hashes, one aggregation without a shuffle of keys. Equal digests end the check. Only
when they differ are the keys counted on both sides and compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.schemas import require_columns

# Seeds of the two hashes.
SEEDS = (0, 1)
EXAMPLES = 5


def _digest(keys: Sequence[str]) -> list[Column]:
    # a null is told apart from the absence of a value by a flag
    own = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    return [F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.sum(F.xxhash64(F.lit(seed), *own).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias(f"h{seed}")
        for seed in SEEDS]]


def key_digest(df: DataFrame, keys: Sequence[str]) -> tuple:
    """(rows, sum of one hash, sum of another) of the keys, as a multiset."""
    require_columns(df, keys)
    return tuple(df.select(*keys).agg(*_digest(keys)).first())


def _same_types(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``right``'s keys in the types of ``left``'s: hashes follow the type."""
    return right.select(*[F.col(k).cast(left.schema[k].dataType).alias(k) for k in keys])


def key_counts(samples: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_samples, n_scores): how often each key occurs on both sides, combined map-side."""
    one = lambda df, a, b: df.select(*keys, F.lit(a).alias("__a"), F.lit(b).alias("__b"))
    both = one(samples.select(*keys), 1, 0).unionByName(one(_same_types(samples, scores, keys), 0, 1))
    return both.groupBy(*keys).agg(F.sum("__a").alias("n_samples"), F.sum("__b").alias("n_scores"))


def completeness(samples: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: n_samples, n_scores, complete, and the keys that are missing (sample without a
    score), extra (score without a sample) and repeated (more scores than samples)."""
    spark = samples.sparkSession
    names = ("n_missing", "n_extra", "n_repeated")
    a, b = key_digest(samples, keys), key_digest(_same_types(samples, scores, keys), keys)
    schema = "n_samples long, n_scores long, complete boolean, " + ", ".join(f"{n} long" for n in names)
    if a == b:
        return spark.createDataFrame([(a[0], b[0], True, 0, 0, 0)], schema)
    m, n = F.col("n_samples"), F.col("n_scores")
    found = key_counts(samples, scores, keys).agg(
        F.count_if(n < m).alias(names[0]), F.count_if(m == 0).alias(names[1]), F.count_if((m > 0) & (n > m)).alias(names[2]))
    return found.select(F.lit(a[0]).cast("long").alias("n_samples"), F.lit(b[0]).cast("long").alias("n_scores"),
                        F.lit(False).alias("complete"), *names)


def check_complete(samples: DataFrame, scores: DataFrame, keys: Sequence[str] = ("sample_id",)) -> None:
    """Raise ValueError, with examples, unless samples and scores hold the same keys equally often."""
    if key_digest(samples, keys) == key_digest(_same_types(samples, scores, keys), keys):
        return
    wrong = key_counts(samples, scores, keys).where("n_samples <> n_scores")
    total, some = wrong.count(), wrong.orderBy(*keys).limit(EXAMPLES).collect()
    shown = "; ".join(f"{', '.join(str(r[k]) for k in keys)}: {r['n_samples']} samples, {r['n_scores']} scores" for r in some)
    raise ValueError(f"samples and scores differ in {total} keys ({shown})")
