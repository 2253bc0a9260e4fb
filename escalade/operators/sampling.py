"""Exact stratified split and few-shot pools.

Randomness is a seeded hash of the row key (``md5(seed:key)``), so results
are deterministic, reproducible across engines and independent of
partitioning. The split never ranks a whole class in one task and never moves
the rows: counts per leading hex digits of the hash find each class's boundary
bucket, only that bucket's places are ranked, and the resulting last place per
class is compared with each row's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.session import materialize

BUCKET_HEX_DIGITS = 3  # 4,096 buckets


def hash_key(key: Column, seed: int | str) -> Column:
    """Hex string: the row's position in the seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_split(df: DataFrame, label_col: str, key_col: str, test_ratio: float, seed: int = 42,
                     group_col: str | None = None) -> DataFrame:
    """Adds ``split`` ('train'/'test') with an exact test quota per class.

    Test size is ceil(n * ratio), shared among classes in proportion to
    their size by largest remainder (ties by class). A class with fewer than
    2 rows, a test set smaller than the number of classes, or a row without
    a label is an error, raised when the plan is built.

    With ``group_col`` (e.g. a hash of the text) whole groups are allotted
    within a class, in seeded group order, while the quota is not yet met:
    copies of one class never straddle the split (the same text under two
    labels may), and a class's test part exceeds its quota by less than the
    size of one group.
    """
    if not 0.0 < test_ratio < 1.0:
        raise ValueError("test_ratio must be in (0, 1)")
    last = _last_test_keys(df, label_col, key_col, test_ratio, seed, group_col)
    if not last:
        return df.withColumn("split", F.lit("train"))
    # one row per class: a bounded table
    bounds = F.broadcast(df.sparkSession.createDataFrame(
        [(c, k) for c, k in last.items()], T.StructType([df.schema[label_col], T.StructField("__last", T.StringType())])
    ).withColumnRenamed(label_col, "__class"))
    j = df.join(bounds, F.col(label_col) == F.col("__class"), "left")
    is_test = _place(df, key_col, seed, group_col) <= F.col("__last")
    return j.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("__class", "__last")


def _place(df: DataFrame, key_col: str, seed: int, group_col: str | None) -> Column:
    """A row's (or its group's) place in the seeded order; never NULL."""
    unit = F.coalesce(F.col(group_col or key_col).cast("string"), F.lit(""))
    return F.concat(hash_key(unit, seed), F.lit(":"), unit)


def _quotas(size: dict, label_col: str, test_ratio: float) -> dict:
    """Test rows of each class: ceil(n * ratio) shared by largest remainder, ties by class."""
    if None in size:
        raise ValueError(f"{size[None]} rows have no {label_col}")
    total = sum(size.values())
    n_test = math.ceil(total * test_ratio)
    if min(size.values()) < 2:
        raise ValueError("a class has fewer than 2 rows")
    if n_test < len(size):
        raise ValueError("test set smaller than the number of classes")
    exact = {c: n_test * n / total for c, n in size.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    spare = n_test - sum(quota.values())
    for c in sorted(size, key=lambda c: (quota[c] - exact[c], c))[:spare]:
        quota[c] += 1
    return quota


def _last_test_keys(df: DataFrame, label_col: str, key_col: str, test_ratio: float, seed: int,
                    group_col: str | None) -> dict:
    """Per class the last place in the seeded order that belongs to the test part.

    Counts per (class, bucket), at most 4,096 rows a class, are written; their running sums
    give each class's boundary bucket, and only the places in boundary buckets are ranked.
    The driver sees one row a class.
    """
    keyed = df.select(F.col(label_col).alias("__class"), _place(df, key_col, seed, group_col).alias("__h"))
    bucket = F.substring("__h", 1, BUCKET_HEX_DIGITS).alias("__b")
    counts = materialize(keyed.groupBy("__class", bucket).agg(F.count(F.lit(1)).alias("__c")), "split-buckets")
    size = {r["__class"]: r["n"] for r in counts.groupBy("__class").agg(F.sum("__c").alias("n")).collect()}
    if not size:
        return {}
    quota = _quotas(size, label_col, test_ratio)
    quotas = F.broadcast(df.sparkSession.createDataFrame(list(quota.items()), T.StructType([
        T.StructField("__class", df.schema[label_col].dataType), T.StructField("__quota", T.LongType())])))  # one row per class
    by_bucket = Window.partitionBy("__class").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    open_ = counts.withColumn("__upto", F.sum("__c").over(by_bucket)).join(quotas, "__class") \
        .where((F.col("__upto") >= F.col("__quota")) & (F.col("__upto") - F.col("__c") < F.col("__quota"))) \
        .select("__class", "__b", (F.col("__quota") - F.col("__upto") + F.col("__c")).alias("__need"))
    inside = keyed.withColumn("__b", bucket).join(F.broadcast(open_), ["__class", "__b"]) \
        .groupBy("__class", "__need", "__h").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("__class").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)
    ends = inside.withColumn("__before", F.sum("c").over(w) - F.col("c")).where(F.col("__before") < F.col("__need")) \
        .groupBy("__class").agg(F.max("__h").alias("__h")).collect()
    return dict.fromkeys(quota, "") | {r["__class"]: r["__h"] for r in ends}


def group_split(df: DataFrame, label_col: str, group_col: str, test_ratio: float, seed: int = 42) -> DataFrame:
    """Adds ``split`` ('train'/'test'): whole groups, also those with rows of several classes.

    Groups come in seeded order. A class is open until its test rows reach its quota (shared as in
    ``stratified_split``), and a group goes to the test part if all its classes are open. So
    no group is on both sides, no class passes its quota by a whole group, and a class stays
    short of it only if every later group of it holds rows of a full class. A NULL group is one group.

    A class that is full at some place in the order takes no group beyond, so a group is in the test part if
    its place is at or before the last place of each of its classes. These places are found class by
    class, each by counts per hash bucket and by ranks inside one bucket. Rows move only where
    they meet a group between the first and the last of these places.
    """
    if not 0.0 < test_ratio < 1.0:
        raise ValueError("test_ratio must be in (0, 1)")
    place = _place(df, group_col, seed, group_col)
    long = df.groupBy(F.col(label_col).alias("__class"), place.alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    long = materialize(long, "split-groups")
    size = {r["__class"]: r["n"] for r in long.groupBy("__class").agg(F.sum("__n").alias("n")).collect()}
    if not size:
        return df.withColumn("split", F.lit("train"))
    quota = _quotas(size, label_col, test_ratio)
    last = {c: "" for c, q in quota.items() if q == 0}
    taken, at = dict.fromkeys(quota, 0), ""
    while len(last) < len(quota):
        rest = long.where(F.col("__h") > at)
        if last:  # without groups of full classes
            full = rest.where(F.col("__class").isin(list(last))).select("__h").distinct()
            rest = rest.join(full, "__h", "left_anti")
        need = F.create_map(*[F.lit(x) for c, q in quota.items() if c not in last for x in (c, q - taken[c])])
        found = _first_full(rest, need)
        if found is None:
            last.update({c: "~" for c in quota if c not in last})  # after every place: all groups left are taken
            break
        for r in rest.where(F.col("__h") <= found).groupBy("__class").agg(F.sum("__n").alias("n")).collect():
            taken[r["__class"]] += r["n"]
        at = found
        last.update({c: at for c in quota if c not in last and taken[c] >= quota[c]})
    lasts = df.sparkSession.createDataFrame(list(last.items()), T.StructType([
        T.StructField("__class", df.schema[label_col].dataType), T.StructField("__last", T.StringType())]))  # one row per class
    low, high = min(last.values()), max(last.values())
    # only between the first and the last of these places do a group's classes disagree
    barred = long.where((F.col("__h") > low) & (F.col("__h") <= high)).join(F.broadcast(lasts), "__class") \
        .where(F.col("__h") > F.col("__last")).select(F.col("__h").alias("__barred")).distinct()
    j = df.withColumn("__h", place).join(barred, F.col("__h") == F.col("__barred"), "left")
    is_test = (F.col("__h") <= high) & F.col("__barred").isNull()
    return j.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("__h", "__barred")


def _first_full(groups: DataFrame, need: Column) -> str | None:
    """The first place at which some class of ``groups`` (__class, __h, __n) has the rows it needs."""
    b = F.substring("__h", 1, BUCKET_HEX_DIGITS).alias("__b")
    upto = F.sum("__n").over(Window.partitionBy("__class").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    sums = groups.groupBy("__class", b).agg(F.sum("__n").alias("__n")).withColumn("__upto", upto)
    first = sums.where(F.col("__upto") >= need[F.col("__class")]).agg(F.min("__b").alias("b")).first()["b"]
    if first is None:
        return None
    before = {r["__class"]: r["n"] for r in groups.where(b < first).groupBy("__class").agg(F.sum("__n").alias("n")).collect()}
    done = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    had = F.coalesce(done[F.col("__class")], F.lit(0)) if before else F.lit(0)
    inside = F.sum("__n").over(Window.partitionBy("__class").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0))
    ranked = groups.where(b == first).withColumn("__upto", inside + had)
    return ranked.where(F.col("__upto") >= need[F.col("__class")]).agg(F.min("__h").alias("h")).first()["h"]


def few_shot_sampled(df: DataFrame, label_col: str, key_col: str, k: int, seed: int = 0,
                     labels: list[str] | None = None) -> DataFrame:
    """At most ``k`` rows per class without replacement, in seeded random
    order (``rank`` 1..k); classes outside ``labels`` are ignored.
    A per-class top-k window: Spark limits it map-side before the shuffle."""
    if k <= 0:
        return df.limit(0).withColumn("rank", F.lit(0))
    d = df if labels is None else df.where(F.col(label_col).isin(labels))
    h = F.concat(hash_key(F.col(key_col), seed), F.lit(":"), F.col(key_col).cast("string"))
    w = Window.partitionBy(label_col).orderBy(h)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def few_shot_head(df: DataFrame, label_col: str, order_col: str, k: int,
                  labels: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows per class in corpus order (``rank`` 1..k)."""
    if k <= 0:
        return df.limit(0).withColumn("rank", F.lit(0))
    d = df if labels is None else df.where(F.col(label_col).isin(labels))
    w = Window.partitionBy(label_col).orderBy(order_col)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
