"""Decision results, decision logs and profile files: writers and readers.

Writers are ``DataFrameWriter`` calls (one task per partition, no driver
collection). Readers use an explicit schema (never inference: a text
``correct`` column would turn "False" into true) and derive the config name
and thresholds from the file path with ``regexp_extract``.
"""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.schemas import DECISION_COLUMNS, DECISION_SCHEMA, PROFILE_COLUMNS, PROFILE_SCHEMA, require_columns

# Fixed value: thresholds parsed from a configuration name (searched, not anchored at the start).
CONFIG_THETA_PATTERN = r"pipeline_theta1_(\d+\.\d+)_theta2_(\d+\.\d+)$"

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("sample_id", T.StringType()),
    T.StructField("tier_used", T.IntegerType()),
    T.StructField("correct", T.BooleanType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("bytes_sent", T.IntegerType()),
])


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under ``path`` on any Hadoop file system (local, HDFS, object store)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p)]


def save_results(decisions: DataFrame, path: str, fmt: str = "csv") -> None:
    """Overwrite one directory per configuration (``config=<name>/``).

    Only the configurations present are replaced (dynamic partition
    overwrite). An empty input is an error.
    """
    require_columns(decisions, ["config", *DECISION_COLUMNS])
    # rows are counted while they are written (no second pass over the input)
    seen = Observation()
    w = (decisions.select("config", *DECISION_COLUMNS).observe(seen, F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config"))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    if not seen.get["n"]:
        raise ValueError("no results to save")


def with_thetas(df: DataFrame, config_col: str = "config") -> DataFrame:
    """theta1/theta2 parsed from the config name; NULL when it does not match."""
    def grab(i):
        s = F.regexp_extract(F.col(config_col), CONFIG_THETA_PATTERN, i)
        return F.when(s == "", F.lit(None)).otherwise(s).cast("double")
    return df.withColumn("theta1", grab(1)).withColumn("theta2", grab(2))


def load_results(spark: SparkSession, path: str, pattern: str = "*", fmt: str = "csv") -> DataFrame:
    """Decisions of every configuration under ``path`` whose directory or
    file stem matches ``pattern``: DECISION columns + config, theta1, theta2.

    Two layouts: partition directories ``config=<name>`` (as written by
    ``save_results``) or flat files ``<name>.csv``. No file -> error.
    """
    schema = DECISION_SCHEMA
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    entries = [e for e in list_names(spark, path) if not e.startswith((".", "_"))]
    partitioned = any(e.startswith("config=") for e in entries)
    glob = pattern if pattern.endswith(f".{fmt}") else f"{pattern}.{fmt}"
    if not entries:
        raise FileNotFoundError(f"{path} holds no results")
    if partitioned:
        df = reader.schema(T.StructType(schema.fields + [T.StructField("config", T.StringType())])) \
            .option("basePath", path).format(fmt).load(os.path.join(path, f"config={pattern}"))
    else:
        df = reader.option("pathGlobFilter", glob).format(fmt).load(path)
        df = df.withColumn("config", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1))
    shown = [fnmatch.fnmatch(e.removeprefix("config=") if partitioned else e, pattern if partitioned else glob) for e in entries]
    if not any(shown):
        raise FileNotFoundError(f"{path} holds no result of a configuration named like {pattern}")
    return with_thetas(df).select("config", "theta1", "theta2", *DECISION_COLUMNS)


def decision_log(decisions: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append (timestamp, sample_id, tier_used, correct, latency_ms, bytes_sent)
    rows as CSV with a header. With ``batch_id`` the rows go to their own
    ``batch_id=<n>`` partition, overwritten on replay, so a re-run batch is
    written once (idempotent), unlike a plain append."""
    rows = decisions.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                            F.col("sample_idx").cast("string").alias("sample_id"), "tier_used", "correct",
                            "latency_ms", "bytes_sent")
    if batch_id is None:
        rows.write.mode("append").option("header", True).csv(path)
    else:
        (rows.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").option("header", True).csv(path))


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("header", True).csv(path)


def profile_append(rows: DataFrame, path: str) -> None:
    """Append profile rows in the fixed 18-column order: missing columns are
    written empty, extra columns are dropped."""
    cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PROFILE_SCHEMA.fields]
    rows.select(*cols).write.mode("append").option("header", True).csv(path)


def profile_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of profile CSV files read **by position** with the fixed schema,
    so files whose header drifted (renamed or duplicated names) still land
    in the right columns; the header line itself is skipped."""
    out = None
    for p in paths:
        df = (spark.read.schema(PROFILE_SCHEMA).option("header", True).option("enforceSchema", True).csv(p)
              .withColumn("source_file", F.col("_metadata.file_name")))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise FileNotFoundError("no profile files")
    return out


def save_report(report: DataFrame, path: str, single_file: bool = True) -> None:
    """Overwrite a report (escalation rates, Pareto front, cost per config...)
    as CSV with a header.

    ``single_file`` writes one file: reports have one row per configuration. Set
    it off for a relation that grows with the data.
    """
    (report.coalesce(1) if single_file else report).write.mode("overwrite").option("header", True).csv(path)
