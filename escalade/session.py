"""Session helpers: configuration a cascade job expects from its session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins on measured sizes
# (broadcast only when the materialised side is small) and splits skewed
# partitions; the session time zone keeps timestamps engine-neutral.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # remove a checkpoint's files once the table it backs is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "escalade", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Scratch folders of local sessions, by application.
_LOCAL_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` (or the context's checkpoint folder)
    names a shared folder and is used as is; without one this is an error, as
    executors don't share a local folder. A ``local`` master gets a scratch folder.
    """
    sc = spark.sparkContext
    d = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
         or sc.getCheckpointDir() or _LOCAL_DIRS.get(sc.applicationId))
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="escalade-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder,
    in this application's own folder (see ``drop_scratch``)."""
    return os.path.join(ensure_checkpoint_dir(spark), f"escalade-{spark.sparkContext.applicationId}", name)


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; DataFrames that read them end with it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster
    it is installed or passed with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def materialize(df, name: str):
    """Compute ``df`` once: written as Parquet to the shared folder and read back.

    Cuts the lineage and survives executor loss; readers prune columns and push filters.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
