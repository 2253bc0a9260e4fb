"""Helpers the operators share: row keys, tables in the shared folder, batches, words."""

from __future__ import annotations

import gc
import os
import re
import uuid
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.session import scratch_path

# ASCII letters in order; only these are case-folded (contracts say A-Z)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
FOLD = str.maketrans(UPPER, LOWER)

# A word: a run of ASCII letters/digits and any character from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RE = re.compile(WORD)

# Rows and bytes per Arrow batch: bound a Python worker's memory when texts are long.
BATCH_ROWS = 500
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet`` through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the session's shared folder and read it back.

    Cuts the lineage: later stages read the table, so a lost executor costs a
    re-read and not the work before it.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, name: str = "__row") -> DataFrame:
    """``docs`` written once with a row number, so that every later job reads the same numbers:
    numbers drawn again change with the splits of a scan, which follow the cores registered then."""
    return spill(docs.withColumn(name, F.monotonically_increasing_id()), "keyed")


_TRIM = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "131072"}


def workers(spark: SparkSession, rows: int = BATCH_ROWS, trim: bool = True) -> None:
    """Prepare a session for this package's Arrow functions.

    Sets the rows and bytes of an Arrow batch, so that long texts stay bounded, and lets Python workers import this package from where the driver has it
    (on a cluster it is installed or passed with ``--py-files``).
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    # workers live on from task to task: with ``trim`` freed memory goes back to the system at
    # once, which costs time where large arrays come and go
    for name, value in _TRIM.items():
        if trim:
            env[name] = value
        else:
            env.pop(name, None)


_HELD: dict = {}  # of a worker process


def keeps_columns(stage):
    """A filter ``stage(docs, ...)`` sees doc_id, text and n_chars under their names and all
    other columns under numbers, so that no name of theirs can clash with its own columns."""
    own = ("doc_id", "text", "n_chars")

    @wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        inner = [c if c in own else f"__c{i}" for i, c in enumerate(docs.columns)]
        out = stage(docs.toDF(*inner), *args, **kwargs)
        return out.select(*inner).toDF(*docs.columns)

    return run


def worker_cache(name, make):
    """What an operator keeps in a worker process from task to task; of one operator at a time."""
    if name not in _HELD:
        import pyarrow as pa

        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]


def folded(col) -> F.Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


# UTF-8 bytes of words, A-Z lower-cased; every other byte becomes a blank
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased (null: none)."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "replace")).translate(_WORD_BYTES).split()


def texts(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    return column.cast("binary").to_pylist()


def mix64(x):
    """SplitMix64 finaliser over a numpy uint64 array (wraps modulo 2^64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
