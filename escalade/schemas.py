"""Schemas, label dictionaries and column checks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# One routing decision per sample and configuration.
DECISION_SCHEMA = T.StructType([
    T.StructField("sample_idx", T.LongType()),
    T.StructField("tier_used", T.IntegerType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("gold_label", T.IntegerType()),
    T.StructField("correct", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("bytes_sent", T.IntegerType()),
])
DECISION_COLUMNS = [f.name for f in DECISION_SCHEMA.fields]

# The seven intent names of the utterance corpus, in class-index order.
INTENT_LABELS = [
    "AddToPlaylist",
    "BookRestaurant",
    "GetWeather",
    "PlayMusic",
    "RateBook",
    "SearchCreativeWork",
    "SearchScreeningEvent",
]

# Profile rows: 18 columns in this order (positional, see profile sources).
PROFILE_SCHEMA = T.StructType(
    [T.StructField("tier", T.IntegerType()),
     T.StructField("model_name", T.StringType()),
     T.StructField("inference_mode", T.StringType()),
     T.StructField("n_samples", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in (
        "mean_latency_ms", "std_latency_ms", "p95_latency_ms", "model_footprint_mb",
        "inference_peak_ram_mb", "rss_after_load_mb", "vm_rss_mb", "vm_peak_mb",
        "peak_vram_mb", "energy_mj", "load_time_ms", "accuracy", "f1_macro")]
    + [T.StructField("notes", T.StringType())]
)
PROFILE_COLUMNS = [f.name for f in PROFILE_SCHEMA.fields]


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Raise KeyError naming the missing columns (no Spark job is run)."""
    absent = [c for c in dict.fromkeys(required) if c not in df.columns]
    if absent:
        raise KeyError(f"the input has no column {', '.join(absent)}; it has {', '.join(df.columns)}")


def check_unit_interval(name: str, value: float) -> float:
    """Thresholds and probabilities must lie in [0, 1] (NaN fails too)."""
    if not (0.0 <= float(value) <= 1.0):
        raise ValueError(f"{name} = {value} lies outside 0 to 1")
    return float(value)
