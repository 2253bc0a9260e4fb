"""A cascade of Python models in one pass: batches are compacted between the tiers.

A model is described by how it is loaded, not by the loaded thing: every Python worker loads it
once, at its first batch, and keeps it from task to task. Rows are regrouped to the
batch size that the model asks for, across the borders of Arrow batches.

In a cascade one iterator runs over a partition: a full batch goes to tier 1, the rows
below its threshold are put by until they make a full batch for tier 2, and so on. A tier
never sees a row that stopped before it, texts are read once, and nothing is joined or shuffled.
At most one batch a tier is held in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.operators.routing import DEFAULT_TIER_COST_MS, Cascade
from escalade.schemas import check_unit_interval
from escalade.session import importable

Predict = Callable[[list[str]], tuple[Sequence[int], Sequence[Sequence[float]]]]


@dataclass(frozen=True)
class BatchModel:
    """A user's model.

    load        called once in every Python worker; returns ``predict``, which maps a list of
                texts to their labels and their probabilities (one row of ``n_classes`` each)
    n_classes   length of a row of probabilities
    batch_size  texts a call of ``predict`` gets (the last call of a partition may get fewer)
    """

    load: Callable[[], Predict]
    n_classes: int
    batch_size: int = 32
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if not callable(self.load):
            raise TypeError(f"a model is given by a function that loads it, not by {self.load!r}")
        if self.n_classes < 1 or self.batch_size < 1:
            raise ValueError("n_classes and batch_size must be positive")


# Models of this worker process, by key; a worker lives on from task to task.
_LOADED: dict[str, Predict] = {}


def loaded(model: BatchModel) -> Predict:
    """The model's ``predict`` in this process."""
    if model.key not in _LOADED:
        predict = model.load()
        if not callable(predict):
            raise TypeError(f"load() must return a function of a list of texts, not {predict!r}")
        _LOADED[model.key] = predict
    return _LOADED[model.key]


def predicted(model: BatchModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and probabilities of one batch, checked for their shape."""
    labels, proba = loaded(model)(texts)
    labels, proba = np.asarray(labels), np.asarray(proba, np.float64)
    if labels.shape != (len(texts),) or proba.shape != (len(texts), model.n_classes):
        raise ValueError(f"a model of {model.n_classes} classes gave labels {labels.shape} and probabilities {proba.shape} "
                         f"for {len(texts)} texts")
    return labels.astype(np.int32), proba


class Regrouped:
    """Rows put by until they make a batch of ``size``."""

    def __init__(self, size: int):
        self.size, self.rows, self.held = size, 0, []

    def put(self, table: pa.Table) -> Iterator[pa.Table]:
        """Adds rows; gives full batches."""
        self.held.append(table)
        self.rows += table.num_rows
        if self.rows < self.size:
            return
        all_ = pa.concat_tables(self.held)
        full = self.rows - self.rows % self.size
        rest = all_.slice(full)
        # copied, so that what was given out can go
        self.held, self.rows = ([rest.take(pa.array(range(rest.num_rows)))] if rest.num_rows else []), rest.num_rows
        for at in range(0, full, self.size):
            yield all_.slice(at, self.size)

    def rest(self) -> Iterator[pa.Table]:
        if self.rows:
            yield pa.concat_tables(self.held)
        self.held, self.rows = [], 0


def _texts(table: pa.Table, text_col: str) -> list[str]:
    return [t or "" for t in table[text_col].to_pylist()]


def model_scorer(model: BatchModel, tier: int, text_col: str = "text", keep: Sequence[str] = ()):
    """A scorer ``DataFrame(samples) -> DataFrame(sample_id, *keep, tier, label, proba, confidence)``."""
    cols = list(dict.fromkeys(["sample_id", *keep]))

    def scorer(samples: DataFrame) -> DataFrame:
        importable(samples.sparkSession)
        schema = T.StructType([samples.schema[c] for c in cols] + [
            T.StructField("tier", T.IntegerType()), T.StructField("label", T.IntegerType()),
            T.StructField("proba", T.ArrayType(T.DoubleType()))])

        def run(batches):
            queue = Regrouped(model.batch_size)

            def score(batch: pa.Table):
                labels, proba = predicted(model, _texts(batch, text_col))
                out = batch.select(cols).append_column("tier", pa.array(np.full(len(labels), tier, np.int32)))
                out = out.append_column("label", pa.array(labels))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(labels) + 1, dtype=np.int32) * model.n_classes), pa.array(proba.ravel()))
                return out.append_column("proba", flat).combine_chunks().to_batches()

            for batch in batches:
                for full in queue.put(pa.Table.from_batches([batch])):
                    yield from score(full)
            for full in queue.rest():
                yield from score(full)

        asked = list(dict.fromkeys([*cols, text_col]))
        return samples.select(*asked).mapInArrow(run, schema).withColumn("confidence", F.array_max("proba"))

    return scorer


def one_pass(models: Sequence[BatchModel], samples: DataFrame, theta1_max: float, theta2_max: float,
             text_col: str = "text") -> DataFrame:
    """One row a sample: gold_label, bytes_sent, and pred and conf of every tier that it reaches
    under thresholds up to (theta1_max, theta2_max); unreached tiers are NULL."""
    if len(models) != 3:
        raise ValueError(f"a cascade has three tiers, not {len(models)}")
    limits = (check_unit_interval("theta1", theta1_max), check_unit_interval("theta2", theta2_max))
    importable(samples.sparkSession)
    base = ["sample_id", "gold_label", "bytes_sent"]
    kinds = (T.IntegerType(), T.DoubleType())
    schema = T.StructType([samples.schema[c] for c in base] + [
        T.StructField(f"{name}{k}", kind) for k in (1, 2, 3) for name, kind in zip(("pred", "conf"), kinds)])
    names = schema.fieldNames()

    def run(batches):
        queues = [Regrouped(m.batch_size) for m in models]

        def tier(k: int, batch: pa.Table):
            """Scores a batch by tier k; what stops goes out, the rest moves on."""
            labels, proba = predicted(models[k], _texts(batch, text_col))
            conf = proba.max(1)
            batch = batch.append_column(f"pred{k + 1}", pa.array(labels)).append_column(f"conf{k + 1}", pa.array(conf))
            on = conf < limits[k] if k < 2 else np.zeros(len(conf), bool)
            if not on.all():
                done = batch.filter(pa.array(~on)) if on.any() else batch
                for name, kind in ((f"{n}{j}", p) for j in range(k + 2, 4) for n, p in (("pred", pa.int32()), ("conf", pa.float64()))):
                    done = done.append_column(name, pa.nulls(done.num_rows, kind))
                yield from done.select(names).combine_chunks().to_batches()
            if on.any():
                for full in queues[k + 1].put(batch.filter(pa.array(on))):
                    yield from tier(k + 1, full)

        for batch in batches:
            for full in queues[0].put(pa.Table.from_batches([batch])):
                yield from tier(0, full)
        for k in range(3):
            for full in queues[k].rest():
                yield from tier(k, full)

    return samples.select(*base, text_col).mapInArrow(run, schema)


def model_cascade(models: Sequence[BatchModel], text_col: str = "text",
                  costs: Sequence[float] = DEFAULT_TIER_COST_MS) -> Cascade:
    """A ``Cascade`` of three Python models: routed in one pass, its ablations by single tiers."""
    if len(models) != 3:
        raise ValueError(f"a cascade has three tiers, not {len(models)}")
    scorers = [model_scorer(m, k + 1, text_col) for k, m in enumerate(models)]
    return Cascade(*scorers, costs=costs, one_pass=lambda samples, t1, t2: one_pass(models, samples, t1, t2, text_col))
