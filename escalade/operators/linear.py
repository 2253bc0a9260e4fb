"""Multinomial logistic regression on sparse rows, cross-fitted: all folds in the same passes.

A row holds its features as (positions, values); no table is made dense and no row is copied
a fold. One pass over the rows gives loss and gradient of all folds' models (a row counts
for every fold but its own): every partition adds up its part, a fixed number of parts is added
at a time, and the driver gets a few matrices of the model's size. Rows are multiplied a few hundred
at a time, as a dense block where a row holds a fair part of the features. Steps are those of
limited-memory BFGS, each fold with its own history and step length, in lockstep. They start from
the curvature, the features' products summed over all rows in a pass of its own and anew after ``RENEW``
passes, then after twice as many and so on: without it the number of passes grows with the rows, as the penalty, 1 / (C n), shrinks.

Objective of a fold: mean loss of the other folds' rows + |w|^2 / (2 C n), free intercepts.
``conditions`` states the gradient of every weight at the solution by joins and
aggregations alone: all are 0 at the one optimum that there is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.proba import argmax, softmax
from escalade.session import materialize
from escalade.sources.tables import balanced

# Bound of a model that every task holds, in numbers.
MAX_NUMBERS = 16_000_000
# Partial sums added by one task, and rows multiplied at once.
FAN, ROWS = 64, 500
HISTORY, SUFFICIENT = 12, 1e-4
# Features up to which their products are summed up, partial sums of these added by one task, and
# passes after which they are summed up again.
GRAM, GRAM_FAN, RENEW = 1200, 8, 5
# Features for each value of a row up to which rows are multiplied as dense blocks.
DENSE = 32
STATE = "part long, sums binary"


def sparse_rows(samples: DataFrame, weights: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """``samples`` with positions (array<int>, rising) and values (array<double>) of their terms'
    weights; a sample without terms has empty ones. A row holds a vocabulary's terms at most."""
    w = weights.join(F.broadcast(vocab.select("term", "term_id")), "term")  # a top-N table
    g = w.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("s"))
    out = samples.join(g, id_col, "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<term_id:int,weight:double>>)")))
    return out.select(*samples.columns, F.transform("s", lambda x: x["term_id"]).alias("positions"),
                      F.transform("s", lambda x: x["weight"]).alias("values"))


@dataclass(frozen=True)
class LinearModel:
    """``weights`` is (folds, features + 1, classes), the last feature being the intercept."""

    weights: np.ndarray
    penalty: np.ndarray  # 1 / (C n) of each fold
    rows: np.ndarray  # training rows of each fold
    gradient: float  # largest entry of the gradient
    passes: int


def _logits(w: np.ndarray, at: np.ndarray, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows times weights: ``at`` and ``x`` of all rows, which end at ``ends``."""
    z = np.zeros((len(ends) - 1, w.shape[1]))
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        z[some] = np.add.reduceat(w[at] * x[:, None], ends[some])
    return z + w[-1]


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities over the last axis, and the logarithm of what they were divided by."""
    top = z.max(-1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(-1, keepdims=True)
    return e / total, (top + np.log(total))[..., 0]


def _slices(batch: pa.RecordBatch):
    """(first row, end row, positions, values, ends) of a few hundred rows at a time."""
    at_all, x_all = batch["positions"], batch["values"]
    for a in range(0, batch.num_rows, ROWS):
        at, x = at_all.slice(a, ROWS), x_all.slice(a, ROWS)
        ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])
        yield a, a + len(at), at.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False), ends


def _block(size: int, at: np.ndarray, x: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """The rows as a dense matrix, or None where most of it would be zeros."""
    n = len(ends) - 1
    if n * size > DENSE * len(at):
        return None
    return np.bincount(np.repeat(np.arange(n), np.diff(ends)) * size + at, x, n * size).reshape(n, size)


def _add_up(out: np.ndarray, at: np.ndarray, x: np.ndarray, ends: np.ndarray, r: np.ndarray) -> None:
    """Add each row's values times its ``r`` to the places of its positions."""
    order = np.argsort(at, kind="stable")
    if len(order):
        i = at[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        out[i[first]] += np.add.reduceat(r[np.repeat(np.arange(len(r)), np.diff(ends))[order]] * x[order, None], first)


def _added(sums: DataFrame, parts: int, fan: int) -> np.ndarray:
    """The total of the partial sums of ``parts`` tasks, ``fan`` at a time."""

    def merge(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in table["sums"].to_pylist()], axis=0)
        return pa.table({"part": pa.array([table["part"][0].as_py() // fan], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    while parts > fan:
        sums = sums.groupBy(F.floor(F.col("part") / fan).alias("g")).applyInArrow(merge, STATE)
        parts = -(-parts // fan)
    return np.sum([np.frombuffer(r["sums"]) for r in sums.collect()], axis=0)  # fan rows at most


def _curvature(rows: DataFrame, parts: int, w: np.ndarray, penalty: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each fold, the inverse (features + 1, features + 1) of the mean curvature of all folds'
    losses at ``w``, the same for every class."""
    folds, size, classes = w.shape
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(w.transpose(1, 0, 2).reshape(size, folds * classes)))
    parts = min(parts, rows.sparkSession.sparkContext.defaultParallelism)  # a task's sum is large

    def add(batches):
        flat, total = shared.value, np.zeros((size, size))
        for batch in batches:
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            for a, b, at, x, ends in _slices(batch):
                n = b - a
                block = np.ones((n, size))
                block[:, :-1] = np.bincount(np.repeat(np.arange(n), np.diff(ends)) * (size - 1) + at, x, n * (size - 1)).reshape(n, -1)
                p, _ = _softmax((block @ flat).reshape(n, folds, classes))
                bend = (p * (1 - p)).sum(2) / max(classes - 1, 1) * (fold[a:b, None] != np.arange(folds))
                block *= np.sqrt(bend.sum(1))[:, None]
                total += block.T @ block
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          "sums": pa.array([total.tobytes()], pa.binary())})

    total = _added(rows.select("fold", "positions", "values").coalesce(parts).mapInArrow(add, STATE), parts, GRAM_FAN)
    shared.destroy()
    mean = total.reshape(size, size) / counts.sum()
    return np.array([np.linalg.inv(mean + k * np.eye(size)) for k in penalty])


def _evaluate(rows: DataFrame, parts: int, w: np.ndarray, penalty: np.ndarray | None, counts: np.ndarray | None):
    """Loss and gradient of every fold at ``w`` (folds, features + 1, classes); the first call also counts rows."""
    folds, size, classes = w.shape
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(w.transpose(1, 0, 2).reshape(size, folds * classes)))

    def add(batches):
        flat = shared.value
        n, loss, g = np.zeros(folds), np.zeros(folds), np.zeros((size, folds * classes))
        for batch in batches:
            fold, gold = (batch[c].to_numpy(zero_copy_only=False) for c in ("fold", "gold"))
            for a, b, at, x, ends in _slices(batch):
                block = _block(size - 1, at, x, ends)
                z = _logits(flat, at, x, ends) if block is None else block @ flat[:-1] + flat[-1]
                p, scale = _softmax(z.reshape(b - a, folds, classes))
                z = z.reshape(p.shape)
                own, k = gold[a:b].astype(np.int64), np.arange(b - a)
                counted = fold[a:b, None] != np.arange(folds)
                n += counted.sum(0)
                loss += ((scale - z[k, :, own]) * counted).sum(0)
                p[k, :, own] -= 1
                r = (p * counted[:, :, None]).reshape(b - a, -1)
                g[-1] += r.sum(0)
                if block is None:
                    _add_up(g, at, x, ends, r)
                else:
                    g[:-1] += block.T @ r
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          "sums": pa.array([np.concatenate([n, loss, g.ravel()]).tobytes()], pa.binary())})

    total = _added(rows.select("fold", "gold", "positions", "values").mapInArrow(add, STATE), parts, FAN)
    shared.destroy()
    n, loss = total[:folds], total[folds:2 * folds]
    if counts is None:
        return n
    g = total[2 * folds:].reshape(size, folds, classes).transpose(1, 0, 2) / counts[:, None, None]
    slope = w * penalty[:, None, None]
    slope[:, -1] = 0  # free intercepts
    return loss / counts + 0.5 * (slope * w).sum((1, 2)), g + slope


def _direction(g: np.ndarray, history: list, inverse: np.ndarray | None) -> np.ndarray:
    """The two loops of limited-memory BFGS, starting from ``inverse`` (None: the unit matrix)."""
    start = (lambda v: v) if inverse is None else (lambda v: inverse @ v)
    q, back = g.copy(), []
    for s, y, rho in reversed(history):
        a = rho * (s * q).sum()
        back.append(a)
        q -= a * y
    q = start(q)
    if history:
        s, y, _ = history[-1]
        q = q * ((s * y).sum() / (y * start(y)).sum())
    for (s, y, rho), a in zip(history, reversed(back)):
        q += s * (a - rho * (y * q).sum())
    return -q


def fit(rows: DataFrame, features: int, classes: int, folds: int, c: float = 1.0, tol: float = 1e-8, max_passes: int = 600) -> LinearModel:
    """Cross-fitted models of ``rows`` (fold int, gold int, positions, values), which should be a
    written table: every pass reads it. No convergence within ``max_passes`` is an error."""
    if folds * (features + 1) * classes > MAX_NUMBERS:
        raise ValueError(f"{folds} models of {features} features and {classes} classes are more than {MAX_NUMBERS} numbers")
    if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
        rows = materialize(balanced(rows.select("fold", "gold", "positions", "values")), "linear-dealt")
    parts = rows.rdd.getNumPartitions()
    w = np.zeros((folds, features + 1, classes))
    counts = _evaluate(rows, parts, w, None, None)
    if not counts.all():
        raise ValueError("a fold has no training rows")
    penalty = 1 / (c * counts)
    f, g = _evaluate(rows, parts, w, penalty, counts)
    history: list[list] = [[] for _ in range(folds)]
    step, way = np.zeros(folds), np.zeros_like(w)
    fresh, passes = np.ones(folds, bool), 2
    inverse, renewed, wait = None, passes, 0
    while (open_ := np.abs(g).max((1, 2)) > tol).any():
        if passes >= max_passes:
            raise RuntimeError(f"no convergence within {max_passes} passes")
        if features <= GRAM and passes - renewed >= wait:
            inverse, history, fresh[:] = _curvature(rows, parts, w, penalty, counts), [[] for _ in range(folds)], True
            passes += 1
            renewed, wait = passes, 2 * wait or RENEW
        for k in np.flatnonzero(open_ & fresh):
            way[k] = _direction(g[k], history[k], None if inverse is None else inverse[k])
            step[k] = 1.0 if history[k] or inverse is not None else min(1.0, 1 / np.abs(g[k]).sum())
        trial = w + np.where(open_, step, 0)[:, None, None] * way
        f_new, g_new = _evaluate(rows, parts, trial, penalty, counts)
        passes += 1
        for k in np.flatnonzero(open_):
            fall = (g[k] * way[k]).sum()
            # close to the optimum the loss no longer tells steps apart, the gradient does
            level = f_new[k] <= f[k] + SUFFICIENT * step[k] * fall or (
                f_new[k] <= f[k] + 1e-12 * abs(f[k]) and np.abs(g_new[k]).max() < np.abs(g[k]).max())
            fresh[k] = level
            if not level:
                step[k] /= 2
                if step[k] < 1e-12:  # a bad memory: start it anew
                    history[k], fresh[k] = [], True
                continue
            s, y = trial[k] - w[k], g_new[k] - g[k]
            if (s * y).sum() > 0:
                history[k] = [*history[k], (s, y, 1 / (s * y).sum())][-HISTORY:]
            w[k], f[k], g[k] = trial[k], f_new[k], g_new[k]
    return LinearModel(w, penalty, counts, float(np.abs(g).max()), passes)


def score(rows: DataFrame, model: LinearModel, keep: list[str]) -> DataFrame:
    """``keep`` + label, proba, confidence: every row by the model that it isn't a training row of."""
    folds, size, classes = model.weights.shape
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.weights.transpose(1, 0, 2).reshape(size, -1)))

    @F.arrow_udf("array<double>")
    def proba(fold: pa.Array, positions: pa.Array, values: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([positions, values], ["positions", "values"])
        own = fold.to_numpy(zero_copy_only=False)
        out = [_softmax(_logits(shared.value, at, x, ends).reshape(b - a, folds, classes)[np.arange(b - a), own[a:b]])[0]
               for a, b, at, x, ends in _slices(batch)]
        flat = np.concatenate([p.ravel() for p in out]) if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * classes), pa.array(flat))

    scored = rows.select(*keep, proba.asNondeterministic()(F.col("fold"), F.col("positions"), F.col("values")).alias("proba"))
    return scored.select(*keep, argmax(F.col("proba")).alias("label"), "proba", F.array_max("proba").alias("confidence"))


def conditions(rows: DataFrame, model: LinearModel, id_col: str) -> DataFrame:
    """(fold, class, position, value): the gradient of every weight, and of the intercepts (position =
    number of features), from the rows in long form by joins and aggregations alone."""
    folds, size, classes = model.weights.shape
    spark = rows.sparkSession
    cells = [(k, c) for k in range(folds) for c in range(classes)]
    flat = model.weights.transpose(1, 0, 2).reshape(size, -1)
    table = spark.createDataFrame([(i, r) for i, r in enumerate(flat[:-1].tolist())], "position int, w array<double>")  # one model
    each = rows.select(id_col, F.explode(F.arrays_zip("positions", "values")).alias("x")) \
        .select(id_col, F.col("x.positions").alias("position"), F.col("x.values").alias("x"))
    z = each.join(F.broadcast(table), "position").groupBy(id_col).agg(*[F.sum(F.col("x") * F.col("w")[i]).alias(f"z{i}") for i in range(len(cells))])
    z = rows.select(id_col, "fold", "gold").join(z, id_col, "left").fillna(0.0)
    p = [softmax(F.array(*[F.col(f"z{k * classes + c}") + float(flat[-1, k * classes + c]) for c in range(classes)])) for k in range(folds)]
    z = z.select(id_col, "fold", "gold", *[p[k].alias(f"p{k}") for k in range(folds)])

    def rest(k: int, c: int) -> Column:
        return F.when(F.col("fold") != k, F.col(f"p{k}")[c] - (F.col("gold") == c).cast("double")).otherwise(0.0)

    r = materialize(z.select(id_col, *[rest(k, c).alias(f"r{i}") for i, (k, c) in enumerate(cells)]), "linear-rest")
    # rows meet their rests before they are exploded: a row is shuffled, and not each of its values
    held = rows.select(id_col, F.arrays_zip("positions", "values").alias("xs")).join(r, id_col).select("*", F.explode("xs").alias("v")) \
        .select(F.col("v.positions").alias("position"), F.col("v.values").alias("x"), *r.columns[1:])
    sums = held.groupBy("position").agg(*[F.sum(F.col("x") * F.col(f"r{i}")).alias(f"g{i}") for i in range(len(cells))])
    sums = table.join(sums, "position", "left").fillna(0.0, [f"g{i}" for i in range(len(cells))])
    at = [F.col(f"g{i}") / float(model.rows[k]) + F.col("w")[i] * float(model.penalty[k]) for i, (k, _) in enumerate(cells)]
    free = r.agg(*[(F.sum(f"r{i}") / float(model.rows[k])).alias(f"g{i}") for i, (k, _) in enumerate(cells)]) \
        .select(F.lit(size - 1).alias("position"), *[F.col(f"g{i}") for i in range(len(cells))])
    both = sums.select("position", *[v.alias(f"g{i}") for i, v in enumerate(at)]).unionByName(free)
    rows_ = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(c).alias("class"), F.col("position").alias("position"), F.col(f"g{i}").alias("value"))
                      for i, (k, c) in enumerate(cells)])
    return both.select(F.explode(rows_).alias("x")).select("x.*")
