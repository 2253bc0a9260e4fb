"""A learned linear tier: multinomial logistic regression on the TF-IDF features
of ``operators.features`` with Spark ML (distributed fit; the model is a small
coefficient matrix).

Objective match: C * sum(loss) + 1/2 ||w||^2 equals Spark's
mean(loss) + regParam / 2 ||w||^2 with regParam = 1 / (C * n),
no elastic net, no standardisation, free intercepts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.proba import argmax, round_array


def dense_features(weights: DataFrame, id_col: str, vocab: DataFrame, size: int) -> DataFrame:
    """(id, x): the TF-IDF weights of each document as an array over the vocabulary.

    ``vocab`` is a top-N table of ``size`` rows at most, so its ids are broadcast.
    """
    @F.arrow_udf("array<double>")
    def spread(ids: pa.Array, values: pa.Array) -> pa.Array:
        at, flat = ids.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
        x = np.zeros((len(ids), size))
        x[row, at] = flat
        return pa.array(list(x), pa.list_(pa.float64()))

    w = weights.join(F.broadcast(vocab.select("term", "term_id")), "term")
    g = w.groupBy(id_col).agg(F.collect_list(F.struct("term_id", "weight")).alias("s"))
    return g.select(id_col, spread(F.transform("s", lambda x: x["term_id"]), F.transform("s", lambda x: x["weight"])).alias("x"))


def norm(x: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def lr_fit_score(train: DataFrame, test: DataFrame, x_col: str, label_col: str, c: float = 1.0, max_iter: int = 1000,
                 tol: float = 1e-12, round_dp: int | None = 9) -> DataFrame:
    """Fit on ``train`` (feature array + integer label), score ``test``:
    adds ``label``, ``proba`` (array<double>) and ``confidence``. A fit that
    has not converged after ``max_iter`` iterations is an error."""
    n = train.count()
    if n == 0:
        raise ValueError("empty training set")
    vector = lambda d: d.withColumn("__x", array_to_vector(F.col(x_col)))
    lr = LogisticRegression(featuresCol="__x", labelCol=label_col, family="multinomial", regParam=1.0 / (c * n),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol,
                            probabilityCol="__p", predictionCol="__pred", rawPredictionCol="__raw")
    model = lr.fit(vector(train))
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"no convergence within {max_iter} iterations")
    out = model.transform(vector(test))
    proba = vector_to_array(F.col("__p"), "float64")
    if round_dp is not None:
        proba = round_array(proba, round_dp)
    out = out.withColumn("proba", proba).withColumn("label", argmax(F.col("proba")))
    out = out.withColumn("confidence", F.array_max("proba"))
    return out.drop("__x", "__p", "__pred", "__raw")
