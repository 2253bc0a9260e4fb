"""Embedding whitening by incremental eigendecomposition (operator 11).

Vectors of whole numbers are centred, projected on the eigenvectors of their covariance and
scaled to variance one. The covariance is that of the distinct vectors (the fit list).

Method. Every partition of the fit list keeps the spectrum of its scatter matrix: a vector
x changes it by the rank-one term (k / (k + 1)) (x - m)(x - m)^T, m the mean of the k
vectors before. The eigenvalues of diagonal plus rank one are the roots of the secular equation,
one between each two old ones: all are found at once by two-pole rational steps inside a
bracket that shrinks. Directions that the vector doesn't touch and equal eigenvalues are
deflated first (a reflection turns a group of equal ones so that one of them takes all of it).
Eigenvectors come from the entries for which the roots found are exact, so they stay orthogonal.
Spectra of partitions are combined by as many rank-one terms as there are dimensions, and one
for the difference of the means, ``FAN`` spectra to one, until one is left. Rayleigh-Ritz
refinement: every partition projects its centred vectors on that basis, the d x d matrices are
added up, and the eigenvectors of the sum turn the basis; the same pass over the turned basis
gives the covariance of the whitened vectors, and another turn if it isn't the identity to
``EXACT``.

Scale: two scans of the fit list and one of the table; the only shuffles are that of the
distinct vectors (a vector that fills a third of the table is combined before it) and d x d
numbers a partition. The driver gets one spectrum of d x d numbers; d is the
vectors' length, whatever the number of rows. A vector costs some d^3 operations.

Defined results: rows whose vector is null or empty, or has null or non-finite entries, are
dropped; vectors of different lengths are an error; repeated vectors count once in the fit and
each row gets its result; a component without variance (fewer distinct vectors than dimensions)
has null ``whitened``; without any variance ``explained`` and ``identity_error`` are null too;
a squared deviation beyond 64 bits is null; entries beyond 64 bits are the largest such number;
a null vec_id is kept; only the two named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import common as C
from escalade.sources.tables import balanced

COMPONENTS = 4
# Spectra combined by one task.
FAN = 8
# Largest error of the whitened covariance that needs no further turn of the basis, and turns at most.
EXACT, TURNS = 1e-9, 4
EPS = float(np.finfo(np.float64).eps)

STATE = "part long, n long, sums array<decimal(38,0)>, spectrum binary"
OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_STATE = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("spectrum", pa.binary())])


def secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z^T for rising ``d`` and positive ``z2`` = z^2, and the
    differences d[j] - eigenvalue[i] as a matrix (i, j), each found from its nearest pole."""
    m = len(d)
    at = np.arange(m)
    gap = np.append(np.diff(d), z2.sum())
    poles = d[None, :] - d[:, None]
    middle = 1 + (z2 / (poles - gap[:, None] / 2)).sum(1)
    # the root lies in the half of its interval where the sign changes; poles are measured from its end there
    beyond = middle < 0
    origin = at + beyond
    origin[-1] = m - 1
    shifted = d[None, :] - d[origin][:, None]
    lo, hi = np.where(beyond, -gap / 2, 0.0), np.where(beyond, 0.0, gap / 2)
    if beyond[-1]:
        lo[-1], hi[-1] = gap[-1] / 2, gap[-1]
    mu = (lo + hi) / 2
    left = at[None, :] <= at[:, None]
    open_ = np.ones(m, bool)
    for _ in range(100):
        t = shifted - mu[:, None]
        term = z2 / t
        f = 1 + term.sum(1)
        lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
        open_ &= np.abs(f) > 4 * m * EPS * (1 + np.abs(term).sum(1))
        if not open_.any():
            break
        slope = term / t
        psi, all_ = (slope * left).sum(1), slope.sum(1)
        near, far = t[at, at], t[at, np.minimum(at + 1, m - 1)]
        with np.errstate(all="ignore"):
            c = f - near * psi - far * (all_ - psi)
            a = (near + far) * f - near * far * all_
            b = near * far * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # the last interval has one pole
            step[-1] = near[-1] + near[-1] ** 2 * all_[-1] / (f[-1] - near[-1] * all_[-1])
            new = mu + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        open_ &= new != mu
        mu = np.where(open_, new, mu)
    return d[origin] + mu, shifted - mu[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising values, vectors as columns) of the matrix with that spectrum plus v v^T."""
    z = vectors.T @ v
    size = float(z @ z)
    tiny = 8 * EPS * max(float(values[-1]), size)
    if not size or size <= tiny * EPS:
        return values, vectors
    vectors = vectors.copy()
    # equal eigenvalues: one direction of each group takes all of the vector
    group = np.concatenate([[0], np.cumsum(np.diff(values) > tiny)])
    for g in np.flatnonzero(np.bincount(group) > 1):
        own = np.flatnonzero(group == g)
        u = z[own].copy()
        length = np.sqrt(u @ u)
        if not length:
            continue
        u[-1] += np.copysign(length, u[-1])
        z[own] = 0
        z[own[-1]] = -np.copysign(length, u[-1])
        vectors[:, own] -= np.outer(vectors[:, own] @ u, u) * (2 / (u @ u))
    live = np.flatnonzero(np.sqrt(size) * np.abs(z) > tiny)
    if len(live):
        d, own = values[live], z[live]
        found, t = secular(d, own * own)
        # entries for which the roots found are exact (products of ratios that interlace)
        between = d[:, None] - d[None, :]
        np.fill_diagonal(between, 1.0)
        exact = np.sqrt(np.maximum(np.prod(-t / between, axis=0), 0)) * np.where(own < 0, -1.0, 1.0)
        turn = (exact / t).T
        turn /= np.sqrt((turn * turn).sum(0))
        vectors[:, live] = vectors[:, live] @ turn
        values = values.copy()
        values[live] = found
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _packed(values, vectors) -> bytes:
    return np.concatenate([values, vectors.ravel()]).tobytes()


def _unpacked(spectrum: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(spectrum)
    return a[:d].copy(), a[d:].reshape(d, d).copy()


def _mean(sums: list, n: int) -> np.ndarray:
    return np.array([int(s) / n for s in sums], np.float64)


def _state(part: int, n: int, sums: list, spectrum: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [part], "n": [n], "sums": [[Decimal(int(s)) for s in sums]], "spectrum": [spectrum]}, _STATE)


def _rows(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def absorb(batches):
    """The spectrum of one partition: a rank-one term for each vector."""
    n, sums, mean, values, vectors = 0, None, None, None, None
    for batch in batches:
        x = _rows(batch.column(0))
        if sums is None:
            d = x.shape[1]
            sums, mean, values, vectors = np.zeros(d, object), np.zeros(d), np.zeros(d), np.eye(d)
        for row in x.astype(np.float64):
            change = row - mean
            values, vectors = rank_one(values, vectors, change * np.sqrt(n / (n + 1)))
            n += 1
            mean += change / n
        sums = sums + x.astype(object).sum(0)
    if n:
        yield _state(TaskContext.get().partitionId(), n, sums, _packed(values, vectors))


def combine(states: pa.Table) -> pa.Table:
    """One spectrum of several: those of the others as rank-one terms, and the means' differences."""
    rows = sorted(states.to_pylist(), key=lambda r: r["part"])
    d = len(rows[0]["sums"])
    n, sums = rows[0]["n"], [int(s) for s in rows[0]["sums"]]
    values, vectors = _unpacked(rows[0]["spectrum"], d)
    for r in rows[1:]:
        own_values, own_vectors = _unpacked(r["spectrum"], d)
        for value, vector in zip(own_values, own_vectors.T):
            if value > 0:
                values, vectors = rank_one(values, vectors, vector * np.sqrt(value))
        apart = _mean(r["sums"], r["n"]) - _mean(sums, n)
        values, vectors = rank_one(values, vectors, apart * np.sqrt(n * r["n"] / (n + r["n"])))
        n, sums = n + r["n"], [a + int(b) for a, b in zip(sums, r["sums"])]
    return pa.Table.from_batches([_state(rows[0]["part"] // FAN, n, sums, _packed(values, vectors))])


def add_up(states: pa.Table) -> pa.Table:
    """Sums of the projected products and of the projections."""
    rows = sorted(states.to_pylist(), key=lambda r: r["part"])
    total = np.sum([np.frombuffer(r["spectrum"]) for r in rows], axis=0)
    return pa.Table.from_batches([_state(rows[0]["part"] // FAN, sum(r["n"] for r in rows), [], total.tobytes())])


def _gathered(states: DataFrame, parts: int, merge) -> dict:
    """The one state that is left when ``FAN`` at a time are merged."""
    while True:
        states = states.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(merge, STATE)
        parts = -(-parts // FAN)
        if parts <= 1:
            return states.toArrow().to_pylist()[0]


@dataclass(frozen=True)
class Whitening:
    """What the fit found: ``values`` fall, ``vectors`` are their columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None

    @property
    def rank(self) -> int:
        """Components with variance."""
        return int((self.values > len(self.values) * EPS * max(float(self.values[0]), 0.0)).sum())


def whole_numbers(df: DataFrame, vector: str, name: str = "x", scale: int = 256) -> DataFrame:
    """``df`` without rows of unusable vectors, with floor(scale * entry) as ``name``."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite) \
        .withColumn(name, F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)).cast("long")))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors in ``x`` (array of long); None without any."""
    C.workers(vectors.sparkSession)
    listed = C.spill(vectors.select("x").distinct(), "whitening-fit")
    size = listed.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if size["least"] is None:
        return None
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of {size['least']} to {size['most']} entries have no common covariance")
    d = size["least"]
    dealt = balanced(listed, "x")
    parts = dealt.rdd.getNumPartitions()
    whole = _gathered(dealt.mapInArrow(absorb, STATE), parts, combine)
    n, sums = whole["n"], tuple(int(s) for s in whole["sums"])
    mean = _mean(sums, n)
    basis, _ = np.linalg.qr(_unpacked(whole["spectrum"], d)[1][:, ::-1])

    def projected(basis):
        """Covariance of the centred vectors in a basis."""
        shared = vectors.sparkSession.sparkContext.broadcast((mean, basis))  # d x d numbers

        def project(batches):
            centre, turn = shared.value
            n, products, total = 0, np.zeros((d, d)), np.zeros(d)
            for batch in batches:
                y = (_rows(batch.column(0)).astype(np.float64) - centre) @ turn
                n, products, total = n + len(y), products + y.T @ y, total + y.sum(0)
            if n:
                yield _state(TaskContext.get().partitionId(), n, [], np.concatenate([products.ravel(), total]).tobytes())

        a = np.frombuffer(_gathered(dealt.mapInArrow(project, STATE), parts, add_up)["spectrum"]) / n
        return a[:d * d].reshape(d, d) - np.outer(a[d * d:], a[d * d:])

    for turn in range(TURNS):
        found, own = np.linalg.eigh(projected(basis) if turn == 0 else again)
        basis, _ = np.linalg.qr(basis @ own[:, ::-1])
        model = Whitening(n, sums, np.maximum(found[::-1], 0.0), basis, None)
        again = projected(basis)
        live = min(components, model.rank)
        if not live:
            return model
        e = np.sqrt(model.values[:live])
        error = float(np.abs(again[:live, :live] / np.outer(e, e) - np.eye(live)).max())
        if error <= EXACT:
            break
    return Whitening(n, sums, model.values, basis, error)


def transform(df: DataFrame, model: Whitening, id_col: str, components: int = COMPONENTS) -> DataFrame:
    """A row for each row of ``df`` (id, ``x``) and component: its whitened value."""
    d = len(model.values)
    k, live = min(components, d), min(components, model.rank)
    trace = float(model.values.sum())
    share = [float(e) / trace if trace else None for e in model.values[:k]]
    mean = _mean(model.sums, model.n)
    scaled = model.vectors[:, :live] / np.sqrt(model.values[:live])
    shared = df.sparkSession.sparkContext.broadcast((model.n, model.sums, mean, scaled))  # d x k numbers
    error = model.identity_error

    def project(batches):
        n, sums, centre, turn = shared.value
        of_sums = max(abs(s) for s in sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(1))
            most = n * int(max(abs(int(x.min())), abs(int(x.max())))) + of_sums
            if d * most * most < 1 << 63:
                off = x * n - np.array(sums, np.int64)
                deviation = (off * off).sum(1).tolist()
            else:
                off = x.astype(object) * n - np.array(sums, object)
                deviation = [s if s < 1 << 63 else None for s in (off * off).sum(1).tolist()]
            white = np.full((len(x), k), np.nan)
            white[:, :live] = (x.astype(np.float64) - centre) @ turn
            rows = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(np.repeat(np.arange(rows), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)), pa.array(np.repeat(np.array(deviation, object), k), pa.int64()),
                pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel())), pa.array(share * rows, pa.float64()),
                pa.array([error] * (rows * k), pa.float64())],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(F.col(id_col).cast("long"), "x").mapInArrow(project, OUT).withColumnRenamed("id", id_col)


def whiten(df: DataFrame, id_col: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of the rows of ``df``: fitted on its distinct vectors, applied to all rows."""
    x = whole_numbers(df.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")), "vector").select("id", "x")
    model = fit(x, components)
    if model is None:
        return df.sparkSession.createDataFrame([], OUT).withColumnRenamed("id", id_col)
    return transform(x, model, "id", components).withColumnRenamed("id", id_col)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """The first whitened components of every embedding."""
    return whiten(C.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
