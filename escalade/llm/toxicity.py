"""Counterfactual-regularised toxicity classifier (operator 2).

Logistic regression over the presence of hashed word features (the word, its
prefixes and suffixes). Labelled texts that name a group are paired with
counterfactuals, the term swapped for another of its category; the squared
change of the score under the swap is penalised, so that a group's name alone
does not move the score.

Scale: the model is trained on the driver from a bounded sample of labelled rows
(at most ``SAMPLE`` rows a class, of each the hashed features only); the class
prior comes from all labelled rows. Scoring is one map-side pass over all texts
with a broadcast of at most 2^BITS weights (2 MB); no text is shuffled.

Defined results: null or empty texts have no features and get the score of the
intercept; rows without a label or doc_id are scored but not learned from;
repeated label rows count once a label, and a document labelled both ways
counts as toxic; without labels of both classes every score is that of the smoothed
prior; an empty table gives no rows; extra columns are kept
(``score`` replaces columns of the names it adds).
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import common as C

BITS = 18
# Bound of the training sample: labelled rows a class, in the order of a hash of the id.
SAMPLE = 3_000
L2, SWAP_WEIGHT, STEPS = 0.02, 2.0, 300
# Words a worker remembers before it starts over.
CACHE_WORDS = 100_000

# Group names by category; terms of a category are swapped for each other
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer", "schwule", "lesben", "homosexuels", "lesbiennes"),
    ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "buddhists",
     "atheist", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos",
     "judíos"),
    ("black", "white", "asian", "african", "european", "hispanic", "latino", "arab", "schwarze", "weiße", "noirs",
     "blancs", "negros", "blancos"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "ausländer", "flüchtlinge",
     "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("disabled", "blind", "deaf", "autistic", "behinderte", "handicapés", "discapacitados"),
    ("old", "young", "elderly", "teenagers", "alte", "junge", "vieux", "jeunes", "viejos", "jóvenes"),
)
_CATEGORY = {t: c for c in IDENTITY for t in c}
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of a whole text, lower-cased."""
    return set(_WORD.findall(text.lower())) if text else set()


def buckets(word: str) -> list[int]:
    """Hashed features of a word: itself, prefixes of 3 to 6 and suffixes of 3 to 5 letters."""
    w = f"<{word}>"
    parts = {w, *(w[:k] for k in range(4, min(8, len(w)))), *(w[-k:] for k in range(4, min(7, len(w))))}
    return [zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts]


def held_out(doc_id) -> F.Column:
    """Rows whose crc32 of the id as text is divisible by 5: never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[list, dict[int, int]]:
    """At most ``per_class`` labelled rows a class as (label, features, group names),
    and the number of labelled documents of each class."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_label"))
             .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
             .groupBy("_id").agg(F.max("_label").alias("_label")))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)

    kind = pa.struct([("f", pa.list_(pa.int32())), ("t", pa.list_(pa.string()))])

    @F.arrow_udf("struct<f:array<int>,t:array<string>>")
    def features(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            own = words(text)
            out.append({"f": sorted({b for w in own for b in buckets(w)}), "t": sorted(own & _CATEGORY.keys())})
        return pa.array(out, kind)

    C.workers(docs.sparkSession)
    # the sample has at most 2 x per_class short rows, which bounds the broadcast
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(picked), F.col("doc_id") == F.col("_id")) \
        .select("_id", "_label", features("text").alias("x"))
    # a repeated document must not lift the bound: one row an id
    rows = joined.groupBy("_id", "_label").agg(F.min("x").alias("x")).select("_id", "_label", "x.f", "x.t").toArrow()
    order = np.argsort(rows["_id"].to_numpy(), kind="stable").tolist()
    found = [f.values.to_numpy() for f in rows["f"]]
    labels, terms = rows["_label"].to_pylist(), rows["t"].to_pylist()
    return [(labels[i], found[i], terms[i]) for i in order], sizes


def train(rows: list, sizes: dict[int, int], l2: float = L2, swap_weight: float = SWAP_WEIGHT,
          steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the intercept."""
    weights = np.zeros(1 << BITS, np.float64)
    n = {c: sum(r[0] == c for r in rows) for c in (0, 1)}
    prior = math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))
    if not n[0] or not n[1]:
        return weights, prior
    y = np.array([r[0] for r in rows], np.float64)
    # features whose rates in the classes differ by more than chance
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for label, features, _ in rows:
        (pos if label == 1 else neg)[features] += 1  # a row's features are distinct
    rate = (pos + neg + 1) / (len(rows) + 2)
    z = (pos / n[1] - neg / n[0]) / np.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
    chosen = (np.abs(z) > 4) & (pos + neg >= 5)
    number = np.cumsum(chosen) - 1
    kept = [number[np.asarray(r[1], np.int64)[chosen[r[1]]]] for r in rows]
    doc, col, k = np.repeat(np.arange(len(rows)), [len(x) for x in kept]), np.concatenate(kept), int(chosen.sum())

    # counterfactuals: each group name swapped for the others of its category
    pair_row, pair_col, pair_val, pairs = [], [], [], 0
    for _, _, terms in rows:
        for term in terms:
            for other in _CATEGORY[term]:
                if other == term:
                    continue
                for t, sign in ((term, -1.0), (other, 1.0)):
                    for b in buckets(t):
                        if chosen[b]:
                            pair_row.append(pairs)
                            pair_col.append(number[b])
                            pair_val.append(sign)
                pairs += 1
    pair_row, pair_col, pair_val = np.array(pair_row, np.int64), np.array(pair_col, np.int64), np.array(pair_val)

    w, bias = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    # a class counts by its share of all labelled documents
    share = 1 / (1 + math.exp(-prior))
    balance = np.where(y == 1, share / n[1], (1 - share) / n[0])
    for step in range(1, steps + 1):
        f = np.bincount(doc, w[col], len(rows)) + bias
        e = (1 / (1 + np.exp(-np.clip(f, -40, 40))) - y) * balance
        g = np.append(np.bincount(col, e[doc], k) + l2 * w / len(rows), e.sum())
        if pairs:
            change = np.bincount(pair_row, pair_val * w[pair_col], pairs)
            g[:k] += swap_weight * np.bincount(pair_col, pair_val * change[pair_row], k) / pairs
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        w, bias = w - move[:k], bias - move[k]
    weights[chosen] = w
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and intercept learned from ``labels.toxic``."""
    model = train(*sample(docs, labels, per_class))
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted``."""
    C.workers(docs.sparkSession)
    weights, bias = model
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((dict(zip(at.tolist(), weights[at].tolist())), bias))
    of_this_model = f"weights {zlib.crc32(weights.tobytes())}"

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        table, intercept = shared.value
        seen = C.worker_cache(of_this_model, dict)  # words to their features with a weight
        out = []
        for text in texts.to_pylist():
            own: set[int] = set()
            for w in words(text):
                hit = seen.get(w)
                if hit is None:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    hit = seen[w] = tuple(b for b in buckets(w) if b in table)
                if hit:
                    own.update(hit)
            f = intercept + math.fsum(table[b] for b in own)
            out.append(1 / (1 + math.exp(-min(40.0, max(-40.0, f)))))
        return pa.array(out, pa.float64())

    out = docs.withColumn("score", probability.asNondeterministic()(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@C.keeps_columns
def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, columns unchanged."""
    return score(docs, fit(docs, labels)).filter(F.col("predicted") == 0)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
