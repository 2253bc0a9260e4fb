"""Tier scorers meeting one contract: samples in, ``(label, proba, confidence)`` out.

The built-in scorer is a multinomial naive-Bayes language model with add-one
smoothing, **cross-fitted**: samples carry a ``fold`` id and each sample is
scored with counts from the other folds only, so every row of the input is
scored (no held-out subset is dropped) and no sample sees its own label.

Fitting is one distributed aggregation over token occurrences: per term, the
count per (class) and per (class, fold). The per-fold model is derived by
subtraction, so the corpus is scanned once whatever the number of folds.
Scoring is a join of a sample's token occurrences with the model (one row
per term holding the weights of every fold) and one aggregation per sample,
combined map-side. A model over a top-N vocabulary has at most N rows, so it
is broadcast. A full-vocabulary join is split by term frequency: the most
frequent terms (bounded, broadcast) are joined map-side and only the long tail
is shuffled, so no hot key reaches a shuffle partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escalade.functions.proba import argmax, one_hot, round_array, softmax
from escalade.functions.text import analyzer_tokens

# Upper bound on the size of a model we are willing to broadcast: a row holds
# n_folds x (n_classes + 1) doubles plus its term.
MAX_BROADCAST_MODEL_BYTES = 256 * 1024 * 1024
TERM_BYTES = 32
# Terms handled map-side (broadcast) in a full-vocabulary join: the most
# frequent ones, which carry most occurrences and all hot keys.
HOT_TERMS = 20_000


def token_occurrences(samples: DataFrame, keep: list[str], text_col: str = "text",
                      outer: bool = False, terms_col: str = "terms") -> DataFrame:
    """One row per analyzer token of the whole text: ``keep + [term]``.

    Uses the precomputed token array ``terms_col`` when the samples carry
    one (see ``token_table``), else tokenises ``text_col``. ``outer`` keeps
    samples without tokens (``term`` NULL).
    """
    ex = F.explode_outer if outer else F.explode
    arr = F.col(terms_col) if terms_col in samples.columns else analyzer_tokens(F.col(text_col))
    return samples.select(*keep, ex(arr).alias("term"))


def token_table(samples: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` + ``terms`` (analyzer tokens of the whole text), text dropped.

    Tokenise once, then fit and score every tier from this table; callers
    materialise it (reliable checkpoint) when it is read more than once.
    """
    return samples.select(*keep, analyzer_tokens(F.col(text_col)).alias("terms"))


def term_class_counts(occ: DataFrame, n_classes: int, n_folds: int) -> DataFrame:
    """Per term: total count ``n`` and ``c`` = array over class of
    array over fold of counts. One hash aggregation with map-side combine."""
    g, f = F.col("gold_label"), F.col("fold")
    per_class = [F.count_if(g == l).alias(f"n_{l}") for l in range(n_classes)]
    per_cf = [F.count_if((g == l) & (f == k)).alias(f"n_{l}_{k}")
              for l in range(n_classes) for k in range(n_folds)]
    return occ.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *per_class, *per_cf)


def class_fold_docs(samples: DataFrame, n_classes: int, n_folds: int) -> DataFrame:
    """One row: number of samples per class (d_l) and per (class, fold) (d_l_k)."""
    g, f = F.col("gold_label"), F.col("fold")
    return samples.agg(*[F.count_if(g == l).alias(f"d_{l}") for l in range(n_classes)],
                       *[F.count_if((g == l) & (f == k)).alias(f"d_{l}_{k}")
                         for l in range(n_classes) for k in range(n_folds)])


@dataclass
class NaiveBayesTier:
    """One cascade tier.

    tier        1, 2 or 3 (only a tag on the output)
    n_classes   classes are ids 0..n_classes-1 in ``gold_label``
    vocab_size  top-N terms by corpus count (ties by term); None = all terms
    output      'softmax' (length-normalised posterior) or 'one_hot' (argmax)
    n_folds     folds of the cross-fit; samples carry ``fold`` in [0, n_folds)
    round_dp    round probabilities (and hence confidence) to this many places
    """

    tier: int
    n_classes: int
    vocab_size: int | None = None
    output: str = "softmax"
    n_folds: int = 5
    round_dp: int | None = 9

    model: DataFrame | None = None
    header: DataFrame | None = None
    hot_model: DataFrame | None = None
    counts: DataFrame | None = None

    @property
    def bounded(self) -> bool:
        """A top-N model small enough to broadcast (checked on its size bound,
        N rows of fixed width); otherwise the hot/cold split join is used."""
        if self.vocab_size is None:
            return False
        row = TERM_BYTES + 8 * self.n_folds * (self.n_classes + 1)
        return self.vocab_size * row <= MAX_BROADCAST_MODEL_BYTES

    def fit(self, corpus: DataFrame, counts: DataFrame | None = None,
            docs: DataFrame | None = None) -> "NaiveBayesTier":
        """``corpus``: labelled samples (sample_id, fold, gold_label, text).
        ``counts`` / ``docs``: optional precomputed ``term_class_counts`` and
        ``class_fold_docs`` so that several tiers share one scan."""
        L, K = self.n_classes, self.n_folds
        if counts is None:
            counts = term_class_counts(token_occurrences(corpus, ["fold", "gold_label"]), L, K)
        self.counts = counts
        if self.vocab_size is not None:
            top = counts.orderBy(F.col("n").desc(), F.col("term")).limit(self.vocab_size).select("term")
            counts = counts.join(F.broadcast(top), "term", "left_semi")

        # model rows, one per term: wf[k][l] = ln(count of class l outside fold k + 1),
        # wf[k][L] = 1 (that slot counts in-vocabulary tokens per sample).
        per_fold = [F.array(*[F.log(F.col(f"n_{l}") - F.col(f"n_{l}_{k}") + F.lit(1.0)) for l in range(L)],
                            F.lit(1.0)) for k in range(K)]
        self.model = counts.select("term", F.array(*per_fold).alias("wf"))
        if not self.bounded:
            # the HOT_TERMS most frequent terms with their frequency rank
            # (bounded, broadcast at scoring; the window runs on those rows only)
            hot = counts.orderBy(F.col("n").desc(), F.col("term")).limit(HOT_TERMS) \
                .select("term", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("term"))).alias("rank"))
            self.hot_model = self.model.join(F.broadcast(hot), "term")

        # header rows, one per fold: log prior and log normaliser ln(tokens + V) per class
        tok = counts.agg(F.count(F.lit(1)).alias("V"),
                         *[F.sum(F.col(f"n_{l}")).alias(f"t_{l}") for l in range(L)],
                         *[F.sum(F.col(f"n_{l}_{k}")).alias(f"t_{l}_{k}") for l in range(L) for k in range(K)])
        if docs is None:
            docs = class_fold_docs(corpus, L, K)
        tok_rows = tok.select(F.explode(F.array(*[
            F.struct(F.lit(k).alias("fold"), F.col("V").alias("V"),
                     F.array(*[(F.col(f"t_{l}") - F.col(f"t_{l}_{k}")) for l in range(L)]).alias("t"))
            for k in range(K)])).alias("r")).select("r.*")
        doc_rows = docs.select(F.explode(F.array(*[
            F.struct(F.lit(k).alias("fold"),
                     F.array(*[(F.col(f"d_{l}") - F.col(f"d_{l}_{k}")) for l in range(L)]).alias("d"))
            for k in range(K)])).alias("r")).select("r.*")
        hdr = tok_rows.join(doc_rows, "fold")
        dsum = F.aggregate(F.col("d"), F.lit(0).cast("bigint"), lambda a, x: a + x)
        self.header = hdr.select(
            "fold",
            # a class without training samples outside the fold gets log prior -inf
            # (probability 0); Spark's log(0) would be NULL
            F.transform(F.col("d"), lambda x: F.when(x > 0, F.log(x / dsum))
                        .otherwise(F.lit(float("-inf")))).alias("lp"),
            F.transform(F.col("t"), lambda x: F.log(x + F.col("V"))).alias("lnorm"))
        return self

    def _spread_model(self) -> DataFrame:
        """The full-vocabulary model, shuffled at every size: its rows are far wider than
        Spark's estimate from the counts' files, which would broadcast it."""
        return self.model.hint("merge")

    def score(self, samples: DataFrame, keep: list[str]) -> DataFrame:
        """Score ``samples`` (must hold sample_id, fold, text and ``keep``).

        Returns ``keep`` + tier, label, proba, confidence; one row per sample
        (samples without tokens included: they get the prior).
        """
        if self.model is None:
            raise RuntimeError("fit() first")
        L = self.n_classes
        keys = list(dict.fromkeys(["sample_id", "fold", *keep]))
        w = F.element_at(F.col("wf"), F.col("fold") + 1)
        if self.bounded:
            # bounded model: broadcast inner join drops out-of-vocabulary tokens
            # before the aggregation; samples without any in-vocabulary token
            # come back through the join with the sample keys
            occ = token_occurrences(samples, keys)
            j = occ.join(F.broadcast(self.model), "term")
            sums = j.groupBy(*keys).agg(*[F.sum(w[i]).alias(f"s_{i}") for i in range(L + 1)])
            sums = samples.select(*keys).join(sums, keys, "left").fillna(0.0, [f"s_{i}" for i in range(L + 1)])
        else:
            # full vocabulary, split by term frequency: occurrences of the hot
            # terms join a bounded broadcast slice of the model map-side; only
            # the long tail is shuffled to join the rest (no hot key reaches a
            # shuffle partition; AQE still splits any remaining skew)
            # Inner joins; samples without tokens come back through the join
            # with the sample keys.
            occ = token_occurrences(samples, keys)
            hot_terms = F.broadcast(self.hot_model.select("term"))
            hot = occ.join(F.broadcast(self.hot_model.drop("rank")), "term")
            cold = occ.join(hot_terms, "term", "left_anti").join(self._spread_model(), "term")
            j = hot.unionByName(cold)
            sums = j.groupBy(*keys).agg(*[F.sum(w[i]).alias(f"s_{i}") for i in range(L + 1)])
            sums = samples.select(*keys).join(sums, keys, "left").fillna(0.0, [f"s_{i}" for i in range(L + 1)])
        return self._finish(sums, keep, [f"s_{i}" for i in range(L + 1)])

    def _proba(self, cols: list[str], lp: Column, lnorm: Column) -> Column:
        """Probability vector from per-sample sums (``cols``: L class sums, then
        the in-vocabulary token count) and this tier's header columns."""
        L = self.n_classes
        nt = F.col(cols[L])
        z_raw = F.array(*[F.col(cols[l]) - nt * lnorm[l] for l in range(L)])
        if self.output == "softmax":
            z = F.transform(z_raw, lambda x, i: x / F.greatest(nt, F.lit(1.0)) + lp[i])
            proba = softmax(z)
            return round_array(proba, self.round_dp) if self.round_dp is not None else proba
        if self.output == "one_hot":
            return one_hot(argmax(F.transform(z_raw, lambda x, i: x + lp[i])), L)
        raise ValueError(f"unknown output {self.output!r}")

    def _finish(self, sums: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
        sc = sums.join(F.broadcast(self.header), "fold")
        out = sc.select(*keep, F.lit(self.tier).alias("tier"),
                        self._proba(cols, F.col("lp"), F.col("lnorm")).alias("proba"))
        return out.select(*keep, "tier", argmax(F.col("proba")).alias("label"), "proba",
                          F.array_max("proba").alias("confidence"))


def can_fuse(tiers: list[NaiveBayesTier]) -> bool:
    """Whether ``score_fused`` can score the tiers in one pass: one shared fit, a
    full-vocabulary tier, and every top-N vocabulary within the ranked hot terms."""
    return (any(not t.bounded for t in tiers)
            and all(t.counts is tiers[0].counts and t.n_folds == tiers[0].n_folds
                    and t.n_classes == tiers[0].n_classes for t in tiers)
            and all(t.vocab_size is None or t.vocab_size <= HOT_TERMS for t in tiers))


def score_fused(tiers: list[NaiveBayesTier], samples: DataFrame, keep: list[str]) -> DataFrame:
    """All tiers in one pass when they share one fit (same counts, folds and
    classes) and include a full-vocabulary tier: the per-term weights are the
    same for every tier; only vocabulary membership (frequency rank <= N) and
    the per-fold header differ. One explode, one join (hot terms broadcast,
    long tail shuffled), one aggregation; returns ``keep`` + pred{k}, conf{k}
    per tier. See ``can_fuse`` for what the tiers must share."""
    if not can_fuse(tiers):
        raise ValueError("these tiers cannot be scored in one pass; score them in stages")
    ref, L = next(t for t in tiers if not t.bounded), tiers[0].n_classes
    keys = list(dict.fromkeys(["sample_id", "fold", *keep]))
    occ = token_occurrences(samples, keys, outer=True)
    hot = occ.join(F.broadcast(ref.hot_model), "term")
    cold = occ.join(F.broadcast(ref.hot_model.select("term")), "term", "left_anti") \
        .join(ref._spread_model(), "term", "left").withColumn("rank", F.lit(None).cast("int"))
    j = hot.unionByName(cold)
    w = F.element_at(F.col("wf"), F.col("fold") + 1)
    aggs = []
    for t in tiers:
        member = F.lit(True) if t.vocab_size is None else (F.col("rank") <= F.lit(t.vocab_size))
        aggs += [F.coalesce(F.sum(F.when(member, w[i])), F.lit(0.0)).alias(f"t{t.tier}_s_{i}") for i in range(L + 1)]
    sc = j.groupBy(*keys).agg(*aggs)
    for t in tiers:
        k = t.tier
        sc = sc.join(F.broadcast(t.header.select("fold", F.col("lp").alias(f"lp{k}"),
                                                 F.col("lnorm").alias(f"lnorm{k}"))), "fold")
    probas = [t._proba([f"t{t.tier}_s_{i}" for i in range(L + 1)], F.col(f"lp{t.tier}"),
                       F.col(f"lnorm{t.tier}")).alias(f"proba{t.tier}") for t in tiers]
    sc = sc.select(*keys, *probas)
    return sc.select(*keys, *[c for t in tiers for c in (
        argmax(F.col(f"proba{t.tier}")).alias(f"pred{t.tier}"), F.array_max(f"proba{t.tier}").alias(f"conf{t.tier}"))])


def pandas_scorer(predict, n_classes: int, tier: int, text_col: str = "text",
                  keep: list[str] | None = None):
    """Scorer from a user batch function (e.g. a model loaded once per worker).

    ``predict(texts: list[str]) -> (labels, proba)`` with ``proba`` shaped
    [n, n_classes]. Runs in Arrow batches through ``mapInPandas``; in a
    staged cascade it only sees the rows that reach its tier.
    Returns ``DataFrame(samples) -> DataFrame(keep + tier, label, proba, confidence)``.
    """
    import numpy as np
    import pandas as pd

    def scorer(samples: DataFrame) -> DataFrame:
        cols = list(dict.fromkeys(["sample_id", *(keep or [])]))
        fields = [samples.schema[c] for c in cols]
        from pyspark.sql import types as T
        schema = T.StructType(fields + [T.StructField("tier", T.IntegerType()),
                                        T.StructField("label", T.IntegerType()),
                                        T.StructField("proba", T.ArrayType(T.DoubleType()))])

        def run(batches):
            for pdf in batches:
                labels, proba = predict(pdf[text_col].tolist())
                proba = np.asarray(proba, dtype="float64").reshape(len(pdf), n_classes)
                out = pdf[cols].copy()
                out["tier"] = tier
                out["label"] = np.asarray(labels, dtype="int32")
                out["proba"] = list(proba)
                yield out

        scored = samples.select(*cols, text_col).mapInPandas(run, schema)
        return scored.withColumn("confidence", F.array_max("proba"))
    return scorer
