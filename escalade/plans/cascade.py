"""The cascade on a text table: samples, three naive-Bayes tiers, decisions.

Meaning on the ``documents`` table (fixed for all plans and oracles):

* sample = document: ``sample_id = doc_id``, gold class = ``lang`` encoded
  alphabetically (``label_id``), ``bytes_sent`` = UTF-8 length of the text;
* every document is scored; a seeded hash of ``doc_id`` assigns it to one of
  five cross-fitting folds, and it is scored with counts from the other four;
* tier 1 = top-16 vocabulary, tier 2 = top-256, both emitting a
  length-normalised softmax; tier 3 = full vocabulary, emitting one-hot
  (a label, like a generative tier); the vocabulary ranks terms of all
  documents by count (ties by term) and uses no labels.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.functions.text import utf8_bytes
from escalade.operators.cube import decision_cube, outcomes
from escalade.operators.labels import collect_labels, encode_with_list, label_dictionary
from escalade.operators.routing import Cascade, decisions_from_wide, wide_scores
from escalade.operators.scoring import (NaiveBayesTier, can_fuse, class_fold_docs, score_fused, term_class_counts,
                                        token_occurrences, token_table)
from escalade.session import materialize
from escalade.sources.tables import balanced, read_table

# Fixed values of the cascade on documents.
N_FOLDS = 5
TIER1_VOCAB = 16
TIER2_VOCAB = 256
CONF_DP = 9


def fold_of(key, n_folds: int = N_FOLDS):
    """Cross-fitting fold of a row: a seeded hash of its key (first 32 bits of
    ``md5('fold:' || key)``) modulo the number of folds -- a random, balanced
    assignment that does not follow the id order."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(n_folds)).cast("int")


def document_tokens(documents: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Per document: sample_id, lang, fold, bytes_sent and its token array."""
    d = documents.select(F.col("doc_id").alias("sample_id"), "lang", "text",
                         fold_of(F.col("doc_id"), n_folds).alias("fold"),
                         utf8_bytes(F.col("text")).alias("bytes_sent"))
    return token_table(d, ["sample_id", "lang", "fold", "bytes_sent"])


@dataclass
class DocumentCascade:
    samples: DataFrame
    labels: list[str]
    tiers: tuple[NaiveBayesTier, NaiveBayesTier, NaiveBayesTier]
    cascade: Cascade
    _wide: DataFrame | None = None
    _cube: DataFrame | None = None

    def wide(self) -> DataFrame:
        """Per-sample scores of every tier the sweep and ablations need,
        computed once and materialised (reused by every decision report)."""
        if self._wide is None:
            self._wide = materialize(wide_scores(self.cascade, self.samples), "wide-scores")
        return self._wide

    def decisions(self) -> DataFrame:
        return decisions_from_wide(self.wide(), self.cascade.costs)

    def cube(self) -> DataFrame:
        """The contingency cube of the wide table: what all decision reports read."""
        if self._cube is None:
            self._cube = materialize(decision_cube(self.wide()), "decision-cube")
        return self._cube

    def outcomes(self) -> DataFrame:
        """Decisions of all configurations, grouped (``cube.outcomes``)."""
        return outcomes(self.cube(), self.cascade.costs)


# Fitted cascades of this process, keyed by session, input and parameters
# (fit once, score many). The key holds the input's size and modification
# time, so a rewritten table is refitted.
_FITTED: dict[tuple, DocumentCascade] = {}
MAX_FITTED = 4


def _signature(spark: SparkSession, path: str) -> tuple:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    st = fs.getContentSummary(p)
    return (st.getLength(), st.getFileCount(), fs.getFileStatus(p).getModificationTime())


def _session_key(spark: SparkSession) -> tuple:
    """Names this session for good (an object's address may be used again)."""
    return spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID()


_TOKENS: dict[tuple, DataFrame] = {}


def corpus_tokens(spark: SparkSession, sf_dir: str, n_folds: int = N_FOLDS) -> DataFrame:
    """The materialised per-document token table of ``<sf_dir>/documents``
    (sample_id, lang, fold, bytes_sent, terms), shared by the cascade and the
    text plans of this session: the corpus is tokenised once."""
    import os
    path = os.path.join(sf_dir, "documents.parquet")
    key = (*_session_key(spark), sf_dir, _signature(spark, path), n_folds)
    if key not in _TOKENS:
        if len(_TOKENS) >= MAX_FITTED:
            _TOKENS.pop(next(iter(_TOKENS)))
        documents = balanced(read_table(spark, sf_dir, "documents"), "doc_id")
        _TOKENS[key] = materialize(document_tokens(documents, n_folds), "doc-tokens")
    return _TOKENS[key]


def build(spark: SparkSession, sf_dir: str, vocab1: int = TIER1_VOCAB, vocab2: int = TIER2_VOCAB,
          n_folds: int = N_FOLDS) -> DocumentCascade:
    """The fitted cascade for ``<sf_dir>/documents.parquet`` (memoised per session and input)."""
    import os
    path = os.path.join(sf_dir, "documents.parquet")
    key = (*_session_key(spark), sf_dir, _signature(spark, path), vocab1, vocab2, n_folds)
    if key not in _FITTED:
        if len(_FITTED) >= MAX_FITTED:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[key] = fit_cascade(spark, sf_dir, vocab1, vocab2, n_folds)
    return _FITTED[key]


def fit_cascade(spark: SparkSession, sf_dir: str, vocab1: int = TIER1_VOCAB, vocab2: int = TIER2_VOCAB,
                n_folds: int = N_FOLDS) -> DocumentCascade:
    """Fit the three tiers on ``<sf_dir>/documents`` (its shared token table)."""
    return fit_token_cascade(corpus_tokens(spark, sf_dir, n_folds), vocab1, vocab2, n_folds)


def fit_text_cascade(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                     vocab1: int = TIER1_VOCAB, vocab2: int = TIER2_VOCAB, n_folds: int = N_FOLDS) -> DocumentCascade:
    """Fit the cascade on any labelled text table (integer ``id_col``).

    The table is tokenised once into a checkpointed token table; the
    returned ``DocumentCascade`` scores, routes and sweeps its samples.
    """
    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                  F.col(label_col).cast("string").alias("lang"))
    return fit_token_cascade(materialize(document_tokens(balanced(d, "doc_id"), n_folds), "doc-tokens"),
                             vocab1, vocab2, n_folds)


def fit_token_cascade(toks: DataFrame, vocab1: int = TIER1_VOCAB, vocab2: int = TIER2_VOCAB,
                      n_folds: int = N_FOLDS) -> DocumentCascade:
    """Fit the three tiers on a token table (sample_id, lang, fold, bytes_sent, terms).

    The fitted statistics are aggregates (per term; per class and fold) that
    all tiers read several times, so they are materialised once.
    """
    labels = collect_labels(label_dictionary(toks, "lang"))
    L = len(labels)
    samples = toks.select("sample_id", "fold", "bytes_sent", "terms",
                          encode_with_list(F.col("lang"), labels).alias("gold_label"))
    counts = materialize(term_class_counts(token_occurrences(samples, ["fold", "gold_label"]), L, n_folds),
                         "term-counts")
    docs = materialize(class_fold_docs(samples, L, n_folds), "class-fold-docs")
    t1 = NaiveBayesTier(1, L, vocab1, "softmax", n_folds, CONF_DP).fit(samples, counts, docs)
    t2 = NaiveBayesTier(2, L, vocab2, "softmax", n_folds, CONF_DP).fit(samples, counts, docs)
    t3 = NaiveBayesTier(3, L, None, "one_hot", n_folds, CONF_DP).fit(samples, counts, docs)
    return DocumentCascade(samples, labels, (t1, t2, t3), tier_cascade(t1, t2, t3))


def tier_cascade(t1: NaiveBayesTier, t2: NaiveBayesTier, t3: NaiveBayesTier) -> Cascade:
    """The cascade of three fitted tiers."""
    keep = ["sample_id", "gold_label", "bytes_sent"]

    def fused(s):
        w = score_fused([t1, t2, t3], s, keep)
        return w.select("sample_id", "gold_label", "bytes_sent", "pred1", "conf1", "pred2", "conf2", "pred3", "conf3")

    return Cascade(lambda s: t1.score(s, keep), lambda s: t2.score(s, keep), lambda s: t3.score(s, keep),
                   fused=fused if can_fuse([t1, t2, t3]) else None)


def written_cascade(dc: DocumentCascade) -> Cascade:
    """The cascade with the tiers' headers and most frequent terms written: a stream reads them with
    every micro-batch, and would work them out from all terms' counts each time."""
    heads = materialize(reduce(DataFrame.unionByName, [t.header.withColumn("tier", F.lit(t.tier)) for t in dc.tiers]), "tier-headers")
    hot = {t.tier: materialize(t.hot_model, "hot-terms") for t in dc.tiers if t.hot_model is not None}
    return tier_cascade(*[replace(t, header=heads.where(F.col("tier") == t.tier).drop("tier"), hot_model=hot.get(t.tier)) for t in dc.tiers])
