"""Text features: token counts, vocabulary, TF-IDF, fixed-length id windows.

Long form throughout: one row per (document, term). Aggregations combine
map-side; the vocabulary is a top-N (bounded, broadcast) or an unbounded
table joined by shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from escalade.functions.text import analyzer_tokens


def _tokens(df: DataFrame, text_col: str, terms_col: str):
    """The analyzer token array: precomputed (``terms_col``) when present, else from the text."""
    return F.col(terms_col) if terms_col in df.columns else analyzer_tokens(F.col(text_col))


def tokenize(df: DataFrame, id_col: str, text_col: str = "text", terms_col: str = "terms") -> DataFrame:
    """(id, term, n): analyzer term counts per document (whole text).

    The token arrays are dealt by document before they are exploded: one row each is
    shuffled, and everything per document (counts, norms) stays in its partition.
    """
    dealt = df.select(id_col, _tokens(df, text_col, terms_col).alias("__t")).repartition(F.col(id_col))
    occ = dealt.select(id_col, F.explode("__t").alias("term"))
    return occ.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(term_counts: DataFrame, n: int, count_col: str = "n") -> DataFrame:
    """(term_id, term, term_count): top-``n`` terms by corpus count, ties by
    term; ids 0..n-1. Partial top-n per partition, then one merge of n rows."""
    tot = term_counts.groupBy("term").agg(F.sum(count_col).alias("term_count"))
    top = tot.orderBy(F.col("term_count").desc(), F.col("term")).limit(n)
    w = Window.orderBy(F.col("term_count").desc(), F.col("term"))
    return top.select((F.row_number().over(w) - 1).cast("int").alias("term_id"), "term", "term_count")


def tfidf_fit(term_counts: DataFrame, id_col: str, vocab: DataFrame | None = None,
              documents: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) with smooth idf ln((1+n)/(1+df)) + 1.

    n counts every fitted document, also those without tokens, when
    ``documents`` is given (else the documents present in ``term_counts``)."""
    if documents is not None:
        n_docs = documents.select(F.count(F.lit(1))).scalar()
    else:
        n_docs = term_counts.select(F.count_distinct(id_col)).scalar()
    tc = term_counts if vocab is None else term_counts.join(vocab.select("term"), "term", "left_semi")
    dfc = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return dfc.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def tfidf_transform(term_counts: DataFrame, id_col: str, idf: DataFrame, broadcast_idf: bool = False) -> DataFrame:
    """(id, term, weight): sublinear tf (1 + ln n) x idf, L2-normalised per
    document; terms without an idf (out of vocabulary) are dropped.

    ``broadcast_idf`` is for an idf over a top-N vocabulary (N rows, a proven
    bound); otherwise Spark decides from its size estimate."""
    idf_side = F.broadcast(idf) if broadcast_idf else idf
    j = term_counts.join(idf_side.select("term", "idf"), "term")
    raw = j.select(id_col, "term", ((F.lit(1.0) + F.log(F.col("n"))) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def tfidf_top(term_counts: DataFrame, id_col: str, n: int, documents: DataFrame) -> DataFrame:
    """``tfidf`` over the top-``n`` vocabulary: its terms and their document frequencies
    come from one aggregation, and the n rows are broadcast."""
    n_docs = documents.select(F.count(F.lit(1))).scalar()
    stats = term_counts.groupBy("term").agg(F.sum("n").alias("term_count"), F.count(F.lit(1)).alias("df"))
    top = stats.orderBy(F.col("term_count").desc(), F.col("term")).limit(n)
    idf = top.select("term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    return tfidf_transform(term_counts, id_col, idf, broadcast_idf=True)


def tfidf(term_counts: DataFrame, id_col: str, vocab: DataFrame | None = None,
          documents: DataFrame | None = None) -> DataFrame:
    """Fit and transform on the same documents; a ``vocab`` is a top-N table
    (``vocabulary``), so its idf is broadcast."""
    idf = tfidf_fit(term_counts, id_col, vocab, documents)
    return tfidf_transform(term_counts, id_col, idf, broadcast_idf=vocab is not None)


# Id 0 pads, id 1 stands for a token outside the vocabulary,
# vocabulary term k has id k + 2.
PAD_ID, UNK_ID, FIRST_ID = 0, 1, 2


def fixed_length_ids(df: DataFrame, id_col: str, vocab: DataFrame, max_len: int,
                     text_col: str = "text", terms_col: str = "terms", label_col: str | None = None) -> DataFrame:
    """Whole-text id windows: the token ids of each document cut into
    consecutive windows of ``max_len`` (the last one padded), so no token is
    dropped; a text without tokens gives one window of padding. Output (id,
    window, input_ids, attention_mask[, labels]), arrays of length ``max_len``.

    ``vocab`` is a top-N table (``vocabulary``): N rows, held by every task;
    each document's token array is mapped in place, without a shuffle.
    """
    if max_len <= 0:
        raise ValueError("max_len must be > 0")
    known = {r["term"]: r["term_id"] + FIRST_ID for r in vocab.select("term", "term_id").collect()}
    shared = df.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("array<bigint>")
    def to_ids(terms: pa.Array) -> pa.Array:
        get = shared.value.get
        return pa.array([None if t is None else [get(x, UNK_ID) for x in t] for t in terms.to_pylist()], pa.list_(pa.int64()))

    extra = [F.col(label_col).alias("labels")] if label_col else []
    ids = df.select(id_col, *extra, F.coalesce(to_ids(_tokens(df, text_col, terms_col)), F.expr("cast(array() as array<bigint>)")).alias("__ids"))
    windows = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("__ids") / max_len).cast("int") - 1, F.lit(0)))
    win = ids.withColumn("window", F.explode(windows))
    seq = F.slice("__ids", F.col("window") * max_len + 1, max_len)
    pad = F.lit(max_len) - F.size(seq)
    return win.select(
        id_col, "window",
        F.concat(seq, F.array_repeat(F.lit(PAD_ID).cast("long"), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1).cast("long"), F.size(seq)),
                 F.array_repeat(F.lit(0).cast("long"), pad)).alias("attention_mask"), *(["labels"] if label_col else []))
