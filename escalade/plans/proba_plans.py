"""Plans for tier outputs and escalation rules on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions.proba import argmax, confidence, proba_dense
from escalade.functions.text import utf8_bytes, whitespace_count
from escalade.operators import routing as R
from escalade.operators.scoring import pandas_scorer
from escalade.plans import cascade as C
from escalade.plans.oracle import with_cascade
from escalade.plans.registry import plan, rounded
from escalade.sources.tables import balanced, read_table

THETA = 0.7
LENGTH_LIMIT = 300
KEEP = ["sample_id", "gold_label", "bytes_sent"]


def _tier(spark, sf_dir, k):
    dc = C.build(spark, sf_dir)
    return dc.tiers[k - 1].score(dc.samples, KEEP)


@plan("confidence", with_cascade("SELECT sample_id, round(conf1, 6) AS confidence FROM sc1"))
def q_confidence(spark, sf_dir):
    s = _tier(spark, sf_dir, 1)
    return rounded(s.select("sample_id", confidence(F.col("proba")).alias("confidence")))


@plan("should_escalate", with_cascade(f"SELECT sample_id, conf1 < {THETA} AS escalate FROM sc1"))
def q_should_escalate(spark, sf_dir):
    s = _tier(spark, sf_dir, 1)
    return s.select("sample_id", R.should_escalate(F.col("confidence"), THETA).alias("escalate"))


@plan("strategy_confidence", with_cascade(f"SELECT sample_id, conf1 < {THETA} AS escalate FROM sc1"))
def q_strategy_confidence(spark, sf_dir):
    s = _tier(spark, sf_dir, 1)
    rule = R.RULES["confidence"](THETA)
    return s.select("sample_id", rule(F.lit(None), F.col("proba")).alias("escalate"))


WORDS_SQL = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT"


@plan("strategy_length", f"""
SELECT doc_id, {WORDS_SQL} AS n_words, {WORDS_SQL} > {LENGTH_LIMIT} AS escalate FROM documents""")
def q_strategy_length(spark, sf_dir):
    d = balanced(read_table(spark, sf_dir, "documents"), "doc_id")
    rule = R.RULES["length"](LENGTH_LIMIT)
    return d.select("doc_id", whitespace_count(F.col("text")).alias("n_words"),
                    rule(F.col("text"), F.lit(None)).alias("escalate"))


@plan("strategy_any", with_cascade(f"""
SELECT s.sample_id, sc1.conf1 < {THETA} OR {WORDS_SQL.replace('text', 's.text')} > {LENGTH_LIMIT} AS escalate
FROM samples s JOIN sc1 USING (sample_id)"""))
def q_strategy_any(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    s = dc.tiers[0].score(dc.samples, KEEP)
    text = balanced(read_table(spark, sf_dir, "documents"), "doc_id") \
        .select(F.col("doc_id").alias("sample_id"), "text")
    rule = R.any_rule(R.RULES["confidence"](THETA), R.RULES["length"](LENGTH_LIMIT))
    return s.join(text, "sample_id").select("sample_id", rule(F.col("text"), F.col("proba")).alias("escalate"))


@plan("bytes_sent", "SELECT doc_id, strlen(text)::INT AS bytes_sent FROM documents")
def q_bytes_sent(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", utf8_bytes(F.col("text")).cast("int").alias("bytes_sent"))


@plan("softmax", with_cascade("SELECT sample_id, list(round(p, 6) ORDER BY label) AS proba FROM p1 GROUP BY sample_id"))
def q_softmax(spark, sf_dir):
    return rounded(_tier(spark, sf_dir, 1).select("sample_id", F.transform("proba", lambda x: F.round(x, 6)).alias("proba")))


@plan("argmax", with_cascade("SELECT sample_id, pred1 AS label FROM sc1"))
def q_argmax(spark, sf_dir):
    return _tier(spark, sf_dir, 1).select("sample_id", argmax(F.col("proba")).alias("label"))


@plan("proba_dense", with_cascade("SELECT sample_id, list(round(p, 6) ORDER BY label) AS proba FROM p2 GROUP BY sample_id"))
def q_proba_dense(spark, sf_dir):
    s = _tier(spark, sf_dir, 2)
    # long form (sample, class, p) -> map -> dense vector in class order
    long = s.select("sample_id", F.posexplode("proba").alias("label", "p"))
    m = long.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("m"))
    n = len(C.build(spark, sf_dir).labels)
    return m.select("sample_id", F.transform(proba_dense(F.col("m"), n), lambda x: F.round(x, 6)).alias("proba"))


def _scores_sql(k):
    return with_cascade(f"SELECT sample_id, {k} AS tier, pred{k} AS label, round(conf{k}, 6) AS confidence FROM sc{k}")


def _scores(spark, sf_dir, k):
    return rounded(_tier(spark, sf_dir, k).select("sample_id", "tier", "label", "confidence"))


@plan("scores_tier1", _scores_sql(1))
def q_scores_tier1(spark, sf_dir):
    return _scores(spark, sf_dir, 1)


@plan("scores_tier2", _scores_sql(2))
def q_scores_tier2(spark, sf_dir):
    return _scores(spark, sf_dir, 2)


@plan("scores_tier3", _scores_sql(3))
def q_scores_tier3(spark, sf_dir):
    return _scores(spark, sf_dir, 3)


# A letter typical of each class, by class id.
MARKERS = ["z", "w", "ñ", "q"]
_MARK_SQL = "[" + ", ".join(f"length(text) - length(replace(text, '{m}', '')) + 1" for m in MARKERS) + "]"


def letter_model(markers: list[str]):
    """A stand-in for a user's model: share of each class's letter (add-one)."""
    def predict(texts: list[str]) -> tuple[list[int], list[list[float]]]:
        counts = [[t.count(m) + 1 for m in markers] for t in texts]
        return [c.index(max(c)) for c in counts], [[x / sum(c) for x in c] for c in counts]
    return predict


@plan("scores_user_model", f"""
SELECT doc_id AS sample_id, 2::INT AS tier, (list_position(c, list_max(c)) - 1)::INT AS label,
  list_transform(c, lambda x: round(x / list_sum(c), 6)) AS proba, round(list_max(c) / list_sum(c), 6) AS confidence
FROM (SELECT doc_id, {_MARK_SQL} AS c FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def q_scores_user_model(spark, sf_dir):
    """Batch scoring with a Python model (Arrow batches)."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = pandas_scorer(letter_model(MARKERS), len(MARKERS), 2)(d)
    return rounded(scored.select("sample_id", "tier", "label", F.transform("proba", lambda x: F.round(x, 6)).alias("proba"), "confidence"))


# softmax / argmax over a second table: the 64-d embedding vectors as logits
@plan("softmax_embeddings", """
SELECT vec_id, list_transform(e, lambda x: round(exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e)))), 6)) AS proba
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def q_softmax_embeddings(spark, sf_dir):
    from escalade.functions.proba import softmax
    e = read_table(spark, sf_dir, "embeddings")
    p = softmax(F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.transform(p, lambda x: F.round(x, 6)).alias("proba"))


@plan("argmax_embeddings", """
SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS label, gl AS gold_label
FROM (SELECT vec_id, label AS gl, embedding::DOUBLE[] AS e FROM embeddings)""")
def q_argmax_embeddings(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", argmax(F.col("embedding").cast("array<double>")).alias("label"),
                    F.col("label").alias("gold_label"))
