"""A cascade of three Python models over documents, routed and swept in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions.text import utf8_bytes
from escalade.operators import lazy as L
from escalade.operators import routing as R
from escalade.operators.labels import label_dictionary, label_encode
from escalade.plans.registry import plan, rounded
from escalade.sources.tables import balanced, read_table

# Per tier, letters typical of each class (by class id), and texts a call.
LETTERS = (
    ("z", "w", "ñ", "q"),
    ("zß", "wy", "ñó", "qx"),
    ("zßäöü", "wyf", "ñóía", "qxèé"),
)
BATCH = (256, 64, 16)
THETA1, THETA2 = 0.5, 0.6


def letter_model(groups: tuple[str, ...], one_hot: bool):
    """A stand-in for a user's model: share of each class's letters (add-one), or the class alone."""
    def load():
        def predict(texts):
            counts = [[sum(t.count(x) for x in g) + 1 for g in groups] for t in texts]
            labels = [c.index(max(c)) for c in counts]
            if one_hot:
                return labels, [[float(k == label) for k in range(len(groups))] for label in labels]
            return labels, [[x / sum(c) for x in c] for c in counts]
        return predict
    return load


def models() -> tuple[L.BatchModel, ...]:
    return tuple(L.BatchModel(letter_model(g, one_hot=k == 2), len(g), BATCH[k]) for k, g in enumerate(LETTERS))


def _samples(spark, sf_dir):
    docs = balanced(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    own = label_encode(docs, "lang", label_dictionary(docs, "lang"), out="gold_label")
    return own.select(F.col("doc_id").alias("sample_id"), "text", "gold_label", utf8_bytes(F.col("text")).alias("bytes_sent"))


def _count_sql(groups) -> str:
    one = lambda g: " + ".join(f"length(text) - length(replace(text, '{x}', ''))" for x in g)
    return "[" + ", ".join(f"({one(g)} + 1)" for g in groups) + "]"


WIDE_SQL = f"""c AS (SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS gold_label, strlen(text)::INT AS bytes_sent,
  {', '.join(f'{_count_sql(g)} AS c{k}' for k, g in enumerate(LETTERS, 1))} FROM documents),
wide AS (SELECT doc_id AS sample_idx, gold_label, bytes_sent,
  {', '.join(f'(list_position(c{k}, list_max(c{k})) - 1)::INT AS pred{k}' for k in (1, 2, 3))},
  list_max(c1) / list_sum(c1) AS conf1, list_max(c2) / list_sum(c2) AS conf2, 1.0::DOUBLE AS conf3 FROM c)"""
_COST = R.DEFAULT_TIER_COST_MS
_LATENCY = f"CASE tier_used WHEN 1 THEN {_COST[0]} WHEN 2 THEN {_COST[0] + _COST[1]} ELSE {sum(_COST)} END::DOUBLE"
_PICK = "CASE tier_used WHEN 1 THEN {0}1 WHEN 2 THEN {0}2 ELSE {0}3 END"


@plan("lazy_cascade", f"""WITH {WIDE_SQL},
r AS (SELECT *, CASE WHEN conf1 >= {THETA1}::DOUBLE THEN 1 WHEN conf2 >= {THETA2}::DOUBLE THEN 2 ELSE 3 END AS tier_used FROM wide)
SELECT sample_idx, tier_used, {_PICK.format('pred')} AS prediction, gold_label, {_PICK.format('pred')} = gold_label AS correct,
  round({_PICK.format('conf')}, 6) AS confidence, round({_LATENCY}, 6) AS latency_ms, bytes_sent FROM r""")
def q_lazy_cascade(spark, sf_dir):
    """Decisions of the cascade of Python models."""
    return rounded(R.route(L.model_cascade(models()), _samples(spark, sf_dir), THETA1, THETA2))


_GRID = ", ".join(f"('{R.config_name(a, b)}', {a}::DOUBLE, {b}::DOUBLE)" for a in R.DEFAULT_THETAS for b in R.DEFAULT_THETAS)


@plan("lazy_sweep", f"""WITH {WIDE_SQL},
r AS (SELECT *, CASE WHEN conf1 >= theta1 THEN 1 WHEN conf2 >= theta2 THEN 2 ELSE 3 END AS tier_used
  FROM wide, (VALUES {_GRID}) g(config, theta1, theta2))
SELECT config, theta1, theta2, round(avg(({_PICK.format('pred')} = gold_label)::INT), 6) AS accuracy,
  round(avg({_LATENCY}), 6) AS mean_latency_ms,
  {', '.join(f'round(count(*) FILTER (WHERE tier_used = {k}) / count(*), 6) AS rate_tier{k}' for k in (1, 2, 3))},
  {', '.join(f'count(*) FILTER (WHERE tier_used = {k}) AS n_tier{k}' for k in (1, 2, 3))}
FROM r GROUP BY ALL""")
def q_lazy_sweep(spark, sf_dir):
    """Summary of the threshold sweep: every model sees a row at most once for all 25 configurations."""
    return rounded(R.sweep_summary(L.model_cascade(models()), _samples(spark, sf_dir)))
