"""Plans over keys: completeness of two tables, positions, numbering of many values."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.operators.completeness import completeness
from escalade.operators.indexing import positional_index
from escalade.operators.labels import label_dictionary
from escalade.plans.registry import plan
from escalade.plans.text_plans import _doc_tokens, _tok_sql
from escalade.sources.tables import read_table

# Fixed values: (samples, key, scores, key) of the compared tables.
PAIRS = (("documents", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"),
         ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("labels", "doc_id", "documents", "doc_id"))


def _pair_sql(i: int, a: str, ka: str, b: str, kb: str) -> str:
    return f"""SELECT {i} AS pair, '{a}' AS samples, '{b}' AS scores, sum(m)::BIGINT AS n_samples, sum(n)::BIGINT AS n_scores,
  count(*) FILTER (WHERE m <> n) = 0 AS complete, count(*) FILTER (WHERE n < m) AS n_missing,
  count(*) FILTER (WHERE m = 0) AS n_extra, count(*) FILTER (WHERE m > 0 AND n > m) AS n_repeated
FROM (SELECT k, sum(m) AS m, sum(n) AS n FROM (SELECT {ka} AS k, 1 AS m, 0 AS n FROM {a} UNION ALL SELECT {kb}, 0, 1 FROM {b}) GROUP BY k)"""


@plan("completeness", " UNION ALL ".join(_pair_sql(i, *p) for i, p in enumerate(PAIRS)))
def q_completeness(spark, sf_dir):
    """Whether pairs of tables hold the same keys equally often, and how they differ."""
    out = None
    for i, (a, ka, b, kb) in enumerate(PAIRS):
        left = read_table(spark, sf_dir, a).select(F.col(ka).alias("k"))
        right = read_table(spark, sf_dir, b).select(F.col(kb).alias("k"))
        row = completeness(left, right, ["k"]).select(F.lit(i).alias("pair"), F.lit(a).alias("samples"), F.lit(b).alias("scores"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@plan("positional_index", "SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def q_positional_index(spark, sf_dir):
    """Every event's place in time."""
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return positional_index(events, ["ts", "event_id"]).select("event_id", "event_type", "position")


@plan("label_dictionary", f"""SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS label_id, label
FROM (SELECT DISTINCT unnest({_tok_sql('text')}) AS label FROM documents)""")
def q_label_dictionary(spark, sf_dir):
    """Numbers of all distinct words of the documents, in their order."""
    return label_dictionary(_doc_tokens(spark, sf_dir).select(F.explode("terms").alias("term")), "term")
