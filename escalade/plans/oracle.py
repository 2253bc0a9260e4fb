"""Independent SQL (DuckDB dialect) for the registered plans.

The SQL is written in long form -- one row per (sample, class) -- while the
Spark plans use dense per-class arrays, so the two are independent
formulations of the same definitions (see ``escalade.plans.cascade``).
"""

from __future__ import annotations

from escalade.operators.routing import DEFAULT_THETAS, DEFAULT_TIER_COST_MS, TWO_TIER_THETA, config_name
from escalade.plans.cascade import CONF_DP, N_FOLDS, TIER1_VOCAB, TIER2_VOCAB

C1, C2, C3 = DEFAULT_TIER_COST_MS


def _tier_sql(k: int, vocab: int | None, output: str) -> str:
    lim = f"WHERE r <= {vocab}" if vocab is not None else ""
    if output == "softmax":
        zexpr = "(coalesce(ss.s, 0) - coalesce(nt.nt, 0) * h.lnorm) / greatest(coalesce(nt.nt, 0), 1) + h.lp"
    else:
        zexpr = "coalesce(ss.s, 0) - coalesce(nt.nt, 0) * h.lnorm + h.lp"
    head = f"""
voc{k} AS (SELECT term FROM vocab {lim}),
occ{k} AS (SELECT o.* FROM occ o JOIN voc{k} USING (term)),
cnt{k} AS (SELECT fold, gold_label AS label, term, count(*) AS n FROM occ{k} GROUP BY ALL),
tl{k} AS (SELECT label, term, sum(n) AS n FROM cnt{k} GROUP BY ALL),
mdl{k} AS (
  SELECT f.fold, tl.label, tl.term, tl.n - coalesce(c.n, 0) AS n
  FROM tl{k} tl CROSS JOIN folds f
  LEFT JOIN cnt{k} c ON c.fold = f.fold AND c.label = tl.label AND c.term = tl.term),
hdr{k} AS (
  SELECT p.fold, p.label, CASE WHEN p.prior > 0 THEN ln(p.prior) ELSE '-inf'::DOUBLE END AS lp,
         ln(coalesce(t.tot, 0) + (SELECT count(*) FROM voc{k})) AS lnorm
  FROM prior p LEFT JOIN (SELECT fold, label, sum(n) AS tot FROM mdl{k} GROUP BY ALL) t
    ON t.fold = p.fold AND t.label = p.label),
ss{k} AS (
  SELECT o.sample_id, m.label, sum(ln(m.n + 1)) AS s
  FROM occ{k} o JOIN mdl{k} m ON m.fold = o.fold AND m.term = o.term AND m.n > 0
  GROUP BY ALL),
nt{k} AS (SELECT sample_id, count(*) AS nt FROM occ{k} GROUP BY ALL),
z{k} AS (
  SELECT s.sample_id, h.label, {zexpr} AS z
  FROM samples s JOIN hdr{k} h ON h.fold = s.fold
  LEFT JOIN ss{k} ss ON ss.sample_id = s.sample_id AND ss.label = h.label
  LEFT JOIN nt{k} nt ON nt.sample_id = s.sample_id),"""
    if output == "softmax":
        body = f"""
e{k} AS (SELECT sample_id, label, exp(z - max(z) OVER (PARTITION BY sample_id)) AS e FROM z{k}),
p{k} AS (SELECT sample_id, label, round(e / sum(e) OVER (PARTITION BY sample_id), {CONF_DP}) AS p FROM e{k}),
sc{k} AS (
  SELECT sample_id, min(label) FILTER (WHERE p = mp) AS pred{k}, max(mp) AS conf{k}
  FROM (SELECT *, max(p) OVER (PARTITION BY sample_id) AS mp FROM p{k}) GROUP BY sample_id)"""
    else:
        body = f"""
sc{k} AS (
  SELECT sample_id, min(label) FILTER (WHERE z = mz) AS pred{k}, 1.0::DOUBLE AS conf{k}
  FROM (SELECT *, max(z) OVER (PARTITION BY sample_id) AS mz FROM z{k}) GROUP BY sample_id)"""
    return head + body


def cascade_ctes() -> str:
    """CTEs ending in ``wide`` (one row per document, all three tiers scored)."""
    return f"""
dict AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS label_id FROM (SELECT DISTINCT lang FROM documents)),
samples AS (
  SELECT d.doc_id AS sample_id, d.text,
         ((('0x' || substr(md5('fold:' || d.doc_id::VARCHAR), 1, 8))::BIGINT) % {N_FOLDS})::INT AS fold,
         strlen(d.text)::INT AS bytes_sent, k.label_id AS gold_label
  FROM documents d JOIN dict k USING (lang)),
occ AS (
  SELECT * FROM (
    SELECT sample_id, fold, gold_label,
           unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}_]+')) AS term
    FROM samples)
  WHERE regexp_full_match(term, '[a-z]{{2,}}')),
folds AS (SELECT DISTINCT fold FROM range(0, {N_FOLDS}) t(fold)),
vocab AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM occ GROUP BY term),
dcnt AS (SELECT fold, gold_label AS label, count(*) AS n FROM samples GROUP BY ALL),
prior AS (
  SELECT f.fold, l.label,
         coalesce((SELECT sum(n) FROM dcnt d WHERE d.label = l.label AND d.fold <> f.fold), 0)
         / (SELECT sum(n) FROM dcnt d WHERE d.fold <> f.fold) AS prior
  FROM folds f CROSS JOIN (SELECT DISTINCT label FROM dcnt) l),
{_tier_sql(1, TIER1_VOCAB, "softmax")},
{_tier_sql(2, TIER2_VOCAB, "softmax")},
{_tier_sql(3, None, "one_hot")},
wide AS (
  SELECT s.sample_id, s.gold_label, s.bytes_sent, pred1, conf1, pred2, conf2, pred3, conf3
  FROM samples s JOIN sc1 USING (sample_id) JOIN sc2 USING (sample_id) JOIN sc3 USING (sample_id))"""


def _grid_values(theta1s=DEFAULT_THETAS, theta2s=DEFAULT_THETAS) -> str:
    return ", ".join(f"('{config_name(a, b)}', {a}::DOUBLE, {b}::DOUBLE)" for a in theta1s for b in theta2s)


def decisions_ctes() -> str:
    """``cascade_ctes`` + ``decisions`` (28 configurations)."""
    tier = "CASE WHEN conf1 >= g.theta1 THEN 1 WHEN conf2 >= g.theta2 THEN 2 ELSE 3 END"
    return cascade_ctes() + f""",
grid AS (SELECT * FROM (VALUES {_grid_values()}) g(config, theta1, theta2)),
routed AS (SELECT w.*, g.config, g.theta1, g.theta2, {tier} AS tier_used FROM wide w CROSS JOIN grid g),
sweep AS (
  SELECT config, theta1, theta2, sample_id AS sample_idx, tier_used,
         (CASE tier_used WHEN 1 THEN pred1 WHEN 2 THEN pred2 ELSE pred3 END)::INT AS prediction,
         gold_label,
         (CASE tier_used WHEN 1 THEN pred1 WHEN 2 THEN pred2 ELSE pred3 END) = gold_label AS correct,
         CASE tier_used WHEN 1 THEN conf1 WHEN 2 THEN conf2 ELSE conf3 END AS confidence,
         CASE tier_used WHEN 1 THEN {C1}::DOUBLE WHEN 2 THEN {C1}::DOUBLE + {C2}::DOUBLE
              ELSE {C1}::DOUBLE + {C2}::DOUBLE + {C3}::DOUBLE END AS latency_ms,
         bytes_sent
  FROM routed),
abl AS (
  SELECT 'ablation_tier1_only' AS config, NULL::DOUBLE AS theta1, NULL::DOUBLE AS theta2, sample_id AS sample_idx,
         1 AS tier_used, pred1 AS prediction, gold_label, pred1 = gold_label AS correct, conf1 AS confidence,
         {C1}::DOUBLE AS latency_ms, bytes_sent FROM wide
  UNION ALL
  SELECT 'ablation_tier3_only', NULL, NULL, sample_id, 3, pred3, gold_label, pred3 = gold_label, conf3,
         {C3}::DOUBLE, bytes_sent FROM wide
  UNION ALL
  SELECT 'ablation_two_tier', NULL, NULL, sample_id,
         CASE WHEN conf1 >= {TWO_TIER_THETA} THEN 1 ELSE 2 END,
         CASE WHEN conf1 >= {TWO_TIER_THETA} THEN pred1 ELSE pred2 END, gold_label,
         CASE WHEN conf1 >= {TWO_TIER_THETA} THEN pred1 ELSE pred2 END = gold_label,
         CASE WHEN conf1 >= {TWO_TIER_THETA} THEN conf1 ELSE conf2 END,
         CASE WHEN conf1 >= {TWO_TIER_THETA} THEN {C1}::DOUBLE ELSE {C1}::DOUBLE + {C2}::DOUBLE END, bytes_sent
  FROM wide),
decisions AS (SELECT * FROM sweep UNION ALL SELECT * FROM abl)"""


def with_decisions(select_sql: str) -> str:
    return "WITH " + decisions_ctes() + "\n" + select_sql


def with_cascade(select_sql: str) -> str:
    return "WITH " + cascade_ctes() + "\n" + select_sql


def with_decisions_extra(extra_ctes: str, select_sql: str) -> str:
    """``decisions`` CTEs + more CTEs (text starting with the CTE name) + a select."""
    return "WITH " + decisions_ctes() + ",\n" + extra_ctes + "\n" + select_sql


def with_cascade_extra(extra_ctes: str, select_sql: str) -> str:
    """``cascade`` CTEs (ending in ``wide``) + more CTEs + a select."""
    return "WITH " + cascade_ctes() + ",\n" + extra_ctes + "\n" + select_sql
