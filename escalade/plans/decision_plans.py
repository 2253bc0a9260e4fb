"""Plans over the cascade's decisions on ``documents`` (routing and analytics)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from escalade.operators import analysis as A
from escalade.operators import metrics as M
from escalade.operators import routing as R
from escalade.operators.cube import mcnemar, tier_answers
from escalade.operators.labels import label_dictionary
from escalade.plans import cascade as C
from escalade.plans.oracle import with_cascade, with_cascade_extra, with_decisions, with_decisions_extra
from escalade.plans.registry import plan, rounded
from escalade.schemas import DECISION_COLUMNS
from escalade.sources.tables import read_table

# The configuration pair compared by McNemar and the single route shown.
MCNEMAR_A = "pipeline_theta1_0.70_theta2_0.70"
MCNEMAR_B = "ablation_tier1_only"
ROUTE_THETA1, ROUTE_THETA2 = 0.7, 0.7
T2S = list(R.DEFAULT_THETAS)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of all 28 configurations (from the fitted cascade's wide scores)."""
    return C.build(spark, sf_dir).decisions()


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of all 28 configurations in groups (from the fitted cascade's cube)."""
    return C.build(spark, sf_dir).outcomes()


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_dictionary(read_table(spark, sf_dir, "documents"), "lang")


DEC_COLS = "sample_idx, tier_used, prediction, gold_label, correct, round(confidence, 6) AS confidence, " \
           "round(latency_ms, 6) AS latency_ms, bytes_sent"


# ---------------------------------------------------------------- routing

@plan("route", with_cascade(f"""
SELECT sample_id AS sample_idx, tier_used,
       (CASE tier_used WHEN 1 THEN pred1 WHEN 2 THEN pred2 ELSE pred3 END)::INT AS prediction,
       round(CASE tier_used WHEN 1 THEN conf1 WHEN 2 THEN conf2 ELSE conf3 END, 6) AS confidence
FROM (SELECT *, CASE WHEN conf1 >= {ROUTE_THETA1} THEN 1 WHEN conf2 >= {ROUTE_THETA2} THEN 2 ELSE 3 END AS tier_used
      FROM wide)"""))
def q_route(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    d = R.route_wide(dc.wide(), ROUTE_THETA1, ROUTE_THETA2, dc.cascade.costs)
    return rounded(d.select("sample_idx", "tier_used", "prediction", "confidence"))


@plan("run_cascade", with_decisions(
    f"SELECT {DEC_COLS} FROM decisions WHERE config = '{R.config_name(ROUTE_THETA1, ROUTE_THETA2)}'"))
def q_run_cascade(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    return rounded(R.route_wide(dc.wide(), ROUTE_THETA1, ROUTE_THETA2, dc.cascade.costs))


def _one(dc: C.DocumentCascade, config: str) -> DataFrame:
    """Decisions of one configuration, read off the wide table."""
    return R.decisions_from_wide(dc.wide(), dc.cascade.costs, configs=[config]).select(*DECISION_COLUMNS)


@plan("ablation_tier1", with_decisions(f"SELECT {DEC_COLS} FROM decisions WHERE config = 'ablation_tier1_only'"))
def q_ablation_tier1(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    return rounded(_one(dc, "ablation_tier1_only"))


@plan("ablation_tier3", with_decisions(f"SELECT {DEC_COLS} FROM decisions WHERE config = 'ablation_tier3_only'"))
def q_ablation_tier3(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    return rounded(_one(dc, "ablation_tier3_only"))


@plan("ablation_two_tier", with_decisions(f"SELECT {DEC_COLS} FROM decisions WHERE config = 'ablation_two_tier'"))
def q_ablation_two_tier(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    return rounded(_one(dc, "ablation_two_tier"))


@plan("sweep_decisions", with_decisions(
    f"SELECT config, theta1, theta2, {DEC_COLS} FROM decisions WHERE theta1 IS NOT NULL"))
def q_sweep_decisions(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    grid = [R.config_name(a, b) for a in R.DEFAULT_THETAS for b in R.DEFAULT_THETAS]
    return rounded(R.decisions_from_wide(dc.wide(), dc.cascade.costs, configs=grid))


def _rates_sql(dp: int | None) -> str:
    r = (lambda e: f"round({e}, {dp})") if dp is not None else (lambda e: e)
    return f"""
SELECT config, max(theta1) AS theta1, max(theta2) AS theta2,
       {r("avg(correct::INT)")} AS accuracy, {r("avg(latency_ms)")} AS mean_latency_ms,
       {r("count(*) FILTER (WHERE tier_used = 1) / count(*)")} AS rate_tier1,
       {r("count(*) FILTER (WHERE tier_used = 2) / count(*)")} AS rate_tier2,
       {r("count(*) FILTER (WHERE tier_used = 3) / count(*)")} AS rate_tier3,
       count(*) FILTER (WHERE tier_used = 1) AS n_tier1,
       count(*) FILTER (WHERE tier_used = 2) AS n_tier2,
       count(*) FILTER (WHERE tier_used = 3) AS n_tier3
FROM decisions GROUP BY config"""


RATES_SQL = _rates_sql(6)
RATES_RAW_SQL = _rates_sql(None)


@plan("sweep_summary", with_decisions(f"SELECT * FROM ({RATES_SQL}) WHERE theta1 IS NOT NULL"))
def q_sweep_summary(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    return rounded(R.summary_from_wide(dc.wide(), dc.cascade.costs))


# ---------------------------------------------------------------- analytics

@plan("escalation_rates", with_decisions(RATES_SQL))
def q_escalation_rates(spark, sf_dir):
    return rounded(A.escalation_rates(outcomes(spark, sf_dir)))


@plan("escalation_thresholded", with_decisions(f"SELECT * FROM ({RATES_SQL}) WHERE theta1 IS NOT NULL"))
def q_escalation_thresholded(spark, sf_dir):
    return rounded(A.thresholded_only(A.escalation_rates(outcomes(spark, sf_dir))))


@plan("escalation_ablations", with_decisions(f"SELECT * FROM ({RATES_SQL}) WHERE theta1 IS NULL"))
def q_escalation_ablations(spark, sf_dir):
    return rounded(A.ablations_only(A.escalation_rates(outcomes(spark, sf_dir))))


PARETO_CTES = f"""rates AS ({RATES_RAW_SQL}),
pts AS (SELECT * FROM rates WHERE theta1 IS NOT NULL)"""
PARETO_SQL = """
SELECT config, theta1, theta2, round(accuracy, 6) AS accuracy, round(mean_latency_ms, 6) AS mean_latency_ms,
       round(rate_tier1, 6) AS rate_tier1, round(rate_tier2, 6) AS rate_tier2, round(rate_tier3, 6) AS rate_tier3,
       n_tier1, n_tier2, n_tier3
FROM pts p
WHERE NOT EXISTS (
  SELECT 1 FROM pts q
  WHERE q.mean_latency_ms <= p.mean_latency_ms AND q.accuracy >= p.accuracy
    AND (q.mean_latency_ms < p.mean_latency_ms OR q.accuracy > p.accuracy))"""


@plan("pareto_front", with_decisions_extra(PARETO_CTES, PARETO_SQL))
def q_pareto_front(spark, sf_dir):
    rates = A.thresholded_only(A.escalation_rates(outcomes(spark, sf_dir)))
    return rounded(A.pareto_front(rates, "mean_latency_ms", "accuracy"))


@plan("optimal_config", with_decisions(f"""
SELECT * FROM ({RATES_SQL}) WHERE theta1 IS NOT NULL
ORDER BY accuracy DESC, mean_latency_ms ASC, config LIMIT 1"""))
def q_optimal_config(spark, sf_dir):
    rates = A.thresholded_only(A.escalation_rates(outcomes(spark, sf_dir)))
    return rounded(A.optimal_config(rates))


@plan("bytes_per_correct", with_decisions("""
SELECT config, round_even(sum(bytes_sent)::DOUBLE / nullif(count(*) FILTER (WHERE correct), 0), 2) AS bytes_per_correct
FROM decisions GROUP BY config"""))
def q_bytes_per_correct(spark, sf_dir):
    return A.bytes_per_correct(outcomes(spark, sf_dir))


# p-value: 1 - erf(sqrt(s/2)) with erf(x) = 2/sqrt(pi) e^{-x^2} sum_n x^{2n+1} 4^n n! / (2n+1)!
MCNEMAR_CTES = f"""a AS (SELECT sample_idx, gold_label, prediction AS pa FROM decisions WHERE config = '{MCNEMAR_A}'),
b AS (SELECT sample_idx, prediction AS pb FROM decisions WHERE config = '{MCNEMAR_B}'),
cells AS (
  SELECT count(*) FILTER (WHERE pa = gold_label AND pb = gold_label) AS n_both_correct,
         count(*) FILTER (WHERE pa = gold_label AND pb <> gold_label) AS n_a_only,
         count(*) FILTER (WHERE pa <> gold_label AND pb = gold_label) AS n_b_only,
         count(*) FILTER (WHERE pa <> gold_label AND pb <> gold_label) AS n_both_wrong
  FROM a JOIN b USING (sample_idx)),
st AS (SELECT *, CASE WHEN n_a_only + n_b_only = 0 THEN 0.0
                 ELSE power(abs(n_a_only - n_b_only) - 1.0, 2) / (n_a_only + n_b_only) END AS statistic FROM cells),
pv AS (
  SELECT st.*, CASE WHEN n_a_only + n_b_only = 0 OR statistic = 0 THEN 1.0
    ELSE 1.0 - 2.0 / sqrt(pi()) * exp(-statistic / 2.0) *
      (SELECT sum(exp((2 * n + 1) * ln(sqrt(statistic / 2.0)) + n * ln(4.0) + lgamma(n + 1) - lgamma(2 * n + 2)))
       FROM range(0, 2000) t(n)) END AS p_value
  FROM st)"""
MCNEMAR_SQL = f"""
SELECT '{MCNEMAR_A}' AS config_a, '{MCNEMAR_B}' AS config_b, n_both_correct, n_a_only, n_b_only, n_both_wrong,
       round_even(statistic, 6) AS statistic, round_even(greatest(p_value, 0.0), 6) AS p_value, p_value < 0.05 AS significant,
       0.05::DOUBLE AS alpha
FROM pv"""


@plan("mcnemar", with_decisions_extra(MCNEMAR_CTES, MCNEMAR_SQL))
def q_mcnemar(spark, sf_dir):
    return mcnemar(C.build(spark, sf_dir).cube(), MCNEMAR_A, MCNEMAR_B)


@plan("errors_by_tier", with_decisions("""
SELECT c.config, t.tier, count(d.sample_idx) AS n, count(*) FILTER (WHERE d.correct) AS correct,
       count(d.sample_idx) - count(*) FILTER (WHERE d.correct) AS wrong,
       round(CASE WHEN count(d.sample_idx) = 0 THEN NULL
             ELSE (count(*) FILTER (WHERE d.correct))::DOUBLE / count(d.sample_idx) END, 6) AS accuracy
FROM (SELECT DISTINCT config FROM decisions) c CROSS JOIN (VALUES (1), (2), (3)) t(tier)
LEFT JOIN decisions d ON d.config = c.config AND d.tier_used = t.tier
GROUP BY c.config, t.tier"""))
def q_errors_by_tier(spark, sf_dir):
    return rounded(A.errors_by_tier(outcomes(spark, sf_dir)))


DICT_SQL = "(SELECT lang AS class, (row_number() OVER (ORDER BY lang) - 1)::INT AS label_id FROM (SELECT DISTINCT lang FROM documents))"


@plan("errors_by_class", with_decisions(f"""
SELECT config, class, n_errors, round_even(n_errors * 100.0 / sum(n_errors) OVER (PARTITION BY config), 1) AS pct_of_all_errors
FROM (SELECT config, coalesce(k.class, 'unknown') AS class, count(*) AS n_errors
      FROM decisions d LEFT JOIN {DICT_SQL} k ON k.label_id = d.gold_label
      WHERE NOT d.correct GROUP BY ALL)"""))
def q_errors_by_class(spark, sf_dir):
    return A.errors_by_class(outcomes(spark, sf_dir), _dictionary(spark, sf_dir))


@plan("escalation_effect", with_decisions("""
SELECT config, round(avg(CASE WHEN tier_used > 1 THEN correct::INT END), 6) AS escalation_corrective_rate,
       count(*) FILTER (WHERE tier_used > 1) AS n_escalated, count(*) FILTER (WHERE NOT correct) AS n_total_errors
FROM decisions GROUP BY config"""))
def q_escalation_effect(spark, sf_dir):
    return rounded(A.escalation_effect(outcomes(spark, sf_dir)))


@plan("summarise", with_decisions("""
SELECT config, round_even(avg(correct::INT), 4) AS accuracy, round_even(avg(latency_ms), 2) AS mean_lat_ms,
       count(*) FILTER (WHERE tier_used = 1) AS tier1_n, count(*) FILTER (WHERE tier_used = 2) AS tier2_n,
       count(*) FILTER (WHERE tier_used = 3) AS tier3_n
FROM decisions GROUP BY config"""))
def q_summarise(spark, sf_dir):
    return A.summarise(outcomes(spark, sf_dir))


@plan("tier_counts", with_decisions("SELECT config, tier_used, count(*) AS n FROM decisions GROUP BY ALL"))
def q_tier_counts(spark, sf_dir):
    return A.tier_counts(outcomes(spark, sf_dir))


def _matrix_sql(metric: str) -> str:
    cols = ", ".join(f"round(max({metric}) FILTER (WHERE theta2 = {t}), 6) AS theta2_{t:.2f}".replace("theta2_0.", "theta2_0_")
                     for t in T2S)
    return with_decisions(f"SELECT theta1, {cols} FROM ({RATES_RAW_SQL}) WHERE theta1 IS NOT NULL GROUP BY theta1")


@plan("sweep_matrix", _matrix_sql("accuracy"))
def q_sweep_matrix(spark, sf_dir):
    rates = A.escalation_rates(outcomes(spark, sf_dir))
    return rounded(A.sweep_matrix(rates, "accuracy", T2S))


@plan("sweep_matrix_latency", _matrix_sql("mean_latency_ms"))
def q_sweep_matrix_latency(spark, sf_dir):
    rates = A.escalation_rates(outcomes(spark, sf_dir))
    return rounded(A.sweep_matrix(rates, "mean_latency_ms", T2S))


# ---------------------------------------------------------------- metrics

@plan("confusion", with_decisions("SELECT config, gold_label AS gold, prediction AS pred, count(*) AS n FROM decisions GROUP BY ALL"))
def q_confusion(spark, sf_dir):
    return M.confusion(outcomes(spark, sf_dir))


PERCLASS_SQL = """
pc AS (
  SELECT config, label, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted FROM (
    SELECT config, gold_label AS label, (gold_label = prediction)::INT AS tp, 1 AS support, 0 AS predicted FROM decisions
    UNION ALL
    SELECT config, prediction, 0, 0, 1 FROM decisions) GROUP BY ALL),
prf AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS precision,
                  coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall FROM pc))"""


@plan("macro_f1", with_decisions_extra(PERCLASS_SQL, """
SELECT config, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro
FROM prf GROUP BY config"""))
def q_macro_f1(spark, sf_dir):
    return rounded(M.macro_f1(outcomes(spark, sf_dir)))


@plan("macro_f1_fixed", with_decisions_extra(PERCLASS_SQL, f"""
SELECT config, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
       round(coalesce(sum(f1) FILTER (WHERE label IN (SELECT label_id FROM {DICT_SQL})), 0)
             / (SELECT count(*) FROM {DICT_SQL}), 6) AS f1_macro
FROM prf GROUP BY config"""))
def q_macro_f1_fixed(spark, sf_dir):
    return rounded(M.macro_f1_fixed(outcomes(spark, sf_dir), _dictionary(spark, sf_dir)))


@plan("classification_report", with_decisions_extra(PERCLASS_SQL + f""",
tot AS (
  SELECT config, sum(support)::BIGINT AS n, sum(tp)::BIGINT AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
         sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
         sum(f1 * support) / sum(support) AS wf
  FROM prf GROUP BY config)""", f"""
SELECT config, coalesce(k.class, 'unknown') AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support
FROM prf LEFT JOIN {DICT_SQL} k ON k.label_id = prf.label
UNION ALL SELECT config, 'accuracy', NULL, NULL, round(tp::DOUBLE / n, 6), n FROM tot
UNION ALL SELECT config, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM tot
UNION ALL SELECT config, 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM tot"""))
def q_classification_report(spark, sf_dir):
    return rounded(M.classification_report(outcomes(spark, sf_dir), _dictionary(spark, sf_dir)))


TIER_QUALITY_CTES = """long AS (
  SELECT 1 AS tier, gold_label, pred1 AS prediction FROM wide
  UNION ALL SELECT 2, gold_label, pred2 FROM wide
  UNION ALL SELECT 3, gold_label, pred3 FROM wide),
pc AS (
  SELECT tier, label, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted FROM (
    SELECT tier, gold_label AS label, (gold_label = prediction)::INT AS tp, 1 AS support, 0 AS predicted FROM long
    UNION ALL SELECT tier, prediction, 0, 0, 1 FROM long) GROUP BY ALL),
prf AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS precision,
                  coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall FROM pc))"""


@plan("tier_quality", with_cascade_extra(TIER_QUALITY_CTES, """
SELECT tier, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro
FROM prf GROUP BY tier"""))
def q_tier_quality(spark, sf_dir):
    """Accuracy and macro-F1 of each tier alone, over every document (cross-fitted)."""
    return rounded(M.macro_f1(tier_answers(C.build(spark, sf_dir).cube()), group=("tier",)))
