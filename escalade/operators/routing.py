"""Cascade routing: confidence rules, staged tier evaluation, sweeps, ablations.

A tier is evaluated only on the rows that reach it: each stage is a real
``filter`` on the previous tier's confidence followed by a semi-join back to
the samples, so an expensive scorer never sees rows that stopped earlier
(a Python scorer inside ``CASE WHEN`` would still see every row).

For a grid of thresholds the tiers are scored **once**, for the rows that
reach them under the most permissive threshold, and every configuration is
then a projection of that one wide table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.schemas import check_unit_interval

# Recorded cost per tier visit in milliseconds (tier 1, tier 2, tier 3).
DEFAULT_TIER_COST_MS = (0.58, 2.34, 128.5)
# The threshold grid swept for both tiers, and the two-tier ablation threshold.
DEFAULT_THETAS = (0.5, 0.6, 0.7, 0.8, 0.9)
TWO_TIER_THETA = 0.7

Scorer = Callable[[DataFrame], DataFrame]


# --------------------------------------------------------------------------
# Rules (Column -> Column)
# --------------------------------------------------------------------------

def checked_confidence(conf: Column) -> Column:
    """Fail the row when a confidence is NULL, NaN or outside [0, 1]."""
    return F.when(conf.isNull() | ~conf.between(0.0, 1.0),
                  F.raise_error(F.concat(F.lit("a confidence lies outside 0 to 1: "),
                                         F.coalesce(conf.cast("string"), F.lit("null"))))).otherwise(conf)


def should_escalate(conf: Column, theta: float) -> Column:
    """Strictly below the threshold escalates; equality stays."""
    return checked_confidence(conf) < F.lit(check_unit_interval("threshold", theta))


def confidence_rule(theta: float) -> Callable[[Column, Column], Column]:
    """Rule on the probability vector: ``max(proba) < theta`` (proba unchecked)."""
    t = check_unit_interval("threshold", theta)
    return lambda text, proba: F.array_max(proba) < F.lit(t)


def length_rule(limit: int, tokens: Callable[[Column], Column] | None = None) -> Callable[[Column, Column], Column]:
    """Rule on the text: more than ``limit`` tokens escalates (whitespace split
    unless an analyzer is given)."""
    if limit < 0:
        raise ValueError(f"limit must be >= 0, got {limit}")
    from escalade.functions.text import whitespace_count

    def rule(text: Column, proba: Column) -> Column:
        n = F.size(tokens(text)) if tokens is not None else whitespace_count(text)
        return n > F.lit(limit)
    return rule


RULES = {"confidence": confidence_rule, "length": length_rule}


def strategy(name: str, **params) -> Callable[[Column, Column], Column]:
    """An escalation rule by name: ``strategy("confidence", theta=0.7)`` or
    ``strategy("length", limit=20)``. A rule maps (text, proba) columns to a
    boolean column; the confidence rule reads the probabilities, any other
    rule the text."""
    if name not in RULES:
        raise ValueError(f"unknown strategy {name!r}; known: {sorted(RULES)}")
    return RULES[name](**params)


def any_rule(*rules: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Escalate when any rule fires (e.g. low confidence OR long input)."""
    def rule(text: Column, proba: Column) -> Column:
        out = F.lit(False)
        for r in rules:
            out = out | r(text, proba)
        return out
    return rule


# --------------------------------------------------------------------------
# Staged scoring
# --------------------------------------------------------------------------

@dataclass
class Cascade:
    """Three scorers, each ``DataFrame(samples) -> DataFrame(sample_id, label, proba, confidence, ...)``."""

    tier1: Scorer
    tier2: Scorer
    tier3: Scorer
    costs: Sequence[float] = DEFAULT_TIER_COST_MS
    # optional: all three tiers for every row in one pass, as a wide table
    # (sample_id, gold_label, bytes_sent, pred1, conf1, pred2, conf2, pred3, conf3)
    fused: Callable[[DataFrame], DataFrame] | None = None
    # optional: (samples, theta1_max, theta2_max) -> the table of ``wide`` without its joins
    one_pass: Callable[[DataFrame, float, float], DataFrame] | None = None

    def __post_init__(self):
        for k, tier in enumerate((self.tier1, self.tier2, self.tier3), 1):
            if not callable(tier):
                raise TypeError(f"tier {k} must be a function of samples, not {tier!r}")

    def wide(self, samples: DataFrame, theta1_max: float, theta2_max: float) -> DataFrame:
        """One row per sample: pred/conf of every tier it can reach under
        thresholds up to (theta1_max, theta2_max); unreached tiers are NULL.

        ``samples`` holds sample_id, gold_label, bytes_sent and what the scorers
        read (text, or its token array ``terms``).
        """
        if self.one_pass is not None:
            return self.one_pass(samples, theta1_max, theta2_max)
        s1 = _slim(self.tier1(samples), 1)
        esc1 = s1.where(F.col("conf1") < F.lit(theta1_max)).select("sample_id")
        s2_in = samples.join(esc1, "sample_id", "left_semi")
        s2 = _slim(self.tier2(s2_in), 2)
        esc2 = s2.where(F.col("conf2") < F.lit(theta2_max)).select("sample_id")
        s3_in = samples.join(esc2, "sample_id", "left_semi")
        s3 = _slim(self.tier3(s3_in), 3)
        return _with_all(samples, s1).join(s2, "sample_id", "left").join(s3, "sample_id", "left")


def _once(scores: DataFrame) -> DataFrame:
    """(sample_id, label, confidence) of scores; a sample scored twice fails (the count
    shares the exchange of the join that follows)."""
    s = scores.groupBy("sample_id").agg(F.count(F.lit(1)).alias("__n"), F.max("label").alias("label"), F.max("confidence").alias("confidence"))
    return s.select("sample_id", F.when(F.col("__n") > 1, F.raise_error(F.concat(
        F.col("__n").cast("string"), F.lit(" scores for sample "), F.col("sample_id").cast("string"))))
        .otherwise(F.col("label")).alias("label"), "confidence")


def _slim(scores: DataFrame, k: int) -> DataFrame:
    return _once(scores).select("sample_id", F.col("label").alias(f"pred{k}"), F.col("confidence").alias(f"conf{k}"))


def _with_all(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """(sample_id, gold_label, bytes_sent) with the scores' columns; a score without a sample fails."""
    base = samples.select("sample_id", "gold_label", "bytes_sent", F.lit(True).alias("__is"))
    j = base.join(scores, "sample_id", "full_outer")
    return j.withColumn("sample_id", F.when(F.col("__is").isNull(), F.raise_error(F.concat(
        F.lit("a score for sample "), F.coalesce(F.col("sample_id").cast("string"), F.lit("null")), F.lit(", which isn't among the samples"))))
        .otherwise(F.col("sample_id"))).drop("__is")


def config_name(theta1: float, theta2: float) -> str:
    return f"pipeline_theta1_{theta1:.2f}_theta2_{theta2:.2f}"


def grid_column(theta1s: Sequence[float], theta2s: Sequence[float]) -> Column:
    """Literal array of (config, theta1, theta2) structs: exploding it pairs
    each row with every configuration without a join."""
    cells = []
    for t1 in theta1s:
        for t2 in theta2s:
            check_unit_interval("theta1", t1)
            check_unit_interval("theta2", t2)
            cells.append(F.struct(F.lit(config_name(t1, t2)).alias("config"),
                                  F.lit(float(t1)).alias("theta1"), F.lit(float(t2)).alias("theta2")))
    return F.array(*cells)


def scored(pred: Column) -> Column:
    """Fail a row whose tier gave no prediction (a scorer that skips rows)."""
    return F.when(pred.isNull(), F.raise_error(F.concat(
        F.lit("no score for sample "), F.col("sample_id").cast("string")))).otherwise(pred)


def decide(wide: DataFrame, theta1: Column, theta2: Column, costs: Sequence[float]) -> list[Column]:
    """Decision columns of one configuration over a wide row."""
    c1, c2, c3 = (F.lit(float(c)) for c in costs)
    conf1 = checked_confidence(F.col("conf1"))
    tier = (F.when(conf1 >= theta1, F.lit(1))
            .when(checked_confidence(F.col("conf2")) >= theta2, F.lit(2))
            .otherwise(F.lit(3)))
    pick = lambda a, b, c: F.when(tier == 1, F.col(a)).when(tier == 2, F.col(b)).otherwise(F.col(c))
    pred = scored(pick("pred1", "pred2", "pred3"))
    latency = F.when(tier == 1, c1).when(tier == 2, c1 + c2).otherwise(c1 + c2 + c3)
    return [
        F.col("sample_id").alias("sample_idx"),
        tier.alias("tier_used"),
        pred.cast("int").alias("prediction"),
        F.col("gold_label").cast("int").alias("gold_label"),
        (pred == F.col("gold_label")).alias("correct"),
        pick("conf1", "conf2", "conf3").alias("confidence"),
        latency.alias("latency_ms"),
        F.col("bytes_sent").cast("int").alias("bytes_sent"),
    ]


def route(cascade: Cascade, samples: DataFrame, theta1: float, theta2: float, fused: bool = False) -> DataFrame:
    """Decisions of one configuration (tiers 2 and 3 only where reached).

    ``fused``: when the cascade offers a fused pass (native tiers sharing one
    fit), score all tiers at once instead of in stages -- same decisions,
    cheaper when no tier is expensive."""
    t1 = check_unit_interval("theta1", theta1)
    t2 = check_unit_interval("theta2", theta2)
    w = cascade.fused(samples) if fused and cascade.fused is not None else cascade.wide(samples, t1, t2)
    return w.select(*decide(w, F.lit(t1), F.lit(t2), cascade.costs))


def route_wide(wide: DataFrame, theta1: float, theta2: float,
               costs: Sequence[float] = DEFAULT_TIER_COST_MS) -> DataFrame:
    """Decisions of one configuration over a table that holds every tier's scores
    (``wide_scores``): a projection, no join and no shuffle."""
    t1, t2 = check_unit_interval("theta1", theta1), check_unit_interval("theta2", theta2)
    return wide.select(*decide(wide, F.lit(t1), F.lit(t2), costs))


def sweep_decisions(cascade: Cascade, samples: DataFrame, theta1s: Sequence[float] = DEFAULT_THETAS,
                    theta2s: Sequence[float] = DEFAULT_THETAS) -> DataFrame:
    """Decisions for every (theta1, theta2): config, theta1, theta2 + decision columns.

    Tiers are scored once; the grid is a literal array exploded per row.
    """
    w = cascade.wide(samples, max(theta1s), max(theta2s))
    g = w.select("*", F.explode(grid_column(theta1s, theta2s)).alias("g"))
    return g.select(F.col("g.config").alias("config"), F.col("g.theta1").alias("theta1"),
                    F.col("g.theta2").alias("theta2"),
                    *decide(g, F.col("g.theta1"), F.col("g.theta2"), cascade.costs))


def sweep_summary(cascade: Cascade, samples: DataFrame, theta1s: Sequence[float] = DEFAULT_THETAS,
                  theta2s: Sequence[float] = DEFAULT_THETAS) -> DataFrame:
    """Per-configuration summary without expanding rows by the grid size.

    A row's route depends on its confidences only through b1 = #{theta1 <= conf1}
    and b2 = #{theta2 <= conf2}: under the i-th smallest theta1 it stays at
    tier 1 iff i < b1. Rows are aggregated per (b1, b2) bin -- at most
    (|theta1s|+1) x (|theta2s|+1) rows -- and the bins are combined per cell.
    """
    t1s, t2s = sorted(map(float, theta1s)), sorted(map(float, theta2s))
    return summary_from_wide(cascade.wide(samples, max(t1s), max(t2s)), cascade.costs, t1s, t2s)


def summary_from_wide(w: DataFrame, costs: Sequence[float] = DEFAULT_TIER_COST_MS,
                      theta1s: Sequence[float] = DEFAULT_THETAS, theta2s: Sequence[float] = DEFAULT_THETAS) -> DataFrame:
    """Binned sweep summary over a wide per-sample table (see ``sweep_summary``)."""
    t1s, t2s = sorted(map(float, theta1s)), sorted(map(float, theta2s))
    c1, c2, c3 = (float(c) for c in costs)
    conf1 = checked_confidence(F.col("conf1"))
    b1 = F.size(F.filter(F.array(*[F.lit(t) for t in t1s]), lambda t: t <= conf1))
    b2 = F.coalesce(F.size(F.filter(F.array(*[F.lit(t) for t in t2s]),
                                    lambda t: t <= checked_confidence(F.col("conf2")))), F.lit(0))
    gold = F.col("gold_label")
    bins = (w.select(b1.alias("b1"), F.when(F.col("conf2").isNull(), F.lit(0)).otherwise(b2).alias("b2"),
                     (F.col("pred1") == gold).alias("k1"), (F.col("pred2") == gold).alias("k2"),
                     (F.col("pred3") == gold).alias("k3"))
            .groupBy("b1", "b2")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("k1").alias("k1"),
                 F.count_if("k2").alias("k2"), F.count_if("k3").alias("k3")))
    cells = [F.struct(F.lit(config_name(a, b)).alias("config"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                      F.lit(a).alias("theta1"), F.lit(b).alias("theta2"))
             for i, a in enumerate(t1s) for j, b in enumerate(t2s)]
    x = bins.select("*", F.explode(F.array(*cells)).alias("g"))
    tier = (F.when(F.col("b1") > F.col("g.i"), 1).when(F.col("b2") > F.col("g.j"), 2).otherwise(3))
    x = x.select("g.config", "g.theta1", "g.theta2", "n", tier.alias("t"),
                 F.when(tier == 1, F.col("k1")).when(tier == 2, F.col("k2")).otherwise(F.col("k3")).alias("k"))
    n = F.sum("n")
    agg = x.groupBy("config", "theta1", "theta2").agg(
        n.alias("n_total"),
        F.sum("k").alias("n_correct"),
        *[F.coalesce(F.sum(F.when(F.col("t") == t, F.col("n"))), F.lit(0)).alias(f"n_tier{t}") for t in (1, 2, 3)])
    lat_sum = (F.col("n_tier1") * F.lit(c1) + F.col("n_tier2") * F.lit(c1 + c2)
               + F.col("n_tier3") * F.lit(c1 + c2 + c3))
    return agg.select(
        "config", "theta1", "theta2",
        (F.col("n_correct") / F.col("n_total")).alias("accuracy"),
        (lat_sum / F.col("n_total")).alias("mean_latency_ms"),
        *[(F.col(f"n_tier{t}") / F.col("n_total")).alias(f"rate_tier{t}") for t in (1, 2, 3)],
        *[F.col(f"n_tier{t}").cast("long").alias(f"n_tier{t}") for t in (1, 2, 3)])


# --------------------------------------------------------------------------
# Ablations
# --------------------------------------------------------------------------

def _decisions_from(scores: DataFrame, samples: DataFrame, tier: int, latency: float) -> DataFrame:
    s = _once(scores).withColumnRenamed("confidence", "__conf")
    # every sample must get one score: a missing, repeated or extra one fails (no silent drop)
    j = _with_all(samples, s).withColumn("confidence", F.when(F.col("label").isNull(), F.raise_error(
            F.concat(F.lit("no score for sample "), F.col("sample_id").cast("string")))).otherwise(F.col("__conf")))
    return j.select(F.col("sample_id").alias("sample_idx"), F.lit(tier).alias("tier_used"),
                    F.col("label").cast("int").alias("prediction"), F.col("gold_label").cast("int").alias("gold_label"),
                    (F.col("label") == F.col("gold_label")).alias("correct"),
                    F.col("confidence"), F.lit(float(latency)).alias("latency_ms"),
                    F.col("bytes_sent").cast("int").alias("bytes_sent"))


def ablation_tier1(cascade: Cascade, samples: DataFrame) -> DataFrame:
    return _decisions_from(cascade.tier1(samples), samples, 1, cascade.costs[0])


def ablation_tier3(cascade: Cascade, samples: DataFrame) -> DataFrame:
    """Tier 3 for every row; latency is tier 3's cost alone."""
    return _decisions_from(cascade.tier3(samples), samples, 3, cascade.costs[2])


def ablation_two_tier(cascade: Cascade, samples: DataFrame, theta: float = TWO_TIER_THETA) -> DataFrame:
    """Tier 1, escalate below ``theta`` to tier 2, which is terminal."""
    t = check_unit_interval("theta", theta)
    c1, c2 = (float(c) for c in cascade.costs[:2])
    s1 = _slim(cascade.tier1(samples), 1)
    esc = s1.where(F.col("conf1") < F.lit(t)).select("sample_id")
    s2 = _slim(cascade.tier2(samples.join(esc, "sample_id", "left_semi")), 2)
    w = _with_all(samples, s1).join(s2, "sample_id", "left")
    tier = F.when(checked_confidence(F.col("conf1")) >= F.lit(t), F.lit(1)).otherwise(F.lit(2))
    pred = scored(F.when(tier == 1, F.col("pred1")).otherwise(F.col("pred2")))
    return w.select(F.col("sample_id").alias("sample_idx"), tier.alias("tier_used"),
                    pred.cast("int").alias("prediction"), F.col("gold_label").cast("int").alias("gold_label"),
                    (pred == F.col("gold_label")).alias("correct"),
                    F.when(tier == 1, F.col("conf1")).otherwise(F.col("conf2")).alias("confidence"),
                    F.when(tier == 1, F.lit(c1)).otherwise(F.lit(c1 + c2)).alias("latency_ms"),
                    F.col("bytes_sent").cast("int").alias("bytes_sent"))


ABLATIONS = {
    "ablation_tier1_only": ablation_tier1,
    "ablation_tier3_only": ablation_tier3,
    "ablation_two_tier": ablation_two_tier,
}


def with_config(decisions: DataFrame, config: str, theta1: float | None = None,
                theta2: float | None = None) -> DataFrame:
    """Tag decisions with their configuration (theta NULL for ablations)."""
    return decisions.select(F.lit(config).alias("config"),
                            F.lit(theta1).cast("double").alias("theta1"),
                            F.lit(theta2).cast("double").alias("theta2"), *decisions.columns)


def wide_scores(cascade: Cascade, samples: DataFrame, theta1s: Sequence[float] = DEFAULT_THETAS,
                two_tier_theta: float = TWO_TIER_THETA) -> DataFrame:
    """One row per sample with what every configuration of the sweep and the
    ablations needs: tier 1 and tier 3 on every row (tier 3 alone is an
    ablation), tier 2 on rows below the largest tier-1 threshold in use."""
    t2x = check_unit_interval("theta", two_tier_theta)
    if cascade.fused is not None:
        # native tiers sharing one fit: tier 1 and tier 3 are needed on every
        # row here anyway, and tier 2 costs nothing extra in the same pass
        return cascade.fused(samples)
    s1 = _slim(cascade.tier1(samples), 1)
    esc1 = s1.where(F.col("conf1") < F.lit(max(max(theta1s), t2x))).select("sample_id")
    s2 = _slim(cascade.tier2(samples.join(esc1, "sample_id", "left_semi")), 2)
    s3 = _slim(cascade.tier3(samples), 3)
    return _with_all(samples, s1).join(s2, "sample_id", "left").join(s3, "sample_id", "left")


def decisions_from_wide(wide: DataFrame, costs: Sequence[float] = DEFAULT_TIER_COST_MS,
                        theta1s: Sequence[float] = DEFAULT_THETAS, theta2s: Sequence[float] = DEFAULT_THETAS,
                        two_tier_theta: float = TWO_TIER_THETA, configs: Sequence[str] | None = None) -> DataFrame:
    """Sweep + the three ablations as one relation keyed by config: the 28
    configurations are cells of one literal array exploded over the wide table.
    ``configs`` names the configurations wanted (default: all)."""
    t2x = check_unit_interval("theta", two_tier_theta)
    cells = []
    for t1 in theta1s:
        for t2 in theta2s:
            cells.append((config_name(t1, t2), "cascade", float(t1), float(t2)))
    cells += [("ablation_tier1_only", "tier1", None, None), ("ablation_tier3_only", "tier3", None, None),
              ("ablation_two_tier", "two_tier", t2x, None)]
    cells = [c for c in cells if configs is None or c[0] in configs]
    arr = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(m).alias("mode"),
                             F.lit(a).cast("double").alias("theta1"), F.lit(b).cast("double").alias("theta2"))
                    for c, m, a, b in cells])
    g = wide.select("*", F.explode(arr).alias("g"))
    mode = F.col("g.mode")
    c1, c2, c3 = (F.lit(float(c)) for c in costs)
    conf1 = checked_confidence(F.col("conf1"))
    tier = (F.when(mode == "tier1", F.lit(1)).when(mode == "tier3", F.lit(3))
            .when(conf1 >= F.col("g.theta1"), F.lit(1))
            .when(mode == "two_tier", F.lit(2))
            .when(checked_confidence(F.col("conf2")) >= F.col("g.theta2"), F.lit(2))
            .otherwise(F.lit(3)))
    pick = lambda a, b, c: F.when(tier == 1, F.col(a)).when(tier == 2, F.col(b)).otherwise(F.col(c))
    pred = scored(pick("pred1", "pred2", "pred3"))
    latency = (F.when(mode == "tier3", c3).when(tier == 1, c1).when(tier == 2, c1 + c2)
               .otherwise(c1 + c2 + c3))
    theta1_out = F.when(mode == "cascade", F.col("g.theta1"))
    return g.select(
        F.col("g.config").alias("config"), theta1_out.alias("theta1"), F.col("g.theta2").alias("theta2"),
        F.col("sample_id").alias("sample_idx"), tier.alias("tier_used"), pred.cast("int").alias("prediction"),
        F.col("gold_label").cast("int").alias("gold_label"), (pred == F.col("gold_label")).alias("correct"),
        pick("conf1", "conf2", "conf3").alias("confidence"), latency.alias("latency_ms"),
        F.col("bytes_sent").cast("int").alias("bytes_sent"))


def all_decisions(cascade: Cascade, samples: DataFrame, theta1s: Sequence[float] = DEFAULT_THETAS,
                  theta2s: Sequence[float] = DEFAULT_THETAS, two_tier_theta: float = TWO_TIER_THETA) -> DataFrame:
    """Sweep + the three ablations, one relation keyed by config.

    Tier 3 is scored once for all rows (the tier-3-only ablation needs it) and
    shared with the sweep; tier 2 only for rows below the largest tier-1
    threshold in use.
    """
    wide = wide_scores(cascade, samples, theta1s, two_tier_theta)
    return decisions_from_wide(wide, cascade.costs, theta1s, theta2s, two_tier_theta)
