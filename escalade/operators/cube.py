"""Decision reports from a contingency cube.

Routing depends on a row's confidences only through their place among the thresholds: b1 of
the tier-1 thresholds and b2 of the tier-2 thresholds are at or below them. The cube counts
rows and adds up their bytes by (b1, b2, gold_label, pred1, pred2, pred3): one aggregation over the
scores, combined map-side, and at most (|theta1s| + 2) x (|theta2s| + 1) x classes^4 rows
whatever the input. Every configuration is a reading of the cube, so the reports explode
cube rows over the configurations and never documents.

``outcomes`` has the columns of a decisions relation, with ``n`` rows in each of its rows and
``bytes_sent`` as their sum; the reports of ``analysis`` and ``metrics`` take either.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.operators.analysis import mcnemar_of_cells
from escalade.operators.routing import (DEFAULT_THETAS, DEFAULT_TIER_COST_MS, TWO_TIER_THETA, checked_confidence,
                                        config_name)
from escalade.schemas import check_unit_interval

DIMENSIONS = ("b1", "b2", "gold_label", "pred1", "pred2", "pred3")


@dataclass(frozen=True)
class Grid:
    """The thresholds whose configurations a cube can answer."""

    theta1s: tuple[float, ...] = DEFAULT_THETAS
    theta2s: tuple[float, ...] = DEFAULT_THETAS
    two_tier_theta: float = TWO_TIER_THETA

    @property
    def cuts1(self) -> list[float]:
        return sorted({check_unit_interval("theta1", t) for t in (*self.theta1s, self.two_tier_theta)})

    @property
    def cuts2(self) -> list[float]:
        return sorted({check_unit_interval("theta2", t) for t in self.theta2s})

    def cells(self) -> list[tuple]:
        """(config, mode, theta1, theta2, place of the tier-1 threshold, place of the tier-2 threshold)."""
        at1, at2 = self.cuts1.index, self.cuts2.index
        out = [(config_name(a, b), "cascade", float(a), float(b), at1(float(a)), at2(float(b)))
               for a in self.theta1s for b in self.theta2s]
        return out + [("ablation_tier1_only", "tier1", None, None, None, None),
                      ("ablation_tier3_only", "tier3", None, None, None, None),
                      ("ablation_two_tier", "two_tier", None, None, at1(float(self.two_tier_theta)), None)]


GRID = Grid()


def _place(cuts: Sequence[float], conf: Column) -> Column:
    """How many of the thresholds a confidence reaches."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= conf))


def decision_cube(wide: DataFrame, grid: Grid = GRID) -> DataFrame:
    """(b1, b2, gold_label, pred1..3, n, bytes_sent) of a wide score table.

    Confidences are checked where a configuration reads them; a tier that no configuration
    reaches for a row may have none.
    """
    conf1 = checked_confidence(F.col("conf1"))
    reached = F.col("conf1") < F.lit(max(float(t) for t in grid.theta1s))
    b2 = F.when(reached, _place(grid.cuts2, checked_confidence(F.col("conf2")))).otherwise(F.lit(0))
    rows = wide.select(_place(grid.cuts1, conf1).alias("b1"), b2.alias("b2"),
                       *[F.col(c).cast("int").alias(c) for c in DIMENSIONS[2:]], F.col("bytes_sent").cast("long").alias("bytes_sent"))
    return rows.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_sent").alias("bytes_sent"))


def _tier(mode: Column, i: Column, j: Column) -> Column:
    """The tier that answers a cube row under a configuration."""
    return (F.when(mode == "tier1", F.lit(1)).when(mode == "tier3", F.lit(3)).when(F.col("b1") > i, F.lit(1))
            .when(mode == "two_tier", F.lit(2)).when(F.col("b2") > j, F.lit(2)).otherwise(F.lit(3)))


def _prediction(tier: Column) -> Column:
    pred = F.when(tier == 1, F.col("pred1")).when(tier == 2, F.col("pred2")).otherwise(F.col("pred3"))
    return F.when(pred.isNull(), F.raise_error(F.concat(
        F.lit("no score of tier "), tier.cast("string"), F.lit(" for samples: "), F.col("n").cast("string")))).otherwise(pred)


def _literal(cell: tuple) -> Column:
    names = ("config", "mode", "theta1", "theta2", "i", "j")
    kinds = ("string", "string", "double", "double", "int", "int")
    return F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(cell, kinds, names)])


def outcomes(cube: DataFrame, costs: Sequence[float] = DEFAULT_TIER_COST_MS, grid: Grid = GRID,
             configs: Sequence[str] | None = None) -> DataFrame:
    """Decisions of all (or the named) configurations, grouped: config, theta1, theta2, tier_used,
    prediction, gold_label, correct, latency_ms, n, bytes_sent."""
    cells = [c for c in grid.cells() if configs is None or c[0] in configs]
    missing = set(configs or ()) - {c[0] for c in cells}
    if missing:
        raise ValueError(f"the cube has no configuration {', '.join(sorted(missing))}")
    g = cube.select("*", F.explode(F.array(*[_literal(c) for c in cells])).alias("g"))
    tier = _tier(F.col("g.mode"), F.col("g.i"), F.col("g.j"))
    g = g.withColumn("tier_used", tier).withColumn("prediction", _prediction(F.col("tier_used")))
    c1, c2, c3 = (F.lit(float(c)) for c in costs)
    latency = (F.when(F.col("g.mode") == "tier3", c3).when(F.col("tier_used") == 1, c1)
               .when(F.col("tier_used") == 2, c1 + c2).otherwise(c1 + c2 + c3))
    return g.select("g.config", "g.theta1", "g.theta2", "tier_used", "prediction", "gold_label",
                    (F.col("prediction") == F.col("gold_label")).alias("correct"), latency.alias("latency_ms"), "n", "bytes_sent")


def mcnemar(cube: DataFrame, config_a: str, config_b: str, grid: Grid = GRID) -> DataFrame:
    """McNemar test of two configurations: a cube row holds both their answers, so they are paired by construction."""
    known = {c[0]: c for c in grid.cells()}
    if missing := {config_a, config_b} - set(known):
        raise ValueError(f"the cube has no configuration {', '.join(sorted(missing))}")

    def right(config: str) -> Column:
        _, mode, _, _, i, j = known[config]
        return _prediction(_tier(F.lit(mode), F.lit(i).cast("int"), F.lit(j).cast("int"))) == F.col("gold_label")

    rows = cube.select("n", right(config_a).alias("a"), right(config_b).alias("b"))
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    a, b = F.col("a"), F.col("b")
    cells = rows.agg(add(a & b).alias("n_both_correct"), add(a & ~b).alias("n_a_only"), add(~a & b).alias("n_b_only"),
                     add(~a & ~b).alias("n_both_wrong"), add(F.lit(True)).alias("n"), F.lit(0).alias("n_unpaired"))
    return mcnemar_of_cells(cells, config_a, config_b)


def tier_answers(cube: DataFrame) -> DataFrame:
    """(tier, gold_label, prediction, n): what each tier alone answers."""
    each = F.array(*[F.struct(F.lit(k).alias("tier"), F.col(f"pred{k}").alias("prediction")) for k in (1, 2, 3)])
    return cube.select("gold_label", "n", F.explode(each).alias("t")).select("t.tier", "gold_label", "t.prediction", "n")
