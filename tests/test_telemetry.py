import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from escalade.operators.telemetry import _nodes, run_telemetry

T0 = dt.datetime(2024, 1, 1)
SAMPLES = "host string, ts timestamp, id long, mb double"
RUNS = "run long, host string, lo timestamp, hi timestamp"


def brute(samples, runs):
    out = {}
    for run, host, lo, hi in runs:
        rows = sorted((ts, i, v) for h, ts, i, v in samples
                      if None not in (h, ts, v, host, lo, hi) and h == host and lo <= ts <= hi)
        v = [r[2] for r in rows]
        out[run] = (len(v), sum(v) / len(v), v[0], v[-1], max(v), max(v[-1] - v[0], 0.0), max(max(v) - v[0], 0.0)) if v \
            else (0, None, None, None, None, None, None)
    return out


def got(spark, samples, runs, bits):
    r = run_telemetry(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(runs, RUNS), "host", "ts", "id", "mb", "run", "lo", "hi", bits)
    return {x[0]: tuple(x)[1:] for x in r.collect()}


@pytest.mark.parametrize("bits", [18, 22, 40])
def test_overlapping_nested_and_long_windows(spark, bits):
    rnd = random.Random(bits)
    at = lambda s: T0 + dt.timedelta(milliseconds=round(s * 1000))
    # a third of all samples at one time of one host
    samples = [("a", at(rnd.uniform(-50, 900)), i, float(rnd.randrange(100))) for i in range(400)]
    samples += [("a", at(77), 1000 + i, float(i)) for i in range(300)] + [("b", at(rnd.uniform(0, 300)), 2000 + i, 5.0) for i in range(100)]
    samples += [(None, at(1), 1, 1.0), ("a", None, 2, 1.0), ("a", at(3), 3, None)]
    runs = [(i, rnd.choice("abc"), at(lo), at(lo + rnd.choice([0, 0.001, 1, 10, 200, 800]))) for i, lo in enumerate(rnd.uniform(-60, 800) for _ in range(60))]
    runs += [(100, "a", at(77), at(77)), (101, "a", at(-1000), at(10_000)), (102, "a", at(9), at(8)), (103, None, at(1), at(2)),
             (104, "a", at(1), None), (105, "a", samples[5][1], samples[6][1]) if samples[5][1] <= samples[6][1] else (105, "a", samples[6][1], samples[5][1])]
    want, have = brute(samples, runs), got(spark, samples, runs, bits)
    assert want.keys() == have.keys()
    for run, w in want.items():
        assert have[run] == (pytest.approx(w) if w[0] else w), run


def test_nodes_cover_each_bucket_once(spark):
    pairs = [(a, z) for a in range(-9, 9) for z in range(a + 1, 12)]
    df = spark.createDataFrame(pairs, "a long, z long").select("a", "z", _nodes(F.col("a"), F.col("z"), 5).alias("n"))
    for r in df.collect():
        cover = sorted(b for x in r.n for b in range(x.node << x.level, (x.node + 1) << x.level))
        assert cover == list(range(r.a, r.z))
        assert max((sum(x.level == k for x in r.n) for k in range(6))) <= 2


def test_no_samples_no_runs_and_windows_without_a_zone(spark):
    assert got(spark, [], [(1, "a", T0, T0)], 20) == {1: (0, None, None, None, None, None, None)}
    assert got(spark, [("a", T0, 1, 1.0)], [], 20) == {}
    s = spark.createDataFrame([("a", T0, 1, 2.0)], SAMPLES).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = spark.createDataFrame([(1, "a", T0, T0)], RUNS)
    for c in ("lo", "hi"):
        r = r.withColumn(c, F.col(c).cast("timestamp_ntz"))
    assert [x.n_samples for x in run_telemetry(s, r, "host", "ts", "id", "mb", "run", "lo", "hi").collect()] == [1]


def test_repeated_run_is_one_row_of_all_its_windows(spark):
    runs = [(1, "a", T0, T0), (1, "a", T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2))]
    samples = [("a", T0, 1, 1.0), ("a", T0 + dt.timedelta(minutes=90), 2, 4.0), ("a", T0 + dt.timedelta(minutes=30), 3, 9.0)]
    assert got(spark, samples, runs, 26) == {1: (2, 2.5, 1.0, 4.0, 4.0, 3.0, 3.0)}
