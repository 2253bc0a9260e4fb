import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from escalade.operators import profile as PR
from escalade.schemas import PROFILE_COLUMNS
from escalade.sources import corpus as CO
from escalade.sources import results as RS


def test_latency_stats_fixture(spark):
    t0 = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([("g", i, t0 + dt.timedelta(seconds=i), v) for i, v in enumerate([500.0, 1.0, 2.0, 3.0, 10.0])],
                                  "grp string, id long, ts timestamp, ms double")
    r = PR.latency_stats(calls, "grp", ["ts", "id"], "id", "ms").collect()[0]
    assert (r.n_samples, r.mean_latency_ms) == (4, 4.0)
    assert r.std_latency_ms == pytest.approx(3.535534, abs=1e-6)
    assert r.p95_latency_ms == pytest.approx(8.95)
    e = calls.limit(1).select(PR.energy(F.lit(4.0), 15.0).alias("e")).collect()[0].e
    assert e == pytest.approx(60.0)


def test_exact_quantile_random(spark):
    import random
    rnd = random.Random(9)
    vals = [("a", float(rnd.randrange(50))) for _ in range(999)] + [("b", rnd.random()) for _ in range(500)] \
        + [("c", 7.0)] * 10
    df = spark.createDataFrame(vals, "g string, v double")
    got = {r.g: r.quantile for r in PR.exact_quantile(df, "g", "v", 0.95).collect()}
    for g in "abc":
        xs = sorted(v for k, v in vals if k == g)
        pos = 0.95 * (len(xs) - 1)
        lo = int(pos)
        hi = min(lo + 1, len(xs) - 1)
        assert got[g] == pytest.approx(xs[lo] + (xs[hi] - xs[lo]) * (pos - lo))


def test_corpus_scan_fixture(spark, tmp_path):
    d = tmp_path / "corpus"
    d.mkdir()
    (d / "train_PlayMusic_full.json").write_bytes(
        b'{"PlayMusic":[{"data":[{"text":"play "},{"text":"caf\xe9 jazz","entity":"genre"},{"text":" now "}]}]}')
    (d / "train_GetWeather_full.json").write_bytes(b'{"GetWeather":[{"data":[]},{}]}')
    (d / "validate_PlayMusic.json").write_bytes(b'{"PlayMusic":[{"data":[{"text":"\\t\\n hi \\n"}]}]}')
    rows = sorted((r.split, r.intent, r.text) for r in CO.corpus_scan(spark, str(d)).collect())
    assert rows == [("train", "GetWeather", ""), ("train", "GetWeather", ""), ("train", "PlayMusic", "play café jazz now"),
                    ("validate", "PlayMusic", "hi")]
    with pytest.raises(FileNotFoundError):
        CO.corpus_scan(spark, str(tmp_path / "none"))


def test_results_round_trip_and_names(spark, tmp_path):
    rows = [(c, 0, 1, 0, 0, True, 0.9, 1.0, 3) for c in
            ["pipeline_theta1_0.70_theta2_0.60", "ablation_two_tier", "xpipeline_theta1_0.70_theta2_0.60",
             "pipeline_theta1_1_theta2_0.60"]]
    df = spark.createDataFrame(rows, "config string, sample_idx long, tier_used int, prediction int, gold_label int, "
                                     "correct boolean, confidence double, latency_ms double, bytes_sent int")
    out = str(tmp_path / "res")
    RS.save_results(df, out)
    got = {r.config: (r.theta1, r.theta2) for r in RS.load_results(spark, out).collect()}
    assert got == {"pipeline_theta1_0.70_theta2_0.60": (0.7, 0.6), "ablation_two_tier": (None, None),
                   "xpipeline_theta1_0.70_theta2_0.60": (0.7, 0.6), "pipeline_theta1_1_theta2_0.60": (None, None)}
    with pytest.raises(ValueError):
        RS.save_results(df.limit(0), str(tmp_path / "empty"))


def test_flat_csv_results(spark, tmp_path):
    d = tmp_path / "flat"
    d.mkdir()
    hdr = "sample_idx,tier_used,prediction,gold_label,correct,confidence,latency_ms,bytes_sent\n"
    (d / "pipeline_theta1_0.50_theta2_0.90.csv").write_text(hdr + "0,1,2,2,True,0.9,0.5,10\n1,3,1,2,False,1.0,131.0,12\n")
    got = RS.load_results(spark, str(d), "pipeline_*").collect()
    assert [(r.config, r.theta1, r.correct) for r in got] == [
        ("pipeline_theta1_0.50_theta2_0.90", 0.5, True), ("pipeline_theta1_0.50_theta2_0.90", 0.5, False)]


def test_profile_header_drift(spark, tmp_path):
    p = tmp_path / "old.csv"
    hdr = PROFILE_COLUMNS.copy()
    hdr[7], hdr[8], hdr[12] = "peak_ram_mb", "peak_vram_mb", "peak_vram_mb"
    vals = ["1", "m", "onnx", "700"] + [str(float(i)) for i in range(13)] + ["note"]
    p.write_text(",".join(hdr) + "\n" + ",".join(vals) + "\n")
    r = RS.profile_union(spark, [str(p)]).collect()[0]
    assert r.model_footprint_mb == 3.0 and r.inference_peak_ram_mb == 4.0 and r.peak_vram_mb == 8.0
    assert r.notes == "note"
