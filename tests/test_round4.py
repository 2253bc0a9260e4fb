"""Streams over tables of many parts."""

import os

from escalade.operators import routing as R
from escalade.plans import cascade as C
from escalade.plans.catalog import PLANS
from escalade.sources import results as RS
from escalade.streaming.decision_log import stream_decision_log


def parts(spark, path, n=60, files=4):
    """Documents as a folder of parts."""
    words = ["red", "green", "blue", "stone", "river", "cloud"]
    rows = [(i, " ".join(words[(i * k + k) % 6] for k in range(1, 3 + i % 5)) if i % 7 else None, ["de", "en", "fr"][i % 3]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.repartition(files).write.parquet(os.path.join(path, "documents.parquet"))
    return docs


def log(df):
    return sorted((r.sample_id, r.tier_used, r.correct, r.latency_ms, r.bytes_sent or 0) for r in df.collect())


def test_streams_of_a_folder_of_parts(spark, tmp_path):
    parts(spark, str(tmp_path))
    batch = log(PLANS["decision_log"](spark, str(tmp_path)))
    assert len(batch) == 60
    assert log(PLANS["stream_decision_log"](spark, str(tmp_path))) == batch
    assert log(PLANS["stream_decision_log_replayed"](spark, str(tmp_path))) == batch


def test_batches_bounded_by_bytes(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(60).selectExpr("id AS sample_idx", "1 AS tier_used", "true AS correct", "0.5D AS latency_ms", "1 AS bytes_sent") \
        .repartition(6).write.parquet(src)

    def batches(limit):
        out = str(tmp_path / f"log-{limit}")
        stream_decision_log(spark, src, spark.read.parquet(src).schema, "*.parquet", lambda b: b, out, f"{out}-checkpoint",
                            bytes_per_trigger=limit).awaitTermination()
        assert RS.read_decision_log(spark, out).count() == 60
        return len([d for d in os.listdir(out) if d.startswith("batch_id=")])

    assert batches(1 << 30) == 1 and batches(1) == 6


def test_written_cascade_scores_as_the_fitted_one(spark, tmp_path):
    parts(spark, str(tmp_path))
    dc = C.build(spark, str(tmp_path))
    written = C.written_cascade(dc)
    got, want = (R.route(c, dc.samples, 0.7, 0.7, fused=True) for c in (written, dc.cascade))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and written.costs == dc.cascade.costs
    # only counts of the long tail are read, and nothing is ranked or summed up for the headers
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "GlobalLimit" not in plan
