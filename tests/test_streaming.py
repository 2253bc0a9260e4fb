import os
import uuid

from pyspark.sql import functions as F

from escalade.operators import routing as R
from escalade.plans import cascade as C
from escalade.sources import results as RS
from escalade.streaming.decision_log import stream_decision_log

SF = "/root/testdata/sf0.001"


def test_decision_log_replay_is_idempotent(spark, tmp_path):
    dc = C.build(spark, SF)
    d = R.route(dc.cascade, dc.samples, 0.7, 0.7)
    out = str(tmp_path / "log")
    RS.decision_log(d, out, batch_id=0)
    RS.decision_log(d, out, batch_id=0)   # replay of the same batch
    RS.decision_log(d, out, batch_id=1)
    back = RS.read_decision_log(spark, out)
    assert back.count() == 2 * d.count()


def test_stream_equals_batch(spark, tmp_path):
    dc = C.build(spark, SF)
    batch = R.route(dc.cascade, dc.samples, 0.7, 0.7)
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))

    def to_decisions(b):
        toks = C.document_tokens(b)
        s = toks.select("sample_id", "fold", "bytes_sent", "terms",
                        C.encode_with_list(F.col("lang"), dc.labels).alias("gold_label"))
        return R.route(dc.cascade, s, 0.7, 0.7)

    out, ck = str(tmp_path / f"o{uuid.uuid4().hex}"), str(tmp_path / "ck")
    q = stream_decision_log(spark, SF, docs.schema, "documents.parquet", to_decisions, out, ck)
    q.awaitTermination()
    got = {(r.sample_id, r.tier_used, r.correct) for r in RS.read_decision_log(spark, out).collect()}
    exp = {(str(r.sample_idx), r.tier_used, r.correct) for r in batch.collect()}
    assert got == exp


def test_fused_route_equals_staged(spark):
    dc = C.build(spark, SF)
    staged = {tuple(r) for r in R.route(dc.cascade, dc.samples, 0.6, 0.8).collect()}
    fused = {tuple(r) for r in R.route(dc.cascade, dc.samples, 0.6, 0.8, fused=True).collect()}
    assert staged == fused and len(staged) == dc.samples.count()


def test_replayed_and_late_rows(spark, tmp_path):
    """Three files, the second one again, and rows later than the watermark."""
    import datetime as dt
    import time

    import pytest

    from escalade.streaming.decision_log import Replays

    t0 = dt.datetime(2024, 1, 1)
    schema = "sample_idx long, at timestamp, tier_used int, correct boolean, latency_ms double, bytes_sent int"
    src = str(tmp_path / "src")

    def deliver(ids, shift=0):
        rows = [(i, t0 + dt.timedelta(minutes=i + shift), 1, True, 0.5, i) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)

    deliver(range(0, 10))
    deliver(range(10, 20))
    deliver(range(10, 20))          # the file again
    deliver([*range(15, 25), 22])   # half of it and a row twice in one file
    deliver([40])                   # moves the watermark to 10
    deliver([41])
    deliver([2, 39])                # 2 is too late: dropped, as it can't be told from a new row
    out = str(tmp_path / "log")
    q = stream_decision_log(spark, src, spark.read.parquet(src).schema, "*.parquet", lambda b: b, out, str(tmp_path / "ck"),
                            replays=Replays("sample_idx", "at", "30 minutes"))
    q.awaitTermination()
    got = sorted(int(r.sample_id) for r in RS.read_decision_log(spark, out).collect())
    assert got == [*range(25), 39, 40, 41]
    with pytest.raises(TypeError, match="timestamp"):
        Replays("sample_idx", "tier_used", "1 day").once(spark.read.parquet(src))
