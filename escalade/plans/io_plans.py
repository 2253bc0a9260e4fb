"""Plans that round-trip data through the sinks and sources (results,
decision log, profiles, corpus files, streaming). Scratch output goes under
the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from escalade.operators import routing as R
from escalade.plans import cascade as C
from escalade.plans.decision_plans import decisions
from escalade.plans.oracle import with_decisions
from escalade.plans.profile_plans import PROFILE_SQL, profile_rows
from escalade.plans.registry import plan, rounded
from escalade.schemas import PROFILE_COLUMNS
from escalade.session import scratch_path
from escalade.sources import corpus as CO
from escalade.sources import results as RS
from escalade.sources.tables import balanced, read_table, stream_source, total_bytes

CFG = R.config_name(0.7, 0.7)


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@plan("save_results", with_decisions("""
SELECT config, count(*) AS n_rows, count(*) FILTER (WHERE correct) AS n_correct FROM decisions GROUP BY config"""))
def q_save_results(spark, sf_dir):
    out = _scratch(spark, "results")
    RS.save_results(decisions(spark, sf_dir), out)
    back = RS.load_results(spark, out)
    return back.groupBy("config").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("correct").alias("n_correct"))


@plan("load_results", with_decisions("""
SELECT config, theta1, theta2, sample_idx, tier_used, prediction, gold_label, correct,
       round(confidence, 6) AS confidence, round(latency_ms, 6) AS latency_ms, bytes_sent FROM decisions"""))
def q_load_results(spark, sf_dir):
    out = _scratch(spark, "results")
    RS.save_results(decisions(spark, sf_dir), out)
    return rounded(RS.load_results(spark, out))


LOG_SQL = with_decisions(f"""
SELECT sample_idx::VARCHAR AS sample_id, tier_used, correct, round(latency_ms, 6) AS latency_ms, bytes_sent
FROM decisions WHERE config = '{CFG}'""")


@plan("decision_log", LOG_SQL)
def q_decision_log(spark, sf_dir):
    dc = C.build(spark, sf_dir)
    out = _scratch(spark, "decision-log")
    RS.decision_log(R.route_wide(dc.wide(), 0.7, 0.7, dc.cascade.costs), out)
    back = RS.read_decision_log(spark, out)
    return rounded(back.select("sample_id", "tier_used", "correct", "latency_ms", "bytes_sent"))


@plan("profile_append", PROFILE_SQL)
def q_profile_append(spark, sf_dir):
    out = _scratch(spark, "profile")
    RS.profile_append(profile_rows(spark, sf_dir), out)
    return RS.profile_union(spark, [out]).select(*PROFILE_COLUMNS)


# An older header of the profile file (two names differ from the schema).
DRIFTED = {"model_footprint_mb": "peak_ram_mb", "inference_peak_ram_mb": "peak_vram_mb_old"}


@plan("profile_union", f"SELECT * FROM ({PROFILE_SQL}) UNION ALL SELECT * FROM ({PROFILE_SQL})")
def q_profile_union(spark, sf_dir):
    rows = profile_rows(spark, sf_dir)
    a, b = _scratch(spark, "profile-a"), _scratch(spark, "profile-b")
    RS.profile_append(rows, a)
    rows.select(*[F.col(c).alias(DRIFTED.get(c, c)) for c in PROFILE_COLUMNS]) \
        .write.mode("append").option("header", True).csv(b)
    return RS.profile_union(spark, [a, b]).select(*PROFILE_COLUMNS)


CONV_SPLIT_SQL = """
ckey AS (SELECT conv_id, turn, role, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS k FROM conversations),
cls AS (SELECT role, count(*) AS n FROM ckey GROUP BY role),
q0 AS (SELECT role, n, sum(n) OVER () AS big_n, ceil(sum(n) OVER () * 0.2) AS t FROM cls),
q1 AS (SELECT *, t * n / big_n AS ex, floor(t * n / big_n) AS fl FROM q0),
q2 AS (SELECT *, ex - fl AS rem, t - sum(fl) OVER () AS lft FROM q1),
quota AS (SELECT role, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, role) <= lft THEN 1 ELSE 0 END AS quota FROM q2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY md5('42:' || k) || ':' || k) AS r FROM ckey)"""


@plan("corpus_scan", f"""WITH {CONV_SPLIT_SQL}
SELECT CASE WHEN r.r <= q.quota THEN 'validate' ELSE 'train' END AS split, r.role AS intent,
       regexp_replace(r.text, '^\\s+|\\s+$', '', 'g') AS text
FROM ranked r JOIN quota q USING (role)""")
def q_corpus_scan(spark, sf_dir):
    """conversations -> JSON-lines corpus files of both splits (an exact
    stratified 80/20 split by role) -> corpus scan."""
    from escalade.operators.sampling import stratified_split
    out = _scratch(spark, "corpus")
    conv = read_table(spark, sf_dir, "conversations").withColumn("k", F.concat_ws(":", "conv_id", "turn"))
    sp = stratified_split(conv, "role", "k", 0.2, seed=42)
    named = sp.withColumn("split", F.when(F.col("split") == "test", F.lit("validate")).otherwise(F.col("split")))
    CO.write_corpus_lines(named, "role", "text", out)
    return CO.corpus_scan(spark, out, json_lines=True).select("split", "intent", "text")


@plan("corpus_scan_split", """
SELECT CASE WHEN l_quantity % 5 = 0 THEN 'validate' ELSE 'train' END AS split,
       CASE l_returnflag WHEN 'A' THEN 'AddToPlaylist' WHEN 'N' THEN 'BookRestaurant' ELSE 'GetWeather' END AS intent,
       regexp_replace(l_returnflag || ' "data": ' || l_linestatus || ' ' || l_orderkey || ':' || l_linenumber, '^\\s+|\\s+$', '', 'g') AS text
FROM lineitem""")
def q_corpus_scan_split(spark, sf_dir):
    """lineitem rows -> one corpus file (a folder of parts) a split and intent -> scan by byte ranges."""
    import warnings

    out = _scratch(spark, "corpus-split")
    rows = read_table(spark, sf_dir, "lineitem")
    intent = F.when(F.col("l_returnflag") == "A", "AddToPlaylist").when(F.col("l_returnflag") == "N", "BookRestaurant").otherwise("GetWeather")
    split = F.when(F.col("l_quantity") % 5 == 0, "validate").otherwise("train")
    text = F.concat("l_returnflag", F.lit(' "data": '), "l_linestatus", F.lit(" "), "l_orderkey", F.lit(":"), "l_linenumber")
    rows = rows.select(split.alias("split"), intent.alias("intent"), text.alias("text"))
    for s in CO.SPLIT_FILES:
        for i in ("AddToPlaylist", "BookRestaurant", "GetWeather"):
            CO.write_corpus_files(rows.where((F.col("split") == s) & (F.col("intent") == i)), s, i, "text", out)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the other intents have no file here
        return CO.corpus_scan_split(spark, out, encoding="UTF-8").select("split", "intent", "text")


# Bytes of files in a micro-batch.
BATCH_BYTES = 256 << 20


def _stream_log(spark, sf_dir, source_dir, schema, glob, replays=None, batch_bytes=BATCH_BYTES):
    """The decision log of a stream of documents, read back."""
    from escalade.streaming.decision_log import stream_decision_log

    dc = C.build(spark, sf_dir)
    labels, cascade = dc.labels, C.written_cascade(dc)

    def to_samples(batch):
        toks = C.document_tokens(balanced(batch, "doc_id"))
        return toks.select("sample_id", "fold", "bytes_sent", "terms",
                           C.encode_with_list(F.col("lang"), labels).alias("gold_label"))

    def to_decisions(samples):
        # native tiers: one fused pass per micro-batch
        return R.route(cascade, samples, 0.7, 0.7, fused=True)

    out, ck = _scratch(spark, "stream-log"), _scratch(spark, "stream-ckpt")
    q = stream_decision_log(spark, source_dir, schema, glob, to_decisions, out, ck, to_samples=to_samples, replays=replays, bytes_per_trigger=batch_bytes)
    q.awaitTermination()
    back = RS.read_decision_log(spark, out)
    return rounded(back.select("sample_id", "tier_used", "correct", "latency_ms", "bytes_sent"))


@plan("stream_decision_log", LOG_SQL)
def q_stream_decision_log(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    source, glob = stream_source(spark, sf_dir, "documents")
    return _stream_log(spark, sf_dir, source, docs.schema, glob)


# Deliveries of the replayed stream, each a share of the documents by a hash of the id;
# the third comes twice, and every other one holds a share of the one before again.
# the first document arrives at this time (ms since 1970), one each millisecond.
ARRIVAL_MS = 1_704_067_200_000
DELIVERIES = ((0,), (0, 1), (2, 3), (2, 3), (3, 4), (4, 5, 6, 7))


@plan("stream_decision_log_replayed", LOG_SQL)
def q_stream_decision_log_replayed(spark, sf_dir):
    """Documents delivered in six folders, many of them twice or more: the log holds each once."""
    from escalade.streaming.decision_log import Replays

    src = _scratch(spark, "stream-source")
    docs = read_table(spark, sf_dir, "documents").withColumn("arrived", F.timestamp_millis(F.col("doc_id") + ARRIVAL_MS))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for shares in DELIVERIES:  # all their files have later times than those before
        docs.where(share.isin(*shares)).write.mode("append").parquet(src)
    # about a micro-batch a delivery, so that repeats come in later batches than their rows; large deliveries come in several
    batch_bytes = max(1, min(BATCH_BYTES, total_bytes(spark, src) // len(DELIVERIES)))
    return _stream_log(spark, sf_dir, src, docs.schema, "*.parquet", Replays("doc_id", "arrived", "10 days"), batch_bytes)
