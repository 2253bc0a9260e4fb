"""Profile plans on ``events``: each event type is a run group, ``value`` the
recorded latency in ms, (ts, event_id) the call order, and ``k`` in ``props`` the
memory in MB that a probe of the group's host saw at that time."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.operators import metrics as M
from escalade.operators import profile as PR
from escalade.operators.cube import tier_answers
from escalade.operators.telemetry import run_telemetry
from escalade.plans import cascade as C
from escalade.plans.decision_plans import TIER_QUALITY_CTES
from escalade.plans.oracle import with_cascade_extra
from escalade.plans.registry import plan, rounded
from escalade.session import materialize
from escalade.schemas import PROFILE_COLUMNS, PROFILE_SCHEMA
from escalade.sources.tables import read_table

# Power draw assumed for energy (W), and the model tag of a recorded run.
WATTS = 15.0
ORDER = ["ts", "event_id"]
# The tier that a run group's model is in (other groups have none).
TIERS = {"click": 1, "view": 2, "purchase": 3}

REST_SQL = """rest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS call_no FROM events) WHERE call_no > 1)"""
STATS_SQL = f"""{REST_SQL},
stats AS (SELECT event_type AS run_group, count(value) AS n_samples, avg(value) AS mean_latency_ms,
  stddev_pop(value) AS std_latency_ms, quantile_cont(value, 0.95) AS p95_latency_ms FROM rest GROUP BY event_type)"""


def _calls(spark, sf_dir):
    return read_table(spark, sf_dir, "events").withColumnRenamed("event_type", "run_group")


@plan("latency_stats", f"""WITH {STATS_SQL}
SELECT run_group, n_samples, round(mean_latency_ms, 6) AS mean_latency_ms, round(std_latency_ms, 6) AS std_latency_ms,
       round(p95_latency_ms, 6) AS p95_latency_ms FROM stats""")
def q_latency_stats(spark, sf_dir):
    return rounded(PR.latency_stats(_calls(spark, sf_dir), "run_group", ORDER, "event_id", "value"))


@plan("energy", f"""WITH {STATS_SQL}
SELECT run_group, round(mean_latency_ms / 1000.0 * {WATTS} * 1000.0, 6) AS energy_mj FROM stats""")
def q_energy(spark, sf_dir):
    s = PR.call_stats(_calls(spark, sf_dir), "run_group", ORDER, "value")
    return rounded(s.select("run_group", PR.energy(F.col("mean_latency_ms"), WATTS).alias("energy_mj")))


DELTA_SQL = """delta AS (SELECT event_type AS run_group,
  greatest(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 0.0) AS footprint,
  greatest(max(value) - arg_min(value, (ts, event_id)), 0.0) AS peak,
  arg_min(value, (ts, event_id)) AS load_time_ms
  FROM events GROUP BY event_type)"""


@plan("resource_delta", f"WITH {DELTA_SQL} SELECT run_group, round(footprint, 6) AS footprint, round(peak, 6) AS peak FROM delta")
def q_resource_delta(spark, sf_dir):
    return rounded(PR.resource_delta(_calls(spark, sf_dir), "run_group", ORDER, "value"))


# runs of ``run_telemetry``: a purchase starts a run on its user's host, which lasts ``value`` hours
HOUR_US = 3_600_000_000


@plan("run_telemetry", f"""WITH runs AS (SELECT event_id AS run_id, user_id, ts AS lo,
  ts + to_microseconds(round(value * 100)::BIGINT * {HOUR_US // 100}) AS hi FROM events WHERE event_type = 'purchase'),
j AS (SELECT r.run_id, e.value, row_number() OVER (PARTITION BY r.run_id ORDER BY e.ts, e.event_id) AS a,
  row_number() OVER (PARTITION BY r.run_id ORDER BY e.ts DESC, e.event_id DESC) AS z
  FROM runs r JOIN events e ON e.user_id = r.user_id AND e.ts BETWEEN r.lo AND r.hi AND e.event_type <> 'purchase'),
g AS (SELECT run_id, count(*) AS n, avg(value) AS mean, max(value) FILTER (WHERE a = 1) AS f,
  max(value) FILTER (WHERE z = 1) AS l, max(value) AS m FROM j GROUP BY run_id)
SELECT run_id, coalesce(n, 0) AS n_samples, round(mean, 6) AS mean, round(f, 6) AS first, round(l, 6) AS last, round(m, 6) AS greatest,
  round(greatest(l - f, CASE WHEN f IS NULL THEN NULL ELSE 0.0 END), 6) AS footprint,
  round(greatest(m - f, CASE WHEN f IS NULL THEN NULL ELSE 0.0 END), 6) AS peak
FROM runs LEFT JOIN g USING (run_id)""")
def q_run_telemetry(spark, sf_dir):
    """Samples of a user's host inside the windows of its runs, which overlap."""
    events = read_table(spark, sf_dir, "events")
    runs = events.where(F.col("event_type") == "purchase").withColumn("length", F.round(F.col("value") * 100).cast("long") * (HOUR_US // 100))
    runs = runs.select(F.col("event_id").alias("run_id"), "user_id", F.col("ts").alias("lo"),
                       (F.col("ts") + F.make_dt_interval(secs=(F.col("length") / 1_000_000).cast("decimal(18,6)"))).alias("hi"))
    samples = events.where(F.col("event_type") != "purchase")
    return rounded(run_telemetry(samples, runs, "user_id", "ts", "event_id", "value", "run_id", "lo", "hi"))


def _memory(spark, sf_dir):
    """(run_group, footprint, peak): the host's memory between the first and the last call of a group."""
    calls = _calls(spark, sf_dir)
    probes = calls.withColumn("mb", F.get_json_object("props", "$.k").cast("double"))
    runs = calls.groupBy("run_group").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).withColumn("host", F.col("run_group"))
    return run_telemetry(probes.withColumnRenamed("run_group", "host"), runs, "host", "ts", "event_id", "mb", "run_group", "lo", "hi")


def _quality(spark, sf_dir):
    """(run_group, tier, accuracy, f1_macro) of the groups that are a tier."""
    q = M.macro_f1(tier_answers(C.build(spark, sf_dir).cube()), group=("tier",))
    tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    groups = spark.range(1).select(F.explode(tier).alias("run_group", "tier"))
    return groups.join(q.select("tier", "accuracy", "f1_macro"), "tier", "left")


def profile_rows(spark, sf_dir):
    """Rows of the fixed 18-column profile schema, one per run group."""
    quality = materialize(_quality(spark, sf_dir), "run-quality")
    j = PR.profile(_calls(spark, sf_dir), "run_group", ORDER, "value", quality=quality).drop("footprint", "peak")
    j = j.join(_memory(spark, sf_dir).select("run_group", "footprint", "peak"), "run_group", "left") \
        .join(quality.select("run_group", "tier"), "run_group", "left")
    r4 = lambda c: F.round(F.col(c), 4)
    vals = {
        "tier": F.col("tier"), "model_name": F.col("run_group"), "inference_mode": F.lit("recorded"),
        "n_samples": F.col("n_samples").cast("int"), "mean_latency_ms": r4("mean_latency_ms"),
        "std_latency_ms": r4("std_latency_ms"), "p95_latency_ms": r4("p95_latency_ms"),
        "model_footprint_mb": r4("footprint"), "inference_peak_ram_mb": r4("peak"),
        "accuracy": r4("accuracy"), "f1_macro": r4("f1_macro"),
        "energy_mj": F.round(PR.energy(F.col("mean_latency_ms"), WATTS), 6), "load_time_ms": r4("load_time_ms"),
    }
    return j.select(*[(vals[f.name] if f.name in vals else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in PROFILE_SCHEMA.fields])


TIERS_SQL = ", ".join(f"('{g}', {t})" for g, t in TIERS.items())
PROFILE_SQL = with_cascade_extra(f"""{TIER_QUALITY_CTES},
tiers(run_group, tier) AS (VALUES {TIERS_SQL}),
quality AS (SELECT run_group, tier, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(f1) AS f1_macro
  FROM tiers JOIN prf USING (tier) GROUP BY ALL), {STATS_SQL},
probes AS (SELECT event_type AS run_group, ts, event_id, value, regexp_extract(props, '"k": *(-?[0-9.]+)', 1)::DOUBLE AS mb FROM events),
delta AS (SELECT run_group, arg_min(value, (ts, event_id)) AS load_time_ms,
  greatest(arg_max(mb, (ts, event_id)) - arg_min(mb, (ts, event_id)), 0.0) AS footprint,
  greatest(max(mb) - arg_min(mb, (ts, event_id)), 0.0) AS peak FROM probes GROUP BY run_group)""", f"""
SELECT tier::INT AS tier, s.run_group AS model_name, 'recorded' AS inference_mode, s.n_samples::INT AS n_samples,
  round(mean_latency_ms, 4) AS mean_latency_ms, round(std_latency_ms, 4) AS std_latency_ms,
  round(p95_latency_ms, 4) AS p95_latency_ms, round(footprint, 4) AS model_footprint_mb,
  round(peak, 4) AS inference_peak_ram_mb, NULL::DOUBLE AS rss_after_load_mb, NULL::DOUBLE AS vm_rss_mb,
  NULL::DOUBLE AS vm_peak_mb, NULL::DOUBLE AS peak_vram_mb,
  round(mean_latency_ms / 1000.0 * {WATTS} * 1000.0, 6) AS energy_mj, round(load_time_ms, 4) AS load_time_ms,
  round(accuracy, 4) AS accuracy, round(f1_macro, 4) AS f1_macro, NULL::VARCHAR AS notes
FROM stats s JOIN delta d USING (run_group) LEFT JOIN quality USING (run_group)""")


@plan("profile_report", PROFILE_SQL)
def q_profile_report(spark, sf_dir):
    return profile_rows(spark, sf_dir)
