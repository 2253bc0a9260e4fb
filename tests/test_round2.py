"""Inputs on which earlier versions lost rows, failed or depended on a size."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from escalade.functions.text import analyzer_tokens
from escalade.operators import analysis as A
from escalade.operators import features as FT
from escalade.operators import metrics as M
from escalade.operators import profile as PR
from escalade.operators import routing as R
from escalade.operators import sampling as S
from escalade.operators import scoring as SC
from escalade.plans import cascade as C
from escalade.schemas import require_columns
from escalade.sources import corpus as CO
from escalade.sources import results as RS

DECISION = ("config string, sample_idx long, tier_used int, prediction int, gold_label int, "
            "correct boolean, confidence double, latency_ms double, bytes_sent int")


def decisions(spark, rows):
    return spark.createDataFrame([(c, i, 1, p, g, p == g, 0.9, 1.0, 3) for c, i, p, g in rows], DECISION)


def test_a_vocabulary_beyond_the_hot_terms_is_scored_in_stages(spark, monkeypatch):
    rows = [(i, "en" if i % 2 else "de", ("the cat of the dog " if i % 2 else "der hund und die katze ") * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = {r.sample_id: (r.pred1, r.pred2, r.pred3) for r in
            C.fit_text_cascade(df, vocab1=3, vocab2=4).wide().collect()}
    monkeypatch.setattr(SC, "HOT_TERMS", 2)
    dc = C.fit_text_cascade(df, vocab1=3, vocab2=4)
    assert dc.cascade.fused is None
    rows = dc.wide().collect()
    assert len(rows) == 60
    assert all(r.pred1 == want[r.sample_id][0] and r.pred3 == want[r.sample_id][2] for r in rows)
    assert dc.decisions().count() == 60 * 28


def test_rows_without_a_label_are_an_error(spark):
    df = spark.createDataFrame([(i, None if i < 2 else "ab"[i % 2]) for i in range(12)], "id long, y string")
    with pytest.raises(ValueError, match="2 rows have no y"):
        S.stratified_split(df, "y", "id", 0.5)


def test_the_split_moves_no_rows(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "text " * 50) for i in range(200)], "id long, y string, text string")
    plan = S.stratified_split(df, "y", "id", 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_texts_without_tokens_get_a_window_of_padding(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha", "x"), (2, "?!", "y"), (3, None, "z"), (4, "", "x")], "id long, text string, y string")
    voc = FT.vocabulary(FT.tokenize(df, "id"), 10)
    rows = {(r.id, r.window): r for r in FT.fixed_length_ids(df, "id", voc, 2, label_col="y").collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)}
    assert rows[2, 0].input_ids == [0, 0] and rows[2, 0].attention_mask == [0, 0] and rows[2, 0].labels == "y"
    assert rows[1, 1].input_ids == [2, 0] and rows[1, 1].attention_mask == [1, 0]


def corpus(folder, **files):
    folder.mkdir()
    for name, content in files.items():
        (folder / f"{name}.json").write_text(content, encoding="latin-1")
    return str(folder)


def test_corpus_files_are_read_by_name_and_key(spark, tmp_path):
    one = json.dumps({"PlayMusic": [{"data": [{"text": "play"}]}], "Other": [{"data": [{"text": "no"}]}]})
    path = corpus(tmp_path / "c", train_PlayMusic_full=one, train_PlayMusic=one, train_Other_full=one)
    with pytest.warns(UserWarning, match="validate_PlayMusic.json"):
        rows = CO.corpus_scan(spark, path).collect()
    assert [(r.split, r.intent, r.text) for r in rows] == [("train", "PlayMusic", "play")]


@pytest.mark.parametrize("content", ['{"PlayMusic": [', '{"GetWeather": []}', "[]"])
def test_a_bad_corpus_file_fails(spark, tmp_path, content):
    path = corpus(tmp_path / "c", train_PlayMusic_full=content)
    with pytest.warns(UserWarning), pytest.raises(Exception):
        CO.corpus_scan(spark, path).collect()


def test_mcnemar_needs_pairs(spark):
    both = [(c, i, i % 2, 0) for c in "ab" for i in range(4)]
    assert A.mcnemar(decisions(spark, both), "a", "b").collect()[0].n_both_correct == 2
    for rows in (both + [("a", 9, 0, 0)], both + [("b", 9, 0, 0)], both + [("a", 9, None, 0), ("b", 9, 0, 0)], [("c", 1, 0, 0)],
                 both + [("a", 1, 0, 0)]):
        with pytest.raises(Exception):
            A.mcnemar(decisions(spark, rows), "a", "b").collect()


def test_a_tier_that_skips_a_row_fails(spark):
    samples = spark.createDataFrame([(i, 0, 5, "t") for i in range(3)], "sample_id long, gold_label int, bytes_sent int, text string")
    score = lambda conf: lambda s: s.select("sample_id", F.lit(0).alias("label"), F.lit(conf).alias("confidence"))
    some = lambda s: score(1.0)(s.where("sample_id < 2"))
    c = R.Cascade(score(0.1), score(0.1), some)
    with pytest.raises(Exception, match="no score for sample 2"):
        R.route(c, samples, 0.5, 0.5).collect()


def test_an_empty_save_over_an_old_folder_is_an_error(spark, tmp_path):
    d = decisions(spark, [("a", 1, 0, 0)])
    RS.save_results(d, str(tmp_path / "r"))
    with pytest.raises(ValueError):
        RS.save_results(d.limit(0), str(tmp_path / "r"))


def test_quantile_with_infinite_and_far_values(spark):
    inf = float("inf")
    rows = [("a", v) for v in (1.0, 2.0, inf)] + [("b", v) for v in (inf, inf, 1.0)] + [("c", float(i)) for i in range(100_000)] + [("c", 1e300)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.quantile for r in PR.exact_quantile(df, "g", "v", 0.5).collect()}
    assert got == {"a": 2.0, "b": inf, "c": 50_000.0}


def test_the_bracket_holds_a_fixed_share(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 1.0).alias("v")).unionByName(
        spark.createDataFrame([("g", 1e300)], "g string, v double"))
    st = df.groupBy("g").agg(F.percentile_approx("v", PR._bracket(0.95), PR.SKETCH).alias("b"))
    inside = df.join(F.broadcast(st), "g").where((F.col("v") >= F.col("b")[0]) & (F.col("v") <= F.col("b")[1])).count()
    assert inside <= 200_000 * 10 / PR.SKETCH + 2


def test_profile_has_no_sort_aggregate_and_takes_quality(spark):
    t0 = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(g, i, t0 + dt.timedelta(seconds=i), float(i + 1)) for g in "ab" for i in range(9)],
                                  "grp string, id long, ts timestamp, ms double")
    quality = spark.createDataFrame([("a", 0.5, 0.25)], "grp string, accuracy double, f1_macro double")
    p = PR.profile(calls, "grp", ["ts", "id"], "ms", quality=quality)
    rows = {r.grp: r for r in p.collect()}
    assert (rows["a"].accuracy, rows["a"].f1_macro, rows["b"].accuracy) == (0.5, 0.25, None)
    assert (rows["a"].load_time_ms, rows["a"].footprint, rows["a"].peak) == (1.0, 8.0, 8.0)
    assert "SortAggregate" not in p._jdf.queryExecution().executedPlan().toString()


def test_compatibility_characters_fold(spark):
    df = spark.createDataFrame([("ﬁne ªb ſet Ａｂｃ ㎏s café ŉo",)], "t string")
    assert df.select(analyzer_tokens(F.col("t")).alias("t")).collect()[0].t == ["fine", "ab", "set", "abc", "kgs", "cafe"]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    require_columns(df, ["a", "b"])
    with pytest.raises(KeyError, match="c"):
        require_columns(df, ["a", "c"])
    for f in (A.escalation_rates, A.summarise, A.errors_by_tier, A.bytes_per_correct, M.macro_f1, lambda d: A.mcnemar(d, "a", "b"),
              lambda d: A.errors_by_class(d, df)):
        with pytest.raises(KeyError):
            f(df)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from escalade import session

    class Context:
        master, applicationId = "yarn", "app-1"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_pareto_front_of_an_anti_correlated_input(spark):
    pts = spark.createDataFrame([(f"c{i}", float(i), float(i) if i % 3 else float(i) - 2.5) for i in range(500)], "config string, lat double, acc double")
    got = [r.config for r in A.pareto_front(pts, "lat", "acc", buckets=7).collect()]
    rows = [(f"c{i}", float(i), float(i) if i % 3 else float(i) - 2.5) for i in range(500)]
    want = [c for c, x, y in rows if not any(x2 <= x and y2 >= y and (x2 < x or y2 > y) for _, x2, y2 in rows)]
    assert got == want


def test_scratch_tables_can_be_dropped(tmp_path):
    import os
    import subprocess
    import sys

    code = f"""
from escalade.session import drop_scratch, local_session, materialize, scratch_path
import os
s = local_session(1, extra={{"spark.checkpoint.dir": {str(tmp_path)!r}}})
assert materialize(s.range(5), "x").count() == 5
top = os.path.dirname(scratch_path(s, "x"))
assert top.startswith({str(tmp_path)!r}) and os.listdir(top)
drop_scratch(s)
assert not os.path.exists(top)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
