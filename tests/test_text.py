from pyspark.sql import functions as F

from escalade.functions.text import analyzer_tokens, py_strip, utf8_bytes, whitespace_count
from escalade.operators.prompts import parse_label

ROWS = [("Play the Café", ["play", "the", "cafe"], 3),
        ("abc1 x ab_c ok", ["ok"], 4),
        ("Straße groß öl", ["ol"], 3),
        ("don't stop", ["don", "stop"], 2),
        ("", [], 0)]


def test_tokens_and_counts(spark):
    df = spark.createDataFrame([(r[0],) for r in ROWS], "text string")
    got = df.select(analyzer_tokens(F.col("text")).alias("t"), whitespace_count(F.col("text")).alias("n")).collect()
    assert [r.t for r in got] == [r[1] for r in ROWS]
    assert [r.n for r in got] == [r[2] for r in ROWS]


def test_strip_and_bytes(spark):
    df = spark.createDataFrame([("\t\n hi there \n",), ("é",)], "text string")
    got = df.select(py_strip(F.col("text")).alias("s"), utf8_bytes(F.col("text")).alias("b")).collect()
    assert got[0].s == "hi there" and got[1].b == 2


def test_parse_label(spark):
    labels = ["GetWeather", "PlayMusic"]
    rows = [("  getweather\n", "GetWeather"), ("The intent is PlayMusic.", "PlayMusic"),
            ("PlayMusic or GetWeather", "unknown"), ("", "unknown"), (None, "unknown"), ("weather", "unknown")]
    df = spark.createDataFrame([(r[0],) for r in rows], "raw string")
    got = [r.l for r in df.select(parse_label(F.col("raw"), labels).alias("l")).collect()]
    assert got == [r[1] for r in rows]


def test_probability_checks(spark):
    import pytest
    from escalade.functions.proba import confidence, proba_dense, softmax, argmax
    ok = spark.createDataFrame([([0.2, 0.8],)], "p array<double>")
    assert ok.select(confidence(F.col("p")).alias("c")).collect()[0].c == 0.8
    for bad in ([], None, [float("nan"), 0.5], [1.0000001, 0.0]):
        df = spark.createDataFrame([(bad,)], "p array<double>")
        with pytest.raises(Exception):
            df.select(confidence(F.col("p"))).collect()
    m = spark.createDataFrame([({0: 0.3, 2: 0.7},)], "m map<int,double>")
    with pytest.raises(Exception):
        m.select(proba_dense(F.col("m"), 3)).collect()
    full = spark.createDataFrame([({0: 0.3, 1: 0.0, 2: 0.7},)], "m map<int,double>")
    assert full.select(proba_dense(F.col("m"), 3).alias("v")).collect()[0].v == [0.3, 0.0, 0.7]
    z = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    r = z.select(softmax(F.col("z")).alias("p"), argmax(F.col("z")).alias("a")).collect()[0]
    assert abs(sum(r.p) - 1) < 1e-12 and r.a == 1   # first index on ties
