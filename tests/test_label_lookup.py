import random
import string

import pytest
from pyspark.sql import functions as F

from escalade.operators.label_lookup import parse_label_many
from escalade.operators.prompts import parse_label


def answers(spark, texts, labels, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, raw string")
    d = spark.createDataFrame([(x,) for x in labels], "l string")
    return [r.label for r in parse_label_many(df, "raw", d, "l", **kw).orderBy("i").collect()]


def test_cases(spark):
    labels = ["GetWeather", "PlayMusic", "Music", "Über", None, "Music"]
    texts = [None, "", "  getweather\n", "it is GETWEATHER.", "PlayMusic", "say playmusic now", "music!", "getweather or music", "ÜBER alles", "none"]
    assert answers(spark, texts, labels) == [
        "unknown", "unknown", "GetWeather", "GetWeather", "PlayMusic", "unknown", "Music", "unknown", "Über", "unknown"]
    assert answers(spark, texts[:4], []) == ["unknown"] * 4
    # labels that differ in case only; an empty label is in every text
    assert answers(spark, ["music", "a music b", "x"], ["Music", "music"]) == ["Music", "unknown", "unknown"]
    assert answers(spark, ["", "x", "a b", None], ["", "b"]) == ["", "", "unknown", "unknown"]


@pytest.mark.parametrize("part_bytes", [2_000_000, 60])
def test_same_as_one_label_at_a_time(spark, part_bytes):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abAB") for _ in range(n))
    labels = sorted({word(rnd.randrange(2, 6)) for _ in range(30)})
    texts = [*labels[:5], *(word(rnd.randrange(0, 12)) for _ in range(200)), "ab" * 50_000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, raw string")
    want = [r.label for r in df.select("i", parse_label(F.col("raw"), labels).alias("label")).orderBy("i").collect()]
    assert answers(spark, texts, labels, part_bytes=part_bytes) == want
    assert len(set(want)) > 3


def test_ten_thousand_labels_walk_the_text_once():
    from escalade.operators import label_lookup as L
    rnd = random.Random(5)
    labels = {"".join(rnd.choices(string.ascii_lowercase, k=8)) for _ in range(10_000)}

    class Counted(dict):
        asked = 0

        def __getitem__(self, k):
            Counted.asked += 1
            return super().__getitem__(k)

    known, search = L._automaton("t", [(x, x, 1) for x in labels])
    known = Counted(known)
    one = min(labels)
    assert L.find("zz " * 20_000 + one + " zz" * 20_000, known, search) == (None, one, 1)
    assert Counted.asked <= 4  # by what it finds, not by the number of labels
