import json
import random
import warnings

import pytest

from escalade.sources import corpus as CO

pytestmark = pytest.mark.filterwarnings("ignore:no corpus file")


def put(folder, encoding="latin-1", **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / f"{name}.json").write_bytes(content.encode(encoding))
    return str(folder)


def made(rng, intent, n):
    token = lambda: {"text": rng.choice(["play ", "é ", "data", '"data": ', "{", "]}, {", "\\", "a\nb", ""]), "entity": "x"}
    utts = [rng.choice([{}, {"data": []}]) if rng.random() < .1 else {"data": [token() for _ in range(rng.randrange(1, 5))]} for _ in range(n)]
    return {intent: utts}


def rows(df):
    return sorted(tuple(r) for r in df.select("split", "file_name", "utt_index", "intent", "text").collect())


@pytest.mark.parametrize("indent,separators", [(None, (",", ":")), (None, None), (2, None)])
def test_same_rows_as_reading_whole_files(spark, tmp_path, indent, separators):
    rng = random.Random(indent)
    files = {f"{s}_{i}{e}": json.dumps(made(rng, i, n), indent=indent, separators=separators, ensure_ascii=False)
             for s, e in (("train", "_full"), ("validate", "")) for i, n in (("PlayMusic", 300), ("GetWeather", 40), ("RateBook", 0))}
    path = put(tmp_path / "c", **files)
    want = rows(CO.corpus_scan(spark, path))
    for size in ("128m", "997"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = CO.corpus_scan_split(spark, path)
            read = spark.read.option("lineSep", '"data":').text(f"{path}/train_PlayMusic_full.json").rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert rows(got) == want and len(want) == 680
        assert size != "997" or read > 10  # one file, many tasks


@pytest.mark.parametrize("content,message", [
    ('{"PlayMusic": [{"data": [{"text": "a"}]}, {', "incomplete"),
    ('{"PlayMusic": [{"data": [{"text": "a"}]}', "whole utterance"),
    ('{"PlayMusic": [{"data": [{"text": "a"]}]}', "."),
    ('{"Other": [{"data": [{"text": "a"}]}]}', "another intent"),
    ('{"PlayMusic": [{"data" : [{"text": "a"}]}]}', "colon"),
    ('[{"data": [{"text": "a"}]}]', "."),
    ('{"PlayMusic": [{"data": [{"entity": "a"}]}]}', "without text"),
])
def test_a_file_that_is_no_document_fails(spark, tmp_path, content, message):
    with pytest.raises(Exception, match=message):
        CO.corpus_scan_split(spark, put(tmp_path / "c", train_PlayMusic_full=content)).collect()


def test_files_are_found_by_name(spark, tmp_path):
    one = json.dumps({"PlayMusic": [{"data": [{"text": " a"}, {"text": "b "}]}]})
    path = put(tmp_path / "c", train_PlayMusic_full=one, train_Other_full=one, validate_PlayMusic=json.dumps({"PlayMusic": []}))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert rows(CO.corpus_scan_split(spark, path)) == [("train", "train_PlayMusic_full.json", 0, "PlayMusic", "ab")]
    assert sum("no corpus file" in str(w.message) for w in seen) == 12
    with pytest.raises(FileNotFoundError):
        CO.corpus_scan_split(spark, put(tmp_path / "d", other=one))


def test_round_trip_of_written_files(spark, tmp_path):
    texts = [f'text {i} "data": é {{' for i in range(500)] + ["", 'x"]}, {']
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    CO.write_corpus_files(df, "train", "PlayMusic", "t", str(tmp_path / "c"))
    got = CO.corpus_scan_split(spark, str(tmp_path / "c"), encoding="UTF-8").collect()
    assert sorted(r.text for r in got) == sorted(texts) and {(r.split, r.intent) for r in got} == {("train", "PlayMusic")}
