from collections import Counter

import corpus_pipeline as P
from escalade.llm import common as C
from escalade.llm import decontam, line_dedup, near_dup, toxicity

from .test_line_dedup import brute as brute_lines
from .test_near_dup import brute as brute_classes
from .test_packing import check, tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tokenizer):  # noqa: F811
    """Each stage on what its predecessor kept, and run() on all."""
    docs = C.table(spark, SF, "documents")
    columns, names = docs.columns, [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = [docs]
    for name, stage in P.STAGES:
        kept.append(C.spill(stage(spark, kept[-1], SF), f"test-{name}"))
    for frame in kept[1:-1]:
        assert frame.columns == columns
    texts = [{r.doc_id: r.text for r in f.collect()} for f in kept[:-1]]

    model = toxicity.fit(docs, C.table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    assert texts[1] == {i: t for i, t in texts[0].items() if i not in toxic}

    ids = sorted(texts[1])
    want = {}
    for i, gone in zip(ids, brute_lines([texts[1][i] for i in ids])):
        lines, n, left = texts[1][i].split("\n"), -1, []
        for x in lines:
            n += bool(x.strip(" \t\r"))
            if not x.strip(" \t\r") or n not in gone:
                left.append(x)
        if not gone or any(x.strip(" \t\r") for x in left):
            want[i] = "\n".join(left)
    assert texts[2] == want

    own = sorted(texts[2].items())
    first = {i for (i, _), c in zip(own, brute_classes(own)) if i == c}
    assert texts[3] == {i: t for i, t in own if i in first}

    hit = {r.doc_id for r in decontam.scan(kept[3], C.table(spark, SF, "benchmark")).collect() if r["_hits"].spans}
    assert {i: t for i, t in texts[4].items() if i not in hit} == {i: t for i, t in texts[3].items() if i not in hit}
    assert all(not r["_hits"].spans for r in decontam.scan(kept[4], C.table(spark, SF, "benchmark")).collect())

    packed = kept[5].collect()
    check(packed, texts[4], tokenizer)
    digest = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(P.run(spark, SF).collect()) == digest(packed)


def test_registered():
    import __spark_entry__ as E

    queries = E.queries()
    assert "pipeline" in queries
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in queries) == 1


def test_stages_keep_columns_of_an_empty_table(spark, table):
    docs = table([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert P.STAGES[-1][1](spark, docs, SF).count() == 0
    assert line_dedup.dedup(docs).count() == near_dup.dedup(docs).count() == 0


def test_row_numbers_outlast_another_split_layout(spark, table):
    """Splits that change between the jobs (as when executors come or go) don't mix up rows."""
    long = "this line is repeated and it has more than ten words in all"
    rows = [(i, f"own line {i} with a number of further words that nobody else has {i * 7}") for i in range(30)]
    rows += [(100 + i, f"{long}\nkept {i}") for i in range(6)] + [(200 + i, "one text that is here in some copies " * 4) for i in range(5)]
    docs = table(rows, parts=5)
    bench = table([("q", "nobody else has")], "item_id string, text string", parts=1)
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    outs = [lambda: line_dedup.apply(docs), lambda: near_dup.dedup(docs), lambda: decontam.scan(docs, bench, 3, 0)]
    found = []
    for make in outs:
        expected = sorted(map(str, make().collect()))
        out = make()  # its jobs so far read the splits of before
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            found.append((sorted(map(str, out.collect())), expected))
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert docs.rdd.getNumPartitions() > 1
    for got, expected in found:
        assert got == expected
