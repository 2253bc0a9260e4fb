import zlib

import numpy as np

from escalade.llm import toxicity as T


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = T.op2_toxicity(spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all() and rows.score.between(0, 1).all()
    test = rows[rows.held_out]
    good = (test.toxic == test.predicted)
    assert good.mean() > 0.97
    assert good[test.toxic == 1].mean() > 0.85 and good[test.toxic == 0].mean() > 0.99


def test_swapping_group_names_moves_the_score_less():
    """All toxic texts name one group: without the penalty its name alone counts as toxic."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        toxic = i % 2
        group = "women" if toxic else rng.choice(["men", "girls", "boys"])
        own = {group, *(f"w{x}" for x in rng.integers(0, 40, 6))} | ({"awful"} if toxic and i % 4 == 1 else set())
        rows.append((toxic, sorted({b for w in own for b in T.buckets(w)}), sorted(own & T._CATEGORY.keys())))
    sizes = {0: 300, 1: 300}
    score = lambda model, *ws: model[1] + sum(model[0][b] for b in {b for w in ws for b in T.buckets(w)})
    plain, fair = T.train(rows, sizes, swap_weight=0), T.train(rows, sizes)
    gap = [abs(score(m, "women", "w1") - score(m, "men", "w1")) for m in (plain, fair)]
    assert gap[1] < gap[0] / 2
    assert score(fair, "awful", "men") > score(fair, "men")


def test_edges(table):
    docs = [(i, f"nice words number{i} " + ("stupid idiot" if i % 3 == 0 else "friendly"), "x", 1) for i in range(200)]
    docs += [(None, "idiot", None, 2), (900, None, "x", 3), (901, "", "x", 4), (902, "idiot " * 50_000, "x", 5), (0, docs[0][1], "x", 1)]
    labels = table([(i, int(i % 3 == 0)) for i in range(200)] + [(3, 1), (5, 1), (None, 1), (7, None), (8, 9)], "doc_id long, toxic int")
    frame = table(docs, "doc_id long, text string, score string, _label int")
    out = T.drop_toxic(frame, labels)
    assert out.columns == frame.columns
    kept = [r.doc_id for r in out.collect()]
    assert 900 in kept and 901 in kept and 902 not in kept and 0 not in kept and 3 not in kept and 4 in kept
    rows = T.score(frame.drop("score"), T.fit(frame, labels)).collect()
    assert len(rows) == len(docs) and all(r.score is not None for r in rows)
    none = T.fit(frame, labels.filter("toxic > 5"))
    assert not none[0].any() and all(0 <= r.score <= 1 for r in T.score(frame.drop("score"), none).collect())
    empty = table([], "doc_id long, text string")
    assert T.drop_toxic(empty, labels).count() == 0


def test_the_sample_is_bounded_and_held_out_rows_are_not_seen(table):
    docs = table([(i, f"word{i}") for i in range(300)])
    labels = table([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    rows, sizes = T.sample(docs, labels, per_class=20)
    assert len(rows) == 40
    seen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    assert sizes == {c: sum(i % 2 == c for i in seen) for c in (0, 1)}
