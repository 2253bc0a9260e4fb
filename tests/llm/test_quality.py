import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from escalade.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = Q.op12_quality_classifier(spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert ((rows.score >= 0.7).astype(int) == rows.predicted).all() and rows.score.between(0, 1).all()
    test = rows[rows.held_out]
    good = test.quality == test.predicted
    assert good[test.quality == 1].mean() > 0.99 and good[test.quality == 0].mean() > 0.97


def plain(text):
    """Some of the statistics from their meaning."""
    words = re.findall(r"[^ \t\r\v\f\n]+", text)
    sizes = [len(w.encode()) for w in words]
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    pairs = list(zip(words, words[1:]))
    return {
        "words": np.log1p(len(words)), "bytes": np.log1p(len(text.encode())), "longest_word": max(sizes, default=0),
        "word_length": sum(sizes) / n, "capitalised": sum(w[0] in Q.C.UPPER for w in words) / n,
        "all_capitals": sum(sum(c in Q.C.UPPER for c in w) >= 2 and not any(c in Q.C.LOWER for c in w) for w in words) / n,
        "distinct_words": len(set(words)) / n, "top_word": max(Counter(words).values(), default=0) / n,
        "distinct_pairs": len(set(pairs)) / max(len(pairs), 1), "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "lines_with_stop": sum(x[-1] in ".!?" for x in lines) / max(len(lines), 1), "words_a_line": len(words) / max(len(lines), 1),
        "short_words": sum(s <= 3 for s in sizes) / n, "stops_a_word": text.count(".") / n,
        "share_upper": sum(c in Q.C.UPPER for c in text) / max(len(text.encode()), 1),
    }


def test_statistics_against_their_meaning():
    texts = ["", "a", "The cat. THE CAT!! sat\non the mat.\non the mat.\n", "\n\n \n", " x", "x ", "Ünï cödé ß\tw\x0bq | || $$$",
             "a b a b a b\r\nlast line?", "ab", "w " * 500]
    got = Q.statistics(pa.array(texts + [None], pa.string()))
    assert got.shape == (len(texts) + 1, len(Q.STATISTICS)) and np.isfinite(got).all()
    assert not got[-1].any() and not got[0].any()
    for text, row in zip(texts, got):
        for name, value in plain(text).items():
            assert abs(row[Q.STATISTICS.index(name)] - value) < 1e-9, (text, name)
    # a batch and its slices give the same numbers
    whole = pa.array(texts, pa.string())
    assert np.array_equal(np.vstack([Q.statistics(whole.slice(i, 1)) for i in range(len(texts))]), got[:-1])


def walk(forest, row):
    """One row through one tree after the other."""
    out = forest.base
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
        out += value[at - len(feature)]
    return out


def test_flat_trees_against_single_walks():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 3, 600), np.zeros(600), rng.normal(size=600).round(1)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 1)).astype(float)
    forest = Q.boost(x, y, np.ones(600), 0.0, trees=12, depth=3, least=5)
    margin = forest.margin(x)
    assert np.allclose(margin, [walk(forest, r) for r in x])
    assert ((margin > 0) == (y > 0)).mean() > 0.98
    # odd values walk too
    assert np.isfinite(forest.margin(np.array([[np.inf, -1, 5, 0], [-np.inf, 9, 0, 0]]))).all()


def test_the_first_split_is_the_best_one():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    forest = Q.boost(x, y, np.ones(200), 0.0, trees=1, depth=1, bins=64, least=5, l2=1.0)
    g, h = 0.5 - y, np.full(200, 0.25)
    gains = {}
    for j in range(3):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            if 5 <= left.sum() <= 195:
                gains[j, t] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    j, t = forest.feature[0, 0], forest.threshold[0, 0]
    assert gains[j, t] >= max(gains.values()) - 1e-9
    left = x[:, j] <= t
    assert np.allclose(forest.value[0], [-0.1 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_edges(table):
    good = "The small cat sat on the mat near number {}. It was a quiet day in the garden."
    bad = "BUY$$$ NOW!!! {}### | | | $$$ @@@ BUY$$$ NOW!!! BUY$$$ ***"
    docs = [(i, (bad if i % 3 == 0 else good).format(i), "x", 1) for i in range(300)]
    docs += [(None, bad, None, 2), (900, None, "x", 3), (901, "", "x", 4), (902, bad * 20_000, "x", 5), (0, docs[0][1], "x", 1)]
    frame = table(docs, "doc_id long, text string, score string, _label int")
    labels = table([(i, int(i % 3 != 0)) for i in range(300)] + [(3, 1), (5, 1), (None, 1), (7, None), (8, 9)], "doc_id long, quality int")
    out = Q.keep_good(frame, labels)
    assert out.columns == frame.columns
    kept = [r.doc_id for r in out.collect()]
    assert 1 in kept and 4 in kept and 0 not in kept and 3 not in kept and None not in kept
    rows = Q.score(frame.drop("score"), Q.fit(frame, labels)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    none = Q.fit(frame, labels.filter("quality > 5"))
    assert {r.score for r in Q.score(frame.drop("score"), none).collect()} == {0.5}
    empty = table([], "doc_id long, text string")
    assert Q.keep_good(empty, labels).count() == 0
    assert Q.score(empty, Q.fit(empty, labels)).count() == 0


def test_the_sample_is_bounded_and_held_out_rows_are_not_seen(table):
    docs = table([(i, f"word{i}") for i in range(300)])
    labels = table([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    x, y, sizes = Q.sample(docs, labels, per_class=20)
    assert len(x) == len(y) == 40 and sorted(set(y)) == [0, 1]
    seen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sizes == {c: sum(i % 2 == c for i in seen) for c in (0, 1)}
