import math
from collections import Counter

import numpy as np
import pytest

from escalade.llm import common as C
from escalade.llm import lm_score as M


def brute(docs, target, size):
    """(n, target, background) by doc position, from plain counts."""
    count = Counter(w for _, t in docs for w in C.words(t))
    known = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:size]}
    seqs = [["|"] + [w if w in known else "?" for w in C.words(t)] + ["|"] for _, t in docs]
    cells = len(known) + 2

    def model(chosen):
        two = Counter(x for s in chosen for x in zip(s, s[1:]))
        one, after, total = Counter(), Counter(), Counter()
        for (a, b), n in two.items():
            one[b] += n
            total[a] += n
            after[a] += 1
        t, n = len(one), sum(one.values())
        p1 = lambda w: (one[w] + t / cells) / (n + t) if n else 1 / cells
        return lambda a, b: -math.log((two[a, b] + after[a] * p1(b)) / (total[a] + after[a]) if total[a] else p1(b))

    good, every = model([s for s, (i, _) in zip(seqs, docs) if i in target]), model(seqs)
    return [(len(s) - 1, np.mean([good(*x) for x in zip(s, s[1:])]), np.mean([every(*x) for x in zip(s, s[1:])])) for s in seqs]


def test_query_against_plain_counts(spark, docs):
    target = {r["doc_id"] for r in C.table(spark, "/root/testdata/sf0.001", "labels").filter("quality = 1").collect()}
    rows = {r.doc_id: r for r in M.op8_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    own = sorted(docs.items())
    for (i, _), (n, t, b) in zip(own, brute(own, target, M.VOCABULARY)):
        assert rows[i].n_tokens == n
        assert rows[i].ce_target == pytest.approx(t, abs=1e-4) and rows[i].ce_background == pytest.approx(b, abs=1e-4)
        assert rows[i].ce_difference == pytest.approx(t - b, abs=2e-4)


def test_edges(table):
    docs = [(1, "good text here", 1), (2, "bad words there", 2), (3, None, 3), (None, "good", 4), (4, "", 5), (5, "x " * 50_000, 6), (1, "good text here", 1)]
    labels = table([(1, 1), (1, 0), (2, 0), (None, 1), (99, 1), (4, None)], "doc_id long, quality int")
    frame = table(docs, "doc_id long, text string, word int")
    model = M.fit(frame, labels, 5)
    out = M.score(frame, model)
    assert out.columns == ["doc_id", "text", "word", "n_tokens", "ce_target", "ce_background", "ce_difference"]
    rows = {r.word: r for r in out.collect()}
    assert len(rows) == 6 and rows[3].n_tokens == rows[5].n_tokens == 1
    for word, (n, t, b) in zip([d[2] for d in docs], brute([d[:2] for d in docs], {1}, 5)):
        assert (rows[word].n_tokens, rows[word].ce_target) == (n, pytest.approx(t, abs=1e-4))
    assert rows[1].ce_difference < rows[2].ce_difference
    none = M.fit(frame, labels.filter("quality = 7"), 5)
    assert np.allclose(none[1], math.log(7))
    empty = table([], "doc_id long, text string, word int")
    assert M.score(empty, M.fit(empty, labels)).count() == 0


def test_separates_held_out_quality(spark):
    """The lower the difference, the better the text: rank correlation with unseen labels on sf0.01."""
    sf = "/root/testdata/sf0.01"
    docs, labels = C.table(spark, sf, "documents"), C.table(spark, sf, "labels")
    seen = labels.filter("doc_id % 2 = 0")
    rows = M.score(docs, M.fit(docs, seen)).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "ce_difference").toPandas()
    good, bad = rows[rows.quality == 1].ce_difference, rows[rows.quality == 0].ce_difference
    auc = np.mean([(g < bad).mean() + (g == bad).mean() / 2 for g in good])
    assert auc > 0.5


def test_every_word_counts(table):
    """Documents that differ in rare words only get scores of their own; a model without a cap, also on unseen documents."""
    common = [(i, " ".join(f"w{j}" for j in range(2_100)), i) for i in range(2)]
    docs = [*common, (10, "rare alpha one", 10), (11, "rare beta two", 11), (11, "rare beta two", 12), (12, None, 13), (None, "rare alpha two", 14)]
    frame = table(docs, "doc_id long, text string, word int")
    model = M.fit(frame, table([(10, 1), (0, 1), (11, 0)], "doc_id long, quality int"))
    out = M.score(frame, model)
    assert out.columns == ["doc_id", "text", "word", "n_tokens", "ce_target", "ce_background", "ce_difference"]
    rows = {r.word: r for r in out.collect()}
    assert len(rows) == len(docs)
    for (*_, word), (n, t, b) in zip(docs, brute([d[:2] for d in docs], {10, 0}, None)):
        assert (rows[word].n_tokens, rows[word].ce_target, rows[word].ce_background) == (n, pytest.approx(t, abs=1e-9), pytest.approx(b, abs=1e-9))
    assert rows[10].ce_difference < rows[11].ce_difference == rows[12].ce_difference
    unseen = M.score(table([(1, "alpha new beta one"), (2, "w5 w7"), (3, "rare alpha one")]), model).orderBy("doc_id").collect()
    assert [r.n_tokens for r in unseen] == [5, 3, 4] and all(np.isfinite(r.ce_difference) for r in unseen)
    assert unseen[2].ce_difference == pytest.approx(rows[10].ce_difference, abs=1e-9)
    none = M.score(frame, M.fit(frame, table([(99, 1)], "doc_id long, quality int"))).collect()
    assert np.allclose([r.ce_target for r in none], math.log(2_100 + 5 + 2))
    empty = table([], "doc_id long, text string")
    assert M.score(empty, M.fit(empty, table([(99, 1)], "doc_id long, quality int"))).count() == 0


def test_blocks_and_ranges_give_plain_counts(table, monkeypatch):
    """Documents over several blocks and ranges of hashes, in turns; tables of one row a range, no row a bigram."""
    monkeypatch.setattr(M, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(M, "PART_TOKENS", 20)
    docs = [(i, " ".join(f"w{(i * j * j) % (7 + i % 5)}" for j in range(3 + i % 30)), i) for i in range(60)] + [(3, "w1 w1", 60), (None, None, 61)]
    frame = table(docs, "doc_id long, text string, word int")
    model = M.fit(frame, table([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    assert model.parts > 2 * M.TURNS and model.bigrams.count() <= model.parts and model.words.count() <= model.parts
    rows = {r.word: r for r in M.score(frame, model, ["word"]).collect()}
    assert len(rows) == len(docs)
    for (*_, word), (n, t, b) in zip(docs, brute([d[:2] for d in docs], {i for i in range(60) if i % 2}, None)):
        assert (rows[word].n_tokens, rows[word].ce_target, rows[word].ce_background) == (n, pytest.approx(t, abs=1e-9), pytest.approx(b, abs=1e-9))
