"""Cross-fitted naive-Bayes tiers against a plain-Python model."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from escalade.functions.text import analyzer_tokens
from escalade.operators.scoring import NaiveBayesTier

WORDS = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii", "jj"]


def corpus(seed=4, n=40, L=3, K=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.randrange(L)
        k = rnd.randrange(1, 12)
        words = [rnd.choice(WORDS[y * 3:y * 3 + 4] + WORDS[-2:]) for _ in range(k)]
        rows.append((i, i % K, y, " ".join(words)))
    rows.append((n, n % K, 0, "zz qq"))  # no token of any vocabulary below
    return rows


def brute(rows, L, K, vocab_size, output):
    toks = {r[0]: r[3].split() for r in rows}  # every piece is an analyzer token here
    total = Counter(t for r in rows for t in toks[r[0]])
    ranked = sorted(total, key=lambda t: (-total[t], t))
    vocab = set(ranked[:vocab_size] if vocab_size else ranked)
    out = {}
    for sid, f, y, _ in rows:
        tr = [r for r in rows if r[1] != f]
        n = {l: Counter() for l in range(L)}
        for r in tr:
            n[r[2]].update(t for t in toks[r[0]] if t in vocab)
        docs = Counter(r[2] for r in tr)
        mine = [t for t in toks[sid] if t in vocab]
        nt = len(mine)
        z = []
        for l in range(L):
            s = sum(math.log(n[l][t] + 1) for t in mine) - nt * math.log(sum(n[l].values()) + len(vocab))
            lp = math.log(docs[l] / len(tr))
            z.append(s / max(nt, 1) + lp if output == "softmax" else s + lp)
        if output == "softmax":
            m = max(z)
            e = [math.exp(v - m) for v in z]
            out[sid] = [round(v / sum(e), 9) for v in e]
        else:
            out[sid] = z.index(max(z))
    return out


@pytest.mark.parametrize("vocab_size,output", [(3, "softmax"), (6, "softmax"), (None, "one_hot")])
def test_nb_matches_brute_force(spark, vocab_size, output):
    L, K = 3, 3
    rows = corpus(L=L, K=K)
    df = spark.createDataFrame(rows, "sample_id long, fold int, gold_label int, text string")
    df = df.withColumn("bytes_sent", F.lit(0))
    tier = NaiveBayesTier(1, L, vocab_size, output, K, 9).fit(df)
    got = {r.sample_id: r for r in tier.score(df, ["sample_id"]).collect()}
    exp = brute(rows, L, K, vocab_size, output)
    assert set(got) == set(exp)
    for sid, e in exp.items():
        if output == "softmax":
            assert got[sid].proba == pytest.approx(e, abs=2e-9)
            assert got[sid].confidence == max(got[sid].proba)
        else:
            assert got[sid].label == e and got[sid].confidence == 1.0


def test_hot_cold_split_matches_brute_force(spark, monkeypatch):
    """Full-vocabulary tier with only 3 'hot' terms: both join branches run."""
    import escalade.operators.scoring as SC
    monkeypatch.setattr(SC, "HOT_TERMS", 3)
    L, K = 3, 3
    rows = corpus(seed=8, L=L, K=K)
    df = spark.createDataFrame(rows, "sample_id long, fold int, gold_label int, text string")
    tier = NaiveBayesTier(3, L, None, "softmax", K, 9).fit(df)
    assert tier.hot_model.count() == 3
    got = {r.sample_id: r.proba for r in tier.score(df, ["sample_id"]).collect()}
    exp = brute(rows, L, K, None, "softmax")
    for sid, e in exp.items():
        assert got[sid] == pytest.approx(e, abs=2e-9)


def test_fused_equals_separate(spark, monkeypatch):
    import escalade.operators.scoring as SC
    monkeypatch.setattr(SC, "HOT_TERMS", 4)
    L, K = 3, 3
    rows = corpus(seed=11, L=L, K=K)
    df = spark.createDataFrame(rows, "sample_id long, fold int, gold_label int, text string")
    counts = SC.term_class_counts(SC.token_occurrences(df, ["fold", "gold_label"]), L, K)
    tiers = [NaiveBayesTier(1, L, 2, "softmax", K, 9).fit(df, counts),
             NaiveBayesTier(2, L, 4, "softmax", K, 9).fit(df, counts),
             NaiveBayesTier(3, L, None, "one_hot", K, 9).fit(df, counts)]
    fused = {r.sample_id: r for r in SC.score_fused(tiers, df, ["sample_id"]).collect()}
    assert len(fused) == len(rows)
    for t in tiers:
        for r in t.score(df, ["sample_id"]).collect():
            f = fused[r.sample_id]
            assert (f[f"pred{t.tier}"], f[f"conf{t.tier}"]) == (r.label, r.confidence)


def test_top_n_over_broadcast_bound_uses_split_join(spark, monkeypatch):
    import escalade.operators.scoring as SC
    monkeypatch.setattr(SC, "MAX_BROADCAST_MODEL_BYTES", 1)
    monkeypatch.setattr(SC, "HOT_TERMS", 2)
    L, K = 3, 3
    rows = corpus(seed=13, L=L, K=K)
    df = spark.createDataFrame(rows, "sample_id long, fold int, gold_label int, text string")
    tier = NaiveBayesTier(2, L, 6, "softmax", K, 9).fit(df)
    assert not tier.bounded and tier.hot_model is not None
    got = {r.sample_id: r.proba for r in tier.score(df, ["sample_id"]).collect()}
    exp = brute(rows, L, K, 6, "softmax")
    for sid, e in exp.items():
        assert got[sid] == pytest.approx(e, abs=2e-9)


def test_class_missing_outside_a_fold(spark):
    """A class whose samples all sit in one fold has prior 0 for that fold."""
    L, K = 3, 3
    rows = [r for r in corpus(seed=21, L=L, K=K) if r[2] != 2] + [(900, 0, 2, "gg hh ii"), (903, 0, 2, "hh ii")]
    df = spark.createDataFrame(rows, "sample_id long, fold int, gold_label int, text string")
    tier = NaiveBayesTier(1, L, 6, "softmax", K, 9).fit(df)
    got = {r.sample_id: r for r in tier.score(df, ["sample_id"]).collect()}
    for sid in (900, 903):
        assert got[sid].proba[2] == 0.0 and got[sid].confidence is not None
    # other folds still see class 2 and score it normally
    assert all(r.confidence is not None for r in got.values())
