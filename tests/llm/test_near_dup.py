from collections import Counter

import numpy as np
import pytest

from escalade.llm import common as C
from escalade.llm import near_dup as N


def probability_jaccard(x, y):
    """From the definition, over Counters."""
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def counted(text):
    w = C.words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(texts):
    """Class of each (doc_id, text): its least doc_id."""
    bags = [counted(t) for _, t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if part[i] != part[j] and bags[i] and bags[i].keys() & bags[j].keys() and probability_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    return [min(texts[j][0] for j in range(len(texts)) if part[j] == part[i]) for i in range(len(texts))]


def test_similarity_is_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = " ".join(rng.choice(list("abcde"), 40))
        b = " ".join(rng.choice(list("abcde"), 40))
        x, y = N.shingles([C.words(a)])[1:], N.shingles([C.words(b)])[1:]
        assert N.similarity(x, y) == pytest.approx(probability_jaccard(counted(a), counted(b)))


def test_registers_agree_with_probability_jaccard():
    m = 20_000
    for a, b in (("a b c d e f g h i j", "a b c d e f g x y z"), ("p q " * 6, "p q " * 9 + "r s t"), ("k l m n o", "k l m n o p q")):
        bags = [C.words(a), C.words(b)]
        who = N.signatures(*N.shingles(bags), 2, m)
        assert np.mean(who[0] == who[1]) == pytest.approx(probability_jaccard(counted(a), counted(b)), abs=0.015)


def test_query_against_brute_force(spark, docs):
    rows = {r.doc_id: r for r in N.op4_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    texts = sorted(docs.items())
    want = brute(texts)
    assert [rows[i].class_id for i, _ in texts] == want
    size = Counter(want)
    for (i, _), c in zip(texts, want):
        assert rows[i].class_size == size[c] and rows[i].stays == (i == c)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10_000, n)]


def test_a_chain_and_buckets_in_several_components(table):
    # every text differs from the one before in one more place: ends are not similar, the class is one
    chain, own = [], words(400, 1)
    for i in range(12):
        own = list(own)
        own[i * 30 + 3] = f"changed{i}"
        chain.append((100 - i, " ".join(own)))
    far = [(500 + i, " ".join(words(300, 50 + i))) for i in range(5)]
    rows = N.classes(table(chain + far)).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert got == dict(zip([i for i, _ in chain + far], brute(chain + far)))
    assert {got[i] for i, _ in chain} == {89}


def test_edges(table):
    base = " ".join(words(200, 3))
    rows = [(5, base, "x", 1), (3, base.upper() + "!", "x", 2), (None, base, None, 3), (5, base, "x", 4), (7, None, "x", 5), (8, "", "x", 6),
            (9, "?!", "x", 7), (10, "two words", "x", 8), (11, "Two, words", "x", 9), (12, "one", "x", 10), (13, base + " " + "tail " * 30_000, "x", 11)]
    docs = table(rows, "doc_id long, text string, _row string, row int")
    out = N.dedup(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.row) for r in out.collect())
    assert kept == [(False, 0, 3), (True, 7, 5), (True, 8, 6), (True, 9, 7), (True, 10, 8), (True, 12, 10), (True, 13, 11)]
    assert N.classes(table([])).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in N.components(links).collect()}
    assert len({got[i] for i in range(n + 1)}) == 1
    assert len({got[i] for i in (1000, 1001, 1002)}) == 1 and got[1000] != got[0]
    assert N.components(links.filter("a < 0")).count() == 0
