import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from escalade.llm import periodic as P

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs (start, length, period) of a word list, from the definition."""
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            lo = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - lo + q
            if length >= max(24, 3 * q):
                seen.setdefault((lo, length), q)  # periods rise: the first is the smallest
    return sorted(((s, l, q) for (s, l), q in seen.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, rewrite=P.planted):
    words = (text or "").encode().split()
    if rewrite and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def rows_of(df):
    return sorted(((r.doc_id, tuple(r)[1:]) for r in df.collect()), key=repr)


def made(rng, n):
    """A word sequence of periodic and other pieces."""
    out = []
    while len(out) < n:
        block = [rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 70]))]
        piece = block * rng.choice([1, 1, 3, 4, 9])
        out += piece[:rng.randrange(1, len(piece) + 1)] if rng.random() < .5 else piece
    return out[:n]


def test_fragments_of_whole_texts():
    rng = random.Random(1)
    texts = sorted(([w.encode() for w in made(rng, rng.choice([0, 1, 23, 24, 60, 200, 700]))] for _ in range(60)), key=lambda t: -len(t))
    starts = np.cumsum([0, *map(len, texts)])
    of, q, lo, hi = P.fragments(np.concatenate([P._numbers(t) for t in texts]), starts)
    keep = P._is_run(q, lo, hi)
    for i, t in enumerate(texts):
        mine = keep & (of == i)
        assert sorted(zip(lo[mine].tolist(), (hi - lo + q)[mine].tolist(), q[mine].tolist())) == sorted(brute(t)), i


def test_one_word_many_times_has_one_fragment():
    n = 50_000
    of, q, lo, hi = P.fragments(np.zeros(n, np.int32), np.array([0, n]))
    assert (q.tolist(), lo.tolist(), hi.tolist()) == ([1], [0], [n - 1])


@pytest.mark.parametrize("tile,small", [(P.TILE, P.SMALL), (64, 8), (128, 16)])
def test_tiles_and_whole_texts_agree_with_the_definition(table, tile, small):
    rng = random.Random(tile)
    rows = [(i, rng.choice([" ", "\n", "\t  "]).join(made(rng, rng.choice([30, 100, 400, 900])))) for i in range(40)]
    rows += [(100, "w " * 3_000), (101, " ".join(f"u{i}" for i in range(2_000)) + " " + " ".join(f"u{i}" for i in range(2_000)) * 2)]
    got = rows_of(P.digest(P.collapsed(table(rows), tile=tile, small=small)))
    assert got == sorted(((i, expected(i, t, None)) for i, t in rows), key=repr)


def test_query_against_the_definition(spark, docs):
    got = rows_of(P.op13_periodic_runs(spark, SF))
    assert got == sorted(((i, expected(i, t)) for i, t in docs.items()), key=repr)
    assert sum(r[1][0] > 0 for r in got) > 5


def test_edges(table):
    text = "a b c " * 20
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(None, text, "x", 1), (1, None, None, None), (2, "", "x", 1), (3, " \t\n ", "x", 1), (4, text, "x", 2), (4, text, "y", 3),
            (ids[0], " ".join(f"w{i}" for i in range(100)), "x", 1), (ids[1], "one", None, 1), (5, "é ü\x0bß\x0c" * 30, "z", 1),
            (6, "a b " * 30, "z", 1)]
    frame = table(rows, "doc_id long, text string, row string, period int")
    got = rows_of(P.digest(P.collapsed(frame, rewrite=P.planted)))
    assert got == sorted(((r[0], expected(r[0], r[1])) for r in rows), key=repr)
    out = {r.doc_id: r for r in P.collapsed(frame, rewrite=P.planted).collect()}
    assert out[4].text == "a b c" and out[4].runs[0].asDict() == {"start": 0, "length": 60, "period": 3}
    assert out[1].n_words == 0 and out[1].runs == []
    empty = table([], "doc_id long, text string")
    assert P.digest(P.collapsed(empty)).count() == 0


def test_very_long_text(table):
    words = [f"w{i % 997}" for i in range(200_000)] + [f"v{i}" for i in range(50_000)]
    row = P.collapsed(table([(1, " ".join(words))], parts=1)).collect()[0]
    assert [r.asDict() for r in row.runs] == [{"start": 0, "length": 200_000, "period": 997}]
    assert row.text == " ".join(words[:997] + words[200_000:])
