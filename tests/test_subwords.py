import random

import pytest
from pyspark.sql import functions as F

from escalade.operators import subwords as SW

PIECES = [("un", 10, True), ("a", 11, True), ("able", 12, False), ("aff", 13, False), ("ff", 14, False), ("a", 15, False), ("b", 16, False), ("unable", 17, True), ("é", 18, True)]
CLS, SEP, PAD, UNK = SW.FRAME.start, SW.FRAME.end, SW.FRAME.pad, SW.FRAME.unknown


def brute(word, pieces):
    """Longest match from its definition: try every cut from the longest."""
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            hit = [i for p, i, s in pieces if p == word[at:end] and s == (at == 0)]
            if hit:
                out.append(hit[0])
                at = end
                break
        else:
            return [UNK]
    return out


def pieces_df(spark, rows):
    return spark.createDataFrame(rows, "piece string, piece_id long, starts boolean")


def test_longest_match_against_the_definition():
    rng = random.Random(0)
    for _ in range(40):
        pieces = {("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), rng.random() < .5) for _ in range(rng.randrange(1, 12))}
        rows = [(p, i, s) for i, (p, s) in enumerate(sorted(pieces), 10)]
        tries = [SW._trie({p: i for p, i, s in rows if s == start}) for start in (True, False)]
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
            assert SW.longest_match(word, *tries, UNK) == brute(word, rows), (rows, word)


def test_windows_mask_and_labels(spark):
    words = [["unaffable", "a", "xyz"], [], None, ["un"] * 7, ["unable", None, "é"]]
    df = spark.createDataFrame([(i, w, i * 10) for i, w in enumerate(words)], "id long, terms array<string>, y int").repartition(3)
    out = {}
    for r in SW.subword_ids(df, "id", pieces_df(spark, PIECES), 6, label_col="y").collect():
        assert len(r.input_ids) == len(r.attention_mask) == 6 and r.labels == r.id * 10
        n = sum(r.attention_mask)
        assert r.attention_mask == [1] * n + [0] * (6 - n) and r.input_ids[n:] == [PAD] * (6 - n)
        assert r.input_ids[0] == CLS and r.input_ids[n - 1] == SEP
        out.setdefault(r.id, {})[r.window] = r.input_ids[1:n - 1]
    joined = {i: sum((w[k] for k in sorted(w)), []) for i, w in out.items()}
    assert joined == {i: [x for t in (w or []) if t is not None for x in brute(t, PIECES)] for i, w in enumerate(words)}
    assert joined[0] == [10, 13, 12, 11, UNK]  # un + aff + able, a, unknown
    assert [len(out[i]) for i in range(5)] == [2, 1, 1, 2, 1]
    cut = SW.subword_ids(df, "id", pieces_df(spark, PIECES), 6, label_col="y", truncate=True)
    assert "window" not in cut.columns
    assert {r.id: r.input_ids for r in cut.collect()}[3] == [CLS, 10, 10, 10, 10, SEP]
    assert {r.id: [x for x in r.input_ids if x != PAD] for r in cut.collect()} == {i: [CLS, *w[0], SEP] for i, w in out.items()}


def test_frames_without_specials_and_bad_sizes(spark):
    df = spark.createDataFrame([(1, ["un", "a"])], "id long, terms array<string>")
    row = SW.subword_ids(df, "id", pieces_df(spark, PIECES), 3, frame=SW.Frame(start=None, end=None)).collect()[0]
    assert row.input_ids == [10, 11, PAD] and row.attention_mask == [1, 1, 0]
    with pytest.raises(ValueError, match="room"):
        SW.subword_ids(df, "id", pieces_df(spark, PIECES), 2)
    with pytest.raises(ValueError, match="two ids"):
        SW.subword_ids(df, "id", pieces_df(spark, [("a", 1, True), ("a", 2, True)]), 5)


def test_pieces_are_checked_before_they_are_sent(spark, monkeypatch):
    monkeypatch.setattr(SW, "MAX_PIECES", 3)
    with pytest.raises(ValueError, match="no vocabulary"):
        SW.checked_pieces(pieces_df(spark, PIECES))


def test_pieces_from_words(spark):
    rows = SW.pieces_from_words(spark.createDataFrame([("ab",), ("ab",), ("b",), (None,), ("",)], "word string")).collect()
    assert sorted((r.piece, r.starts) for r in rows) == [(p, s) for p in ("a", "ab", "b") for s in (False, True)]
    assert sorted(r.piece_id for r in rows) == list(range(SW.FIRST_PIECE, SW.FIRST_PIECE + 6))


def test_ids_of_a_tokenizer_file(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = ["Whole texts, not prefixes. " * 40, "", None, "<|endoftext|> is ordinary here", "ß ünï"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    frame = SW.Frame(pad=0, start=49406, end=49407)
    got = {}
    for r in SW.tokenizer_ids(df, "id", path, 32, frame=frame).orderBy("id", "window").collect():
        got.setdefault(r.id, []).extend(r.input_ids[1:sum(r.attention_mask) - 1])
    assert got == {i: own.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_no_shuffle_of_texts(spark):
    df = spark.createDataFrame([(1, ["un"])], "id long, terms array<string>")
    plan = SW.subword_ids(df, "id", pieces_df(spark, PIECES), 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
