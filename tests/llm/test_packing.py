import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from escalade.llm import packing as P
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


ENCODER = P.WordEncoder(PATH)
PARTS = ["a", "the", "The", "é", "1", "22", "²", "'s", "'", ".", ",", "\n", "\n\n", " ", "  ", "\t", "\xa0", " ", "\r\n", "\x1c",
         "<|endoftext|>", "漢字", "🙂", "don't", "_", "-", " word", "\nLine"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_word_encoder_gives_the_tokenizers_ids(text):
    want = np.array(ENCODER.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ENCODER(pa.array([text, None, text]))[0] == want


def test_word_encoder_forgets(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 3)
    e = P.WordEncoder(PATH)
    for text in ("one two three four five", "six seven", "one two nine"):
        assert e(pa.array([text]))[0] == np.array(e.tok.encode(text).ids, "<u4").tobytes()


def slow_best_fit(lengths, size):
    rooms, out = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
            out.append(min(fits))
        else:
            rooms.append(size - n)
            out.append(size)
    return out, len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing_takes_the_tightest_bin(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = P.best_fit_decreasing(lengths, 20)
    rooms, n = slow_best_fit(lengths, 20)
    assert [20 - o for o in offsets] == rooms
    assert len(set(bins)) == n
    filled = defaultdict(list)
    for b, o, x in zip(bins, offsets, lengths):
        filled[b].append((o, x))
    for own in filled.values():  # gapless from 0
        at = 0
        for o, x in sorted(own):
            assert o == at
            at += x
        assert at <= 20


def check(rows, docs, tokenizer, seq_len=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for doc_id, own in pieces.items():
        ids = tokenizer.encode(docs[doc_id] or "", add_special_tokens=False).ids + [2]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == seq_len for r in own[1:]) and own[0].length <= seq_len
        assert len(own) == -(-len(ids) // seq_len)
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= seq_len
    return len(sequences)


def test_pieces_and_places(spark, docs, tokenizer):
    rows = P.op5_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    used = check(rows, docs, tokenizer)
    assert used <= -(-sum(r.length for r in rows) // 1024) + 3


def test_edges(table, tokenizer):
    texts = {1: None, 2: "", 3: " ", 4: "word " * 3000, 5: "x" * 5000, 6: "a\n\n\nb  c\t d\n", None: "no id"}
    rows = P.packed_digest(table([(k, v, "x", 7) for k, v in texts.items()], "doc_id long, text string, piece string, length int")).collect()
    check(rows, texts, tokenizer)
    twice = P.packed_digest(table([(1, "same text")] * 3)).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert P.packed_digest(table([])).count() == 0


def test_sequences_hold_the_ids(table, tokenizer):
    docs = table([(i, f"text number {i} " * (i + 1)) for i in range(40)])
    pieces = P.tokenize(docs, seq_len=64)
    packed = P.pack(pieces, seq_len=64)
    whole = {r.sequence_id: bytes(r.ids) for r in P.sequences(pieces, packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset * 4:(r.offset + r.length) * 4] == bytes(r.ids)


def test_repeated_rows_spread_over_blocks(table, tokenizer):
    """A third of all rows are equal: no block holds them all, and full pieces meet no block."""
    rows = [(1, "the same short text")] * 400 + [(10 + i, f"text {i} " * (i % 50 + 1)) for i in range(780)] + [(5000 + i, "a" + " b" * 1022) for i in range(20)]
    pieces = P.tokenize(table(rows)).select("doc_id", "piece", "start", "length")
    packed = P.pack(pieces, block=100).collect()
    assert len(packed) == len(rows)
    blocks, filled = Counter(), defaultdict(list)
    for r in packed:
        filled[r.sequence_id].append((r.offset, r.length))
        assert (r.sequence_id < 0) == (r.length == 1024)
        if r.doc_id == 1:
            blocks[r.sequence_id >> 32] += 1
    assert len(blocks) == 12 and max(blocks.values()) < 80
    for own in filled.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
