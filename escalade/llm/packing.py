"""Best-fit packing of tokenised documents into fixed-length sequences (operator 5).

``tokenize`` turns each document into pieces of at most ``seq_len`` tokens;
``pack`` places the pieces: full pieces are sequences of their own, the others
go through best-fit decreasing. The tightest open bin is found by a segment
tree over the remaining capacities (1..seq_len) in O(log seq_len) per piece.

Scale: pieces are written once with a row number. Full pieces are given a sequence where
they are read. Each document has exactly one piece that may be short; these are dealt by a hash of
the row number, so that repeated rows spread too, into blocks of about ``block`` pieces, and each
block is packed on its own; a block leaves at most a few partly filled sequences, 1 in tens
of thousands. No task ever holds more than its block's narrow rows.

Defined results: null text = empty document (the end id alone); an empty table
gives no rows; repeated rows are separate documents; equal lengths are taken in
order of (doc_id, start, digest), nulls first; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import common as C

SEQ_LEN = 1024
END_ID = 2
# Short pieces per packing block: a task holds some 16k x 40-byte rows.
BLOCK_DOCS = 16_384
# Words whose ids a worker remembers before it starts over (about 100 bytes each).
CACHE_WORDS = 200_000
# Bytes of text a worker encodes at a time.
GATHER_BYTES = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"
# White space where a word's ids could depend on its neighbour (see WordEncoder)
_BLANK = r"\t\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TIED = rf"[{_BLANK}][{_BLANK}\n]|\n[{_BLANK}]|\n\n\n|\n\n\z|[{_BLANK}]\z|\A[{_BLANK}\n]"


class WordEncoder:
    """Ids of whole texts, remembering the ids of words already seen.

    The byte-level pre-tokeniser attaches one blank to the word after it and takes a
    line feed for itself, so a text may be cut before blanks and line feeds as long as
    no other white space is next to them; the ids of the cuts, joined, are the ids of
    the text. Other texts, and those with a special token's string, are encoded whole. A batch's distinct words are looked up
    once, and their ids gathered from a pool of all known words' ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token
        for token, i in vocab.items():
            self.size[i] = len(token)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.feed = len(self._encode(["\n"])[0])
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, "<u4")
        self.used, self.start, self.count = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], run: int = 500) -> None:
        """Ids of new words, encoded many to a text and cut apart by their bytes."""
        groups = [[w if w[:1] == "\n" else " " + w for w in new[a:a + run]] for a in range(0, len(new), run)]
        starts, counts, pieces, used = [self.start], [self.count], [], self.used
        for group, ids in zip(groups, self._encode(["".join(g) for g in groups])):
            cuts = np.cumsum([len(w) for w in map(str.encode, group)])
            ends = np.cumsum(self.size[ids])
            at = np.searchsorted(ends, cuts) + 1
            if at[-1] > len(ends) or (ends[at - 1] != cuts).any():  # a token over a cut: never for this vocabulary
                each = self._encode(group)
                ids, at = np.concatenate(each), np.cumsum([len(x) for x in each])
            starts.append(used + np.concatenate(([0], at[:-1])))
            counts.append(np.diff(at, prepend=0))
            pieces.append(ids)
            used += len(ids)
        self.start, self.count = np.concatenate(starts), np.concatenate(counts)
        if used > len(self.pool):
            self.pool = np.concatenate((self.pool[:self.used], np.zeros(2 * used - self.used, "<u4")))
        self.pool[self.used:used] = np.concatenate(pieces)
        self.used = used
        self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none), without an end id."""
        if len(self.slot) > CACHE_WORDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        mask = pc.match_substring_regex(texts, _TIED)
        for special in self.special:  # such a token ends the text before it
            mask = pc.or_(mask, pc.match_substring(texts, special))
        tied = np.flatnonzero(mask.to_numpy(zero_copy_only=False)).tolist()
        plain = pc.if_else(mask, "", texts) if tied else texts
        plain = pc.binary_join_element_wise("\n", pc.replace_substring(plain, "\n", " \n"), "")
        parts = pc.split_pattern(plain, " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = np.fromiter(map(self.slot.get, distinct, repeat(-1)), np.int64, len(distinct))
        unseen = np.flatnonzero(slots < 0)
        if len(unseen):
            slots[unseen] = np.arange(len(self.slot), len(self.slot) + len(unseen))
            self._learn([distinct[i] for i in unseen.tolist()])
        own = slots[coded.indices.to_numpy()]
        counts = self.count[own]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.pool[np.repeat(self.start[own] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        offsets = parts.offsets.to_numpy()
        bounds = (ends[offsets - offsets[0]] * 4).tolist()
        lead = self.feed * 4
        out = [ids[a + lead:b] for a, b in zip(bounds, bounds[1:])]
        for i, x in zip(tied, self._encode([texts[i].as_py() for i in tied])):
            out[i] = x.tobytes()
        return out


def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return C.worker_cache(("encoder", path), lambda: WordEncoder(path))


def tokenize(docs: DataFrame, tokenizer: str | None = None, seq_len: int = SEQ_LEN,
             end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids).

    ``ids`` is binary, little-endian unsigned 32-bit. A document is its ids and
    then ``end_id``; a longer one than ``seq_len`` is cut so that all pieces but
    the first have ``seq_len`` tokens. ``tokenizer`` is the vocabulary file
    (default: the public byte-level BPE of 50k).
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    C.workers(docs.sparkSession)
    end, whole = int(end_id).to_bytes(4, "little"), seq_len * 4

    def gathered(batches: Iterator) -> Iterator:
        """Ids and texts of several batches together, up to ``GATHER_BYTES`` and one batch."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > GATHER_BYTES:
                yield [pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)]
                held, size = [], 0
        if held:
            yield [pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)]

    def cut(batches: Iterator) -> Iterator:
        encode = _encoder(tokenizer)
        for doc_ids, texts in gathered(batches):
            out = ([], [], [], [], [])
            for doc, ids in zip(doc_ids.to_pylist(), encode(texts)):
                ids += end
                first = len(ids) % whole or whole
                bounds = [0, *range(first, len(ids) + 1, whole)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for column, value in zip(out, (doc, k, a // 4, (b - a) // 4, ids[a:b])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Capacities:
    """Segment tree over remaining capacities 0..n: how many open bins have each.

    ``fit(need)`` gives the smallest capacity >= need that an open bin has
    (0: none) by one walk up and one walk down the tree.
    """

    def __init__(self, n: int):
        self.leaf = 1
        while self.leaf <= n:
            self.leaf *= 2
        self.count = [0] * (2 * self.leaf)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaf
        while i:
            self.count[i] += by
            i >>= 1

    def fit(self, need: int) -> int:
        count, i = self.count, need + self.leaf
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to a right sibling with a bin
                i >>= 1
            if i <= 1:
                return 0
            i += 1
            while i < self.leaf:
                i *= 2
                if not count[i]:
                    i += 1
        return i - self.leaf


def best_fit_decreasing(lengths, seq_len: int = SEQ_LEN) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; ``lengths`` must not increase.

    A piece goes to the open bin with the least room that still holds it.
    """
    tree, open_bins, bins, offsets, n = Capacities(seq_len), {}, [], [], 0
    for length in lengths:
        room = tree.fit(length) if length < seq_len else 0
        if room:
            tree.add(room, -1)
            b = open_bins[room].pop()
        else:
            room, b, n = seq_len, n, n + 1
        bins.append(b)
        offsets.append(seq_len - room)
        if room > length:
            tree.add(room - length, 1)
            open_bins.setdefault(room - length, []).append(b)
    return bins, offsets


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN, block: int = BLOCK_DOCS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length and further columns) with their place:
    sequence_id and offset."""
    rest = [c for c in pieces.columns if c not in ("doc_id", "piece", "start", "length")]
    numbered = C.keyed(pieces, "__piece")
    full = F.col("length") >= seq_len
    blocks = max(1, -(-numbered.filter(~full).count() // block))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def place(key, frame):
        order = [c for c in ("doc_id", "start", *rest)]
        frame = frame.sort_values(["length", *order], ascending=[False] + [True] * len(order),
                                  kind="stable", na_position="first")
        bins, offsets = best_fit_decreasing(frame["length"].tolist(), seq_len)
        frame["sequence_id"] = [(key[0] << 32) + b for b in bins]
        frame["offset"] = offsets
        return frame.drop(columns="__block")

    dealt = numbered.filter(~full).withColumn("__block", F.pmod(F.xxhash64("__piece"), F.lit(blocks)).cast("long")).drop("__piece")
    packed = dealt.repartition(blocks, "__block").groupBy("__block").applyInPandas(place, schema)
    # numbers of full sequences are negative, so that they meet no block's
    alone = numbered.filter(full).select(*pieces.columns, (-1 - F.col("__piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its digest and its place."""
    return packed_digest(C.table(spark, sf_dir, "documents"))


def packed_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    pieces = tokenize(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, joined: (sequence_id, length, ids).

    ``packed`` is the placement of ``pieces`` (with ids); a sequence holds at
    most ``seq_len`` tokens, so the group is bounded.
    """
    if "ids" not in packed.columns:
        packed = packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_p"))
            .select("sequence_id", "length",
                    F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
