"""Cross-entropy difference between a target and a background language model (operator 8).

Both are bigram models with interpolated (Witten-Bell) smoothing over one shared
vocabulary: every word of all documents, one class for words that the documents don't
have and the document boundary. They are matched in everything but the
text they are counted on: the target on the documents chosen by ``labels.quality``,
the background on all documents. A document's score is the mean over its tokens
(its words and the end) of the difference of the losses, target minus background;
the lower, the closer to the target.

Scale: a model is two written tables that grow with the corpus: the counts of all bigrams, and per word
its count and its number of different successors. Words and bigrams are 64-bit hashes (of ten million
two are equal with probability 3e-6), and a row of a table holds all counts of one range of hashes, so
that no word, however frequent, falls to one task. A task combines the bigrams of a block of documents and
sends each range what it has of it, once a block. To score, a block asks each range for the counts of
its words and bigrams; the answers come back in the order of the question, without keys, and the losses are
computed and summed in the block. Blocks and ranges have a bounded size; their number grows.

A caller may bound the vocabulary by ``size``; then other words are one class and the
models are dense tables of (size + 2)^2 cells.

Defined results: null or empty texts have only the end token; rows without a
label or doc_id belong to the background alone; a document labelled twice is in the
target if any label says so; words of equal count enter a bounded vocabulary in
alphabetical order; with no target documents the target model is uniform; an empty
table gives no rows; repeated rows are counted and scored row by row; extra
columns are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from escalade.llm import common as C

VOCABULARY = None  # every word
# Tokens of a block of documents, whose bigrams are combined; tokens for each part of the models.
BLOCK_TOKENS, PART_TOKENS = 1_000_000, 1_500_000
# Parts are dealt in so many turns, one after the other: the shuffles of one are on disk at a time.
TURNS = 2
# Word hashes a worker keeps.
CACHE_WORDS = 150_000
# Distinct words a task holds before it hands its counts on.
FLUSH_WORDS = 300_000
# Cells a task collects before it adds them to its table.
FLUSH_CELLS = 2_000_000


def vocabulary(docs: DataFrame, size: int) -> list[str]:
    """The ``size`` most frequent words of all texts."""
    C.workers(docs.sparkSession)

    def count(batches: Iterator) -> Iterator:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast("string"), pa.array(held.values(), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for text in C.texts(batch.column(0)):
                held.update(C.words(text))
                if len(held) > FLUSH_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def _numbered(text, number: dict, edge: int) -> np.ndarray:
    """Word numbers of a text between two boundaries (0: not in the vocabulary)."""
    found = C.words(text)
    ids = np.empty(len(found) + 2, np.int64)
    ids[0] = ids[-1] = edge
    ids[1:-1] = np.fromiter(map(number.get, found, repeat(0)), np.int64, len(found))
    return ids


def counts(docs: DataFrame, words: list[str], target: str) -> np.ndarray:
    """Bigram counts of the documents where ``target`` holds, and of all: (2, S, S)."""
    spark, edge = docs.sparkSession, len(words) + 1
    size = edge + 1
    shared = spark.sparkContext.broadcast({w.encode(): i + 1 for i, w in enumerate(words)})

    def count(batches: Iterator) -> Iterator:
        number, totals, held, n = shared.value, np.zeros((2, size * size), np.int64), ([], []), 0

        def add():
            for k in (0, 1):
                if held[k]:
                    at, times = np.unique(np.concatenate(held[k]), return_counts=True)
                    totals[k, at] += times
                    held[k].clear()

        for batch in batches:
            for text, chosen in zip(C.texts(batch.column(0)), batch.column(1).to_pylist()):
                ids = _numbered(text, number, edge)
                cells = ids[:-1] * size + ids[1:]
                held[1].append(cells)
                if chosen:
                    held[0].append(cells)
                n += len(cells)
                if n > FLUSH_CELLS:
                    add()
                    n = 0
        add()
        totals = totals.ravel()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["cell", "n"])

    sums = docs.select(F.col("text").cast("string"), F.coalesce(F.col(target), F.lit(False))) \
        .mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size * size, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(2, size, size)


def losses(n: np.ndarray) -> np.ndarray:
    """Loss (negative log-probability) of each word after each word, from bigram counts."""
    size = len(n)
    one = n.sum(0)
    kinds = (one > 0).sum()
    p1 = (one + kinds / size) / max(one.sum() + kinds, 1) if one.any() else np.full(size, 1 / size)
    total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    p = np.where(total > 0, (n + kinds * p1) / np.maximum(total + kinds, 1), p1)
    return -np.log(p).astype(np.float32)


def _spill(df: DataFrame, name: str) -> DataFrame:
    """``C.spill``, well compressed; the shuffles that it took go when it has been written."""
    conf, own = df.sparkSession.conf, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        return C.spill(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _in_turns(step, parts: int, name: str) -> DataFrame:
    """``step(parts of a turn)`` of each turn, written one after the other."""
    turns = [_spill(step(range(k, parts, TURNS)), f"{name}-{k}") for k in range(TURNS)]
    return reduce(DataFrame.unionByName, turns)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EDGE = xxhash.xxh64_intdigest(b"")  # no word is empty


class _Hashes(dict):
    """Word -> 64-bit hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _bigrams(texts: list, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number (from ``first``), hash and next hash of every token of the texts."""
    hashes = C.worker_cache("bigram hashes", _Hashes)
    found = [C.words(t) for t in texts]
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size)
    after = np.full(int(size.sum()), _EDGE, np.uint64)
    inner = np.ones(len(after), bool)
    inner[ends - 1] = False
    after[inner] = np.fromiter((h for d in found for h in map(hashes.__getitem__, d)), np.uint64, int(inner.sum()))
    before = np.roll(after, 1)  # a text starts after the end of the one before
    return np.repeat(np.arange(first, first + len(found)), size), before, after


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``key`` and the starts of runs of equal keys in it."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    new = np.ones(len(order), bool)
    new[1:] = own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def _pack(x: np.ndarray) -> bytes:
    """Counts, byte by byte of all: what is small compresses away."""
    return x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _keys(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts begin and end in sorted keys: equal ranges of the hashes."""
    at = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, at), len(keys))


def _part_rows(parts: int, keys: np.ndarray, turn: range | None = None):
    """(part, start, end) of the parts (of a turn) that have sorted keys."""
    cut = _cuts(keys, parts)
    return [(p, cut[p], cut[p + 1]) for p in turn or range(parts) if cut[p] < cut[p + 1]]


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in order, and the sums of its counts."""
    order, at = _runs(keys)
    return keys[order[at]], *(np.add.reduceat(c[order], at) if len(at) else c for c in counts)


def _row(names: list[str], rows: list[tuple], types: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_COUNTS = ["part", "words", "keys", "n", "t", "k", "kt"]
_COUNTS_DDL = "part int, words boolean, keys binary, n binary, t binary, k binary, kt binary"
_COUNTS_TYPES = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]


def _counts(blocks: DataFrame, parts: int, turn: range) -> DataFrame:
    """The counts of the bigrams by part of their hash (n, and t in the target documents), and what each part
    adds to the words that come first (with their different successors k, kt), by part of theirs."""
    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            for sizes, target, words, ids in zip(*(c.to_pylist() for c in batch.columns)):
                before, _, number, own = _block_bigrams(words, ids)
                chosen = np.repeat(np.frombuffer(target, bool), _unpack(sizes))
                n, t = np.bincount(number, minlength=len(own)), np.bincount(number[chosen], minlength=len(own))
                first = np.empty(len(own), np.int64)
                first[number] = before
                words, rows = _keys(words), []
                for p, i, j in _part_rows(parts, own, turn):
                    by = np.argsort(first[i:j], kind="stable")  # words once, each with its number of bigrams
                    w = first[i:j][by]
                    start = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                    rows.append((p, own[i:j][by].tobytes(), _pack(n[i:j][by]), _pack(t[i:j][by]), words[w[start]].tobytes(), _pack(np.diff(np.append(start, len(w))))))
                yield from _row(["part", "keys", "n", "t", "a", "times"], rows, [pa.int32(), *[pa.binary()] * 5]).to_batches()

    def merge(group: pa.Table) -> pa.Table:
        part, cols = group["part"][0].as_py(), {c: group[c].to_pylist() for c in ("keys", "n", "t", "a", "times")}
        key = np.concatenate([_keys(x) for x in cols["keys"]])
        n, t = (np.concatenate([_unpack(x) for x in cols[c]]) for c in ("n", "t"))
        a = np.concatenate([np.repeat(_keys(x), _unpack(m)) for x, m in zip(cols["a"], cols["times"])])
        order, at = _runs(key)
        key, a, n, t = key[order[at]], a[order[at]], np.add.reduceat(n[order], at), np.add.reduceat(t[order], at)
        w, wn, wt, k, kt = _summed(a, n, t, np.ones(len(a), np.int64), (t > 0).astype(np.int64))
        rows = [(part, False, key.tobytes(), _pack(n), _pack(t), None, None)]
        rows += [(p, True, w[i:j].tobytes(), *(_pack(x[i:j]) for x in (wn, wt, k, kt))) for p, i, j in _part_rows(parts, w)]
        return _row(_COUNTS, rows, _COUNTS_TYPES)

    counted = blocks.select("sizes", "target", "words", "ids").mapInArrow(count, "part int, keys binary, n binary, t binary, a binary, times binary")
    return counted.groupBy("part").applyInArrow(merge, _COUNTS_DDL)


@dataclass
class Tables:
    """Models over every word, in ``parts`` rows each: ``words`` and ``bigrams`` hold sorted hashes and their counts
    in all documents (n, different successors k) and in the target (t, kt); ``totals`` are those of the words."""

    words: DataFrame
    bigrams: DataFrame
    totals: dict
    parts: int


def _tables(blocks: DataFrame) -> Tables:
    """Models over every word of the documents of ``_blocks``."""
    tokens = blocks.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 4
    parts = int(max(2 * blocks.sparkSession.sparkContext.defaultParallelism, tokens // PART_TOKENS))
    counted = _in_turns(lambda turn: _counts(blocks, parts, turn), parts, "lm-counts")

    def total(group: pa.Table) -> pa.Table:
        w, *c = _summed(np.concatenate([_keys(x) for x in group["keys"].to_pylist()]),
                        *(np.concatenate([_unpack(x) for x in group[c].to_pylist()]) for c in ("n", "t", "k", "kt")))
        row = (group["part"][0].as_py(), w.tobytes(), *map(_pack, c), int(c[0].sum()), int(c[1].sum()), len(w), int((c[1] > 0).sum()))
        return _row(["part", "keys", "n", "t", "k", "kt", "all_n", "all_n_t", "all_words", "all_words_t"], [row],
                    [pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * 4])

    words = _spill(counted.filter("words").groupBy("part").applyInArrow(
        total, "part int, keys binary, n binary, t binary, k binary, kt binary, all_n long, all_n_t long, all_words long, all_words_t long"), "lm-words")
    totals = words.agg(*[F.coalesce(F.sum(f"all_{c}"), F.lit(0)).alias(c) for c in ("n", "n_t", "words", "words_t")]).first().asDict()
    return Tables(words, counted.filter("not words"), totals, parts)


def _blocks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each block of documents: the columns ``keep`` of each, its number of tokens, whether it is in the target (``__target``),
    all words' places in the block's sorted words. A block is read several times, so it is written once and has a number."""
    C.workers(docs.sparkSession)
    kept = docs.select(*keep).schema
    target = F.coalesce(F.col("__target"), F.lit(False)) if "__target" in docs.columns else F.lit(False)
    texts = docs.select(F.struct(*keep).alias("doc"), F.col("text").cast("string").alias("text"), target.alias("target"))

    def split(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        held, tokens, block = [], 0, TaskContext.get().partitionId() << 32

        def out():
            rows = pa.concat_arrays([x[0] for x in held])
            sizes, after, target = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            words, ids = np.unique(after, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                                               pa.array([_pack(sizes)]), pa.array([target.tobytes()]), pa.array([words.tobytes()]), pa.array([_pack(ids)[: 4 * len(ids)]])],
                                              names=["block", "docs", "sizes", "target", "words", "ids"])

        for batch in batches:
            doc, _, after = _bigrams(C.texts(batch.column(1)))
            held.append((batch.column(0), np.bincount(doc, minlength=batch.num_rows), after, batch.column(2).to_numpy(zero_copy_only=False).astype(bool)))
            tokens += len(after)
            if tokens > BLOCK_TOKENS:
                yield out()
                held.clear()
                tokens, block = 0, block + 1
        if tokens:
            yield out()

    schema = StructType([StructField("block", LongType()), StructField("docs", ArrayType(kept)), StructField("sizes", BinaryType()),
                         StructField("target", BinaryType()), StructField("words", BinaryType()), StructField("ids", BinaryType())])
    return _spill(texts.mapInArrow(split, schema), "lm-blocks")


def _block_bigrams(words: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: places of each token's word before and of its own, its bigram's number, and the sorted bigrams."""
    words, after = _keys(words), _unpack(ids + bytes(len(ids)))
    before = np.roll(after, 1)
    order, at = _runs(key := C.mix64(words[before] * _GOLDEN + words[after]))
    number = np.empty(len(key), np.int64)
    number[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
    return before, after, number, key[order[at]]


def _looked_up(blocks: DataFrame, table: DataFrame, parts: int, names: list[str], of, turn: range) -> DataFrame:
    """(block, part, ``names``): for each block the counts of its sorted keys (``of`` its row; 0: not in the table), part by part of a turn."""
    def ask(batches: Iterator) -> Iterator:
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                keys = of(*row)
                rows = [(p, block, keys[i:j].tobytes(), *[None] * len(names)) for p, i, j in _part_rows(parts, keys, turn)]
                yield from _row(columns, rows, types).to_batches()

    def answer(group: pa.Table) -> pa.Table:
        block, part, keys = group["block"].to_pylist(), group["part"][0].as_py(), group["keys"].to_pylist()
        known = block.index(None) if None in block else None
        if known is None:
            have, counts = np.empty(0, np.uint64), [np.empty(0, np.int64)] * len(names)
        else:
            have, counts = _keys(keys[known]), [_unpack(group[c][known].as_py()) for c in names]
        rows = []
        for k, asked in zip(block, keys):
            if k is not None:
                asked = _keys(asked)
                at = np.minimum(np.searchsorted(have, asked), max(len(have) - 1, 0))
                hit = have[at] == asked if len(have) else np.zeros(len(asked), bool)
                rows.append((k, part, *(_pack(np.where(hit, c[at] if len(c) else 0, 0)) for c in counts)))
        return _row(["block", "part", *names], rows, [pa.int64(), pa.int32(), *[pa.binary()] * len(names)])

    columns, types = ["part", "block", "keys", *names], [pa.int32(), pa.int64(), *[pa.binary()] * (1 + len(names))]
    binary = ", ".join(f"{c} binary" for c in names)
    asked = blocks.mapInArrow(ask, f"part int, block long, keys binary, {binary}")
    known = table.filter(F.col("part") % TURNS == turn.start).select("part", F.lit(None).cast("long").alias("block"), "keys", *names)
    return asked.unionByName(known).groupBy("part").applyInArrow(answer, f"block long, part int, {binary}")


def _score_blocks(blocks: DataFrame, model: Tables, keep: list[str]) -> DataFrame:
    """``score`` of the documents of ``_blocks`` with models over every word."""
    totals = model.totals

    def found(name: str, columns: list[str], table: DataFrame, names: list[str], of) -> DataFrame:
        return _in_turns(lambda turn: _looked_up(blocks.select("block", *columns), table, model.parts, names, of, turn), model.parts, name)

    bigrams = found("lm-bigrams-found", ["words", "ids"], model.bigrams, ["n", "t"], lambda words, ids: _block_bigrams(words, ids)[3])
    words = found("lm-words-found", ["words"], model.words, ["n", "t", "k", "kt"], _keys)
    cells = max(totals["words"], 1) + 1

    def losses(n: np.ndarray, one: np.ndarray, total: np.ndarray, kinds: np.ndarray, t: str) -> np.ndarray:
        every, different = totals[f"n{t}"], totals[f"words{t}"]
        p1 = (one + different / cells) / (every + different) if every else np.full(len(one), 1 / cells)
        return -np.log(np.where(total > 0, (n + kinds * p1) / np.maximum(total + kinds, 1), p1))

    def entropy(own: pa.Table, found: pa.Table) -> pa.Table:
        parts, of = found["part"].to_numpy(), found["words"].to_numpy()

        def counts(word: bool, *names: str) -> list[np.ndarray]:
            at = np.flatnonzero(of == word)
            at = at[np.argsort(parts[at])]  # keys are sorted, and parts are ranges of them
            return [np.concatenate([_unpack(found[c][int(i)].as_py()) for i in at]) for c in names]

        before, after, number, _ = _block_bigrams(own["words"][0].as_py(), own["ids"][0].as_py())
        (n, t), (wn, wt, k, kt) = counts(False, "n", "t"), counts(True, "n", "t", "k", "kt")
        lt = losses(t[number], wt[after], wt[before], kt[before], "_t")
        lb = losses(n[number], wn[after], wn[before], k[before], "")
        sizes = _unpack(own["sizes"][0].as_py())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        t, b = (np.bincount(doc, x, len(sizes)) / sizes for x in (lt, lb))
        rows = own["docs"].combine_chunks().flatten()
        return pa.Table.from_arrays([*rows.flatten(), pa.array(sizes), pa.array(t), pa.array(b), pa.array(t - b)], names=names)

    measures = ["n_tokens", "ce_target", "ce_background", "ce_difference"]
    names = [*keep, *measures]
    schema = StructType([*blocks.schema["docs"].dataType.elementType.fields, StructField("n_tokens", LongType()), *[StructField(c, DoubleType()) for c in measures[1:]]])
    answers = bigrams.withColumns({"k": F.lit(None).cast("binary"), "kt": F.lit(None).cast("binary"), "words": F.lit(False)}) \
        .unionByName(words.withColumn("words", F.lit(True)))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(entropy, schema)


def _flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``__target``: chosen by ``labels.quality``."""
    good = labels.filter(F.col("quality").cast("int") == 1).select(F.col("doc_id").alias("__id")).distinct()
    # a shuffle join at every size: the labels grow with the corpus
    return docs.join(good.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left").withColumn("__target", F.col("__id").isNotNull()).drop("__id")


def fit(docs: DataFrame, labels: DataFrame, size: int | None = VOCABULARY) -> Tables | tuple[list[str], np.ndarray, np.ndarray]:
    """The models over every word; with a ``size`` the vocabulary and the losses under the target and the background model."""
    flagged = _flagged(docs.select("doc_id", "text"), labels)
    if size is None:
        return _tables(_blocks(flagged, ["doc_id"]))
    words = vocabulary(docs, size)
    n = counts(flagged, words, "__target")
    return words, losses(n[0]), losses(n[1])


def score(docs: DataFrame, model: Tables | tuple[list[str], np.ndarray, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, else all) with n_tokens, ce_target, ce_background and ce_difference."""
    if isinstance(model, Tables):
        keep = keep or docs.columns
        return _score_blocks(_blocks(docs, keep), model, keep)
    words, target, background = model
    C.workers(docs.sparkSession)
    edge, size = len(words) + 1, len(words) + 2
    shared = docs.sparkSession.sparkContext.broadcast(({w.encode(): i + 1 for i, w in enumerate(words)}, target.ravel(), background.ravel()))

    @F.arrow_udf("struct<n:bigint,t:double,b:double>")
    def entropy(texts: pa.Array) -> pa.Array:
        C.worker_cache("language models", dict)  # drops what another operator kept
        number, t, b = shared.value
        n, ct, cb = [], [], []
        for text in C.texts(texts):
            ids = _numbered(text, number, edge)
            cells = ids[:-1] * size + ids[1:]
            n.append(len(cells))
            ct.append(float(t[cells].mean(dtype=np.float64)))
            cb.append(float(b[cells].mean(dtype=np.float64)))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ct, pa.float64()), pa.array(cb, pa.float64())],
                                          ["n", "t", "b"])

    out = docs.withColumn("_e", entropy.asNondeterministic()(F.col("text").cast("string")))
    return out.select(*(keep or docs.columns), F.col("_e.n").alias("n_tokens"), F.col("_e.t").alias("ce_target"), F.col("_e.b").alias("ce_background"),
                      (F.col("_e.t") - F.col("_e.b")).alias("ce_difference"))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; fit and score share the blocks (``fit`` and ``score`` in one)."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = _blocks(_flagged(docs, C.table(spark, sf_dir, "labels")), ["doc_id"])
    return _score_blocks(blocks, _tables(blocks), ["doc_id"])
