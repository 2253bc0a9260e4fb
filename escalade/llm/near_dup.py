"""Near-duplicate classes by ProbMinHash, banding and exact verification (operator 4).

Documents are weighted sets of word shingles (``SHINGLE`` words; the weight is the
count; a shorter text is one shingle). ProbMinHash draws, for every shingle, the arrivals of a
Poisson process whose rate is its weight and deals them to ``REGISTERS`` registers; a register
keeps the shingle that arrives first, so two documents agree in a register with their
probability Jaccard similarity. A shingle's process stops as soon as it is later
than every register (early termination). ``BANDS`` bands of registers give candidate
buckets: at similarity 0.8 a pair shares one with probability 0.99995. Candidates are verified by
their exact probability Jaccard similarity from whole texts.

Classes are the connected components of the pairs with similarity >= ``THRESHOLD``:
1. documents of equal words are one class; only one stands in for them from here;
2. in each bucket all members are compared with its lead (a star, not all pairs);
3. buckets whose members are now in several components compare those outside the
   largest component with every member of another component, so that no candidate pair that
   could join two classes is left out. Their documents first get a sketch of ``SKETCH`` further
   registers, two bits each: the join keeps a pair, in the first bucket that it shares, where the
   sketches' distance is within ``SLACK`` standard deviations of that expected at the threshold
   (a pair at the threshold passes with probability 0.99997).

Scale: texts are read for the signatures once and for candidate pairs; a bucket or class
holding a third of all documents costs rows in proportion to its size, its
joins are split by AQE, and counts are combined map-side. Components are found by contraction
on the cluster, each round a written table.

Defined results: texts without words (null, empty, punctuation) are classes of their own;
repeated rows and ties are copies of each other, the first by (doc_id, row) stays; null doc_ids
come first; an empty table gives no rows; extra columns are kept by ``dedup``. Documents are written
with their row number once and every step reads that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import common as C

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
SKETCH, SLACK = 768, 4.0
# Shingles that are hashed together in a worker.
CHUNK = 150_000
CACHE_WORDS = 150_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word -> 64-bit hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h



def shingles(docs: list[list[bytes]], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of word lists: document numbers, 64-bit hashes and counts,
    ordered by (document, hash)."""
    size = np.array([len(d) for d in docs], np.int64)
    hashes = C.worker_cache("word hashes", _Hashes)
    word = np.fromiter((h for d in docs for h in map(hashes.__getitem__, d)), np.uint64, int(size.sum()))
    first = np.cumsum(size) - size
    count = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
    doc = np.repeat(np.arange(len(docs)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    length = np.minimum(size, n)[doc]
    h = length.astype(np.uint64)
    for j in range(n):
        inside = length > j
        at = np.where(inside, start + j, 0)
        h = np.where(inside, C.mix64(h * _GOLDEN + word[at]) if len(word) else h, h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: the (n_docs, m) items that arrive first (0 where a document is empty)."""
    first = np.full(n_docs * m, np.inf)
    who = np.zeros(n_docs * m, np.uint64)
    weight, time, k = weight.astype(np.float64), np.zeros(len(item)), 0
    while len(item):
        k += 1
        draw = C.mix64(item + np.uint64(k * int(_GOLDEN) % 2 ** 64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weight
        at = doc * m + (C.mix64(draw ^ _GOLDEN) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = item[won]
        latest = first.reshape(n_docs, m).max(1)
        going = time < latest[doc]
        doc, item, weight, time = doc[going], item[going], weight[going], time[going]
    return who.reshape(n_docs, m)


def bands(who: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of registers: (documents, BANDS)."""
    h = np.zeros((len(who), BANDS), np.uint64)
    for j in range(ROWS):
        h = C.mix64(h * _GOLDEN + who[:, j::ROWS][:, :BANDS])
    return h.view(np.int64)


def similarity(x: tuple, y: tuple) -> float:
    """Exact probability Jaccard similarity of two (hashes ascending, counts).

    The sum over common items i of 1 / sum over j of max(x_j / x_i, y_j / y_i); the inner
    sum depends on i through the ratio of its weights only.
    """
    common, a, b = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    xc, yc = x[1][a].astype(np.float64), y[1][b].astype(np.float64)
    only_x, only_y = x[1].sum() - xc.sum(), y[1].sum() - yc.sum()
    ratio = yc / xc
    total = 0.0
    for r in np.unique(ratio):
        own = ratio == r
        total += xc[own].sum() / (np.maximum(xc, yc / r).sum() + only_x + only_y / r)
    return float(total)


def sketches(who: np.ndarray) -> np.ndarray:
    """Two bits of each register, packed into 64-bit numbers: (documents, 2 SKETCH / 64)."""
    two = C.mix64(who ^ _GOLDEN)
    bits = np.stack((two & np.uint64(1), two >> np.uint64(1) & np.uint64(1)), 2).astype(np.uint8)
    return np.packbits(bits.reshape(len(who), -1), axis=1).view(np.int64)


def distance_limit(threshold: float) -> int:
    """Sketch distance up to which a pair may have the similarity ``threshold``."""
    differ = SKETCH * (1 - threshold)  # registers; two random bits differ in 1 +- 1/sqrt(2)
    return int(differ + SLACK * (differ * threshold + differ / 2) ** 0.5)


def _in_runs(found: list, work) -> list:
    """``work`` on runs of word lists of about CHUNK words, one list at least."""
    out, a = [], 0
    while a < len(found):
        b, size = a + 1, len(found[a])
        while b < len(found) and size + len(found[b]) <= CHUNK:
            size += len(found[b])
            b += 1
        out.append(work(found[a:b]))
        a = b
    return out


def _lists(rows: list, width: int) -> pa.Array:
    """Rows of a fixed width as Arrow lists."""
    flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))


def sketched(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, sketch) of the ``texts`` (row, text) in ``rows`` (row)."""
    def sketch(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [C.words(t) for t in C.texts(batch.column(1))]
            own = _in_runs(found, lambda run: sketches(signatures(*shingles(run), len(run), SKETCH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(own, 2 * SKETCH // 64)], names=["row", "sketch"])

    return texts.join(rows, "row", "left_semi").mapInArrow(sketch, "row long, sketch array<long>")


def signed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, bands) of every document (__row, doc_id, text); null bands where it has no words."""
    C.workers(docs.sparkSession)

    def sign(batches: Iterator) -> Iterator:
        for batch in batches:
            rows, ids = batch.column(0), batch.column(1)
            found = [C.words(t) for t in C.texts(batch.column(2))]
            keys = _in_runs(found, lambda run: bands(signatures(*shingles(run), len(run))))
            digests = [xxhash.xxh128_digest(b" ".join(w)) if w else None for w in found]
            yield pa.RecordBatch.from_arrays([rows, ids, pa.array(digests, pa.binary()), _lists(keys, BANDS)],
                                             names=["row", "doc_id", "digest", "bands"])

    return docs.select(F.col("__row").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .mapInArrow(sign, "row long, doc_id long, digest binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of rows whose ``texts`` (row, text) have at least the similarity ``threshold``."""
    @F.arrow_udf("double")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        held: dict[bytes, tuple] = {}

        def weighted(text):
            if text not in held:
                if len(held) > 200:
                    held.clear()
                held[text] = shingles([C.words(text)])[1:]
            return held[text]

        return pa.array([similarity(weighted(x), weighted(y)) for x, y in zip(C.texts(left), C.texts(right))], pa.float64())

    one = pairs.join(texts.withColumnsRenamed({"row": "a", "text": "ta"}), "a")
    both = one.join(texts.withColumnsRenamed({"row": "b", "text": "tb"}), "b")
    return both.select("a", "b", compare.asNondeterministic()("ta", "tb").alias("similarity")) \
        .filter(F.col("similarity") >= threshold).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the connected components of ``links`` (a, b).

    Contraction: every node joins the first of itself and its neighbours, in an order
    that changes each round, and links between joined nodes go on to the next
    round until none is left.
    """
    spark, rounds = links.sparkSession, []
    links = C.spill(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while not links.isEmpty():
        # flip bits of the numbers, so that no chain of rising numbers stays one
        mask = int(C.mix64(np.uint64([len(rounds) + 1]))[0] >> np.uint64(2)) if rounds else 0
        key = lambda c: F.col(c).bitwiseXOR(F.lit(mask))  # noqa: B023, E731
        both = links.select(F.col("a").alias("node"), key("b").alias("k")).unionByName(links.select(F.col("b").alias("node"), key("a").alias("k")))
        to = both.groupBy("node").agg(F.min("k").alias("k")).select("node", F.least("k", key("node")).bitwiseXOR(F.lit(mask)).alias("to"))
        to = C.spill(to, "components")
        rounds.append(to)
        a = to.withColumnsRenamed({"node": "a", "to": "ta"})
        b = to.withColumnsRenamed({"node": "b", "to": "tb"})
        moved = links.join(a, "a").join(b, "b").filter("ta <> tb")
        links = C.spill(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not rounds:
        return spark.createDataFrame([], "node long, component long")
    last = rounds[-1].withColumnRenamed("to", "component")
    for to in reversed(rounds[:-1]):
        end = last.withColumnsRenamed({"node": "to", "component": "_c"})
        last = to.join(end, "to", "left").select("node", F.coalesce("_c", "to").alias("component"))
    return C.spill(last, "components")


def links(stand_ins: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the documents in ``stand_ins`` (row, bands) that are linked; ``docs`` (__row, text)."""
    members = stand_ins.select("row", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = C.spill(members.join(buckets, ["band", "key"]), "shared-buckets")
    # whole texts of the documents that share a bucket: the one time that texts are shuffled
    some = shared.select("row").distinct().hint("shuffle_hash")
    texts = C.spill(docs.select(F.col("__row").alias("row"), F.col("text").cast("string").alias("text"))
                    .join(some, "row", "left_semi"), "candidate-texts")
    # the lead of a bucket is its member with the largest buckets: the nearest to the middle of its copies
    weight = shared.groupBy("row").agg(F.sum("n").alias("weight"))
    leads = shared.join(weight, "row").groupBy("band", "key").agg(F.max(F.struct("weight", (-F.col("row")).alias("row"))).alias("top")) \
        .select("band", "key", (-F.col("top.row")).alias("lead"))
    star = shared.join(leads, ["band", "key"]).filter("row <> lead") \
        .select(F.least("lead", "row").alias("a"), F.greatest("lead", "row").alias("b")).distinct()
    star = C.spill(star, "pairs")
    found = C.spill(verified(star, texts, threshold), "verified")
    joined = components(found)

    # buckets whose members are still in several components
    part = joined.withColumnsRenamed({"node": "row", "component": "part"})
    placed = C.spill(shared.select("band", "key", "row").join(part, "row", "left").withColumn("part", F.coalesce("part", "row")), "placed")
    sizes = placed.groupBy("band", "key", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("band", "key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")) \
        .filter("parts > 1").drop("parts")
    open_rows = C.spill(placed.join(largest, ["band", "key"]), "open-buckets")
    own = sketched(texts, open_rows.select("row").distinct()).join(stand_ins, "row")
    members = C.spill(open_rows.join(own, "row"), "open-members")
    outside = members.filter("part <> main").select("band", "key", *[F.col(c).alias(f"x_{c}") for c in ("row", "part", "bands", "sketch")])
    others = members.select("band", "key", *[F.col(c).alias(f"y_{c}") for c in ("row", "part", "bands", "sketch")])
    far = " + ".join(f"bit_count(x_sketch[{i}] ^ y_sketch[{i}])" for i in range(2 * SKETCH // 64))
    earlier = " or ".join(f"(band > {i} and x_bands[{i}] = y_bands[{i}])" for i in range(BANDS - 1))
    rest = outside.join(others, ["band", "key"]) \
        .filter(f"x_part <> y_part and {far} <= {distance_limit(threshold)} and not ({earlier})") \
        .select(F.least("x_row", "y_row").alias("a"), F.greatest("x_row", "y_row").alias("b")).distinct()
    rest = C.spill(rest.join(star, ["a", "b"], "left_anti"), "pairs")
    more = verified(rest, texts, threshold)
    return components(found.unionByName(more))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (row, doc_id, class_id, class_size, stays).

    ``class_id`` is the least doc_id of the class; one document of each class stays.
    """
    return _classes(C.keyed(docs.select("doc_id", "text")), threshold)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``classes`` of a written table with the row numbers ``__row``."""
    own = C.spill(signed(docs), "signatures")
    copies = own.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("row").alias("lead"))
    copies = C.spill(copies, "copies")
    stand_ins = C.spill(own.select("row", "bands").join(copies.select(F.col("lead").alias("row")), "row"), "stand-ins")
    joined = links(stand_ins, docs, threshold).withColumnsRenamed({"node": "lead", "component": "_c"})
    lead = copies.join(joined, "lead", "left").select("digest", F.coalesce("_c", "lead").alias("_class"))
    member = own.select("row", "doc_id", "digest").join(lead, "digest", "left") \
        .select("row", "doc_id", F.coalesce("_class", "row").alias("_class"))
    member = C.spill(member, "members")
    heads = member.groupBy("_class").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct("doc_id", "row")).alias("_first"))
    return member.join(heads, "_class").select(
        "row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("_first")["row"]).alias("stays"))


@C.keeps_columns
def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, columns unchanged."""
    keyed = C.keyed(docs)
    stays = _classes(keyed, threshold).filter("stays").select(F.col("row").alias("__row"))
    return keyed.join(stays.hint("shuffle_hash"), "__row", "left_semi").select(*docs.columns)


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")
