"""Periodic run detection (operator 13): scale-tiled, with boundary Z-functions.

A run is a stretch of consecutive words with smallest period q and at least
``max(MIN_WORDS, 3 q)`` words that no neighbouring word extends. Of a run all but its first
q words are copies; ``collapsed`` drops them.

Method. Periods are taken by octaves [s, 2s) from s = 8 on; those below 8 are one more octave, also
with s = 8. A run with a period of that octave has at least 2s words equal to the word one period on, so
it holds a boundary (a multiple of s) with s of them next to it. For every boundary and
every period of the octave the Z-values ahead and behind (the common extensions
of the boundary and of the position one period on, up to s words) bound a fragment
[lo, hi) of such words. Z-values are read off names of windows of 2^k words: half an
octave of equal words next to the boundary is one comparison of whole rows of names, and
only what passes is descended, 2^k by 2^k. A fragment whose period is a multiple of
a smaller one (its first q words are a power) is dropped: the smaller octave has it.
Documents are exploded into overlapping tiles: the octaves up to ``SMALL`` share
tiles of ``TILE`` words, every larger octave has tiles of 12 s words. Tiles are solved
independently, fragments shuffled by (document, period) and stitched there where they touch.

Scale: a text of up to ``TILE`` words is one tile and is solved in the task that reads it;
tiles of longer texts are dealt over all tasks. Words become numbers of their tile, so only
those and narrow fragments are shuffled, and the texts of documents with fragments.
Work is a few operations a word and octave, whatever the words (a text of one word included),
and memory is a few dozen bytes for each word of a tile. Window names have 64 bits; two
different windows share one with a chance of 2^-64.

Defined results: a null or empty text (or one of blanks only) has no words and no runs;
repeated rows each get their row; a null doc_id is kept; extra columns don't matter (only
doc_id and text are read); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from escalade.llm import common as C

MIN_WORDS = 24
# Words of a tile for the octaves up to SMALL; both are powers of two.
TILE, SMALL = 16_384, 1_024
# Words a worker solves at once, and bytes of an Arrow batch.
CHUNK, BATCH_BYTES = 200_000, 4 << 20

Rewrite = Callable[[int | None, int], np.ndarray | None]
FRAGMENTS = "array<struct<period:int,lo:int,hi:int>>"
_FRAGMENT = pa.struct([("period", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def words(text: bytes | None) -> list[bytes]:
    """The words of a text: runs of anything but blanks and the controls U+0009 to U+000D."""
    return text.split() if text else []


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Positions that the words of a document are read from: in one document of ten, all
    words from one on repeat with one period."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _words_of(doc_id: int | None, text: bytes | None, rewrite: Rewrite | None) -> list[bytes]:
    own = words(text)
    at = rewrite(doc_id, len(own)) if rewrite else None
    return own if at is None else [own[i] for i in at.tolist()]


def _numbers(own: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers (of this text)."""
    number: dict = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, own), np.int32, len(own))


@lru_cache(4)
def _least_factor(n: int) -> np.ndarray:
    """The least prime factor of every number below n."""
    least = np.arange(n, dtype=np.int64)
    for p in range(2, int(n ** 0.5) + 1):
        if least[p] == p:
            own = least[p * p::p]
            own[own == np.arange(p * p, n, p)] = p
    return least


def _whole(names: list[np.ndarray], at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from ``at`` on are no power of a shorter word sequence."""
    least, rest, ok = _least_factor(1 << int(q.max()).bit_length()), q.copy(), np.ones(len(q), bool)
    while len(go := np.flatnonzero(ok & (rest > 1))):
        r = least[rest[go]]
        rest[go] //= r
        step = q[go] // r
        size = q[go] - step  # these words must equal those one step on
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level):
            mine = level == k
            i, d, tail = at[go[mine]], step[mine], size[mine] - (1 << int(k))
            row = names[k]
            ok[go[mine]] = (row[i] != row[i + d]) | (row[i + tail] != row[i + d + tail])
    return ok


def fragments(codes: np.ndarray, starts: np.ndarray, first: int = 8, last: int | None = None) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, lo, hi) of the words [lo, hi) that equal those one period on, next to boundaries.

    ``codes`` are the word numbers of several texts, longest first; ``starts`` has their
    places and the end. With ``last`` the octaves from ``first`` to it are solved for
    all texts (tiles), else for each text the octaves of which it can hold a run.
    """
    sizes, total = np.diff(starts), int(starts[-1])
    top = last or 8
    while last is None and len(sizes) and 3 * 2 * top <= sizes[0]:
        top *= 2
    text = np.repeat(np.arange(len(sizes)), sizes)
    # a number of its own for each word of each text and for the places after the end
    start = np.concatenate([codes.astype(np.uint64) * np.uint64(len(sizes)) + text.astype(np.uint64),
                            np.arange(4 * top, dtype=np.uint64) + np.uint64(1 << 62)])
    names, found = [C.mix64(start)], []
    s = 8
    while s <= top:
        # texts come longest first: those that can hold a run of this octave are the first ones
        n = total if last else int(starts[np.searchsorted(-sizes, -max(MIN_WORDS, 3 * s), "right")])
        if not n:
            break
        while len(names) <= s.bit_length() - 1:
            half, of = 1 << (len(names) - 1), names[-1][:n + 4 * top]
            after = np.zeros_like(of)
            after[:-half] = of[half:]
            names.append(C.mix64(of * np.uint64(0x9E3779B97F4A7C15) + after))
        if s == first == 8:
            found.append(_octave(names, s, n, below=True))
        if s >= first:
            found.append(_octave(names, s, n))
        s *= 2
    empty = np.zeros(0, np.int64)
    q, lo, hi = (np.concatenate([f[i] for f in found] or [empty]) for i in range(3))
    own = np.searchsorted(starts, lo, "right") - 1 if len(lo) else empty
    order = np.lexsort((lo, q, own))
    own, q, lo, hi = own[order], q[order], lo[order], hi[order]
    if not len(lo):
        return own, q, lo, hi
    # fragments of neighbouring boundaries touch: one for each stretch
    new = np.ones(len(lo), bool)
    new[1:] = (own[1:] != own[:-1]) | (q[1:] != q[:-1]) | (lo[1:] > hi[:-1])
    at = np.flatnonzero(new)
    base = starts[own[at]]
    return own[at], q[at], lo[at] - base, np.maximum.reduceat(hi, at) - base


def _octave(names: list[np.ndarray], s: int, n: int, below: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of the periods [s, 2s), or ``below`` s, at the boundaries under ``n``."""
    top, nb, half = s.bit_length() - 1, -(-n // s), s // 2
    row = names[top - 1]
    if below:
        periods = np.arange(1, s)
        ahead = row[:nb * s].reshape(nb, s)
        equal = ahead[:, 1:] == ahead[:, :1]
        behind = row[s - half:s - half + nb * s].reshape(nb, s)  # row j: half before boundary j + 1
        equal[1:] |= behind[:nb - 1, 1:] == behind[:nb - 1, :1]
    else:
        periods = np.arange(s, 2 * s)
        ahead = row[:(nb + 1) * s].reshape(nb + 1, s)
        equal = ahead[1:] == ahead[:-1, :1]
        behind = row[s - half:s - half + nb * s].reshape(nb, s)
        equal[1:] |= behind[1:] == behind[:-1, :1]
    j, col = np.nonzero(equal)
    b, q = j * s, periods[col]
    # Z-values: the common extension of b and b + q, ahead and behind, up to s
    z = np.where(names[top][b] == names[top][b + q], s, 0)
    open_ = z < s
    back = np.zeros(len(b), np.int64)
    full = b >= s
    full[full] = names[top][b[full] - s] == names[top][b[full] + q[full] - s]
    back[full] = s
    for k in range(top - 1, -1, -1):
        step = 1 << k
        z += np.where(open_ & (names[k][b + z] == names[k][b + q + z]), step, 0)
        i = b - back - step
        ok = ~full & (i >= 0)
        i = np.where(ok, i, 0)
        back += np.where(ok & (names[k][i] == names[k][i + q]), step, 0)
    keep = np.flatnonzero(z + back >= s)
    b, q, lo, hi = b[keep], q[keep], (b - back)[keep], (b + z)[keep]
    if len(q):
        keep = _whole(names, lo, q)
        q, lo, hi = q[keep], lo[keep], hi[keep]
    return q, lo, hi


def _is_run(q, lo, hi):
    return (hi - lo) + q >= np.maximum(MIN_WORDS, 3 * q)


def _solve_whole(docs: DataFrame, rewrite: Rewrite | None) -> DataFrame:
    """(doc_id, n_words, whole, text, fragments) of texts that are one tile: ``whole`` is the SHA-256
    of the words joined by blanks; the text is kept where there are fragments."""

    def solve(batches):
        def made(ids, texts, own):
            order = sorted(range(len(own)), key=lambda i: -len(own[i]))
            starts = np.cumsum([0, *(len(own[i]) for i in order)])
            codes = np.concatenate([_numbers(own[i]) for i in order])
            of, q, lo, hi = fragments(codes, starts)
            run = _is_run(q, lo, hi)  # a whole text has whole fragments
            found: dict = defaultdict(list)
            for t, *x in zip(of[run].tolist(), q[run].tolist(), lo[run].tolist(), hi[run].tolist()):
                found[order[t]].append(dict(zip(("period", "lo", "hi"), x)))
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in own]),
                pa.array([texts[i].decode("utf-8", "replace") if i in found else None for i in range(len(own))], pa.string()),
                pa.array([found.get(i, []) for i in range(len(own))], pa.list_(_FRAGMENT)),
            ], ["doc_id", "n_words", "whole", "text", "fragments"])

        for batch in batches:
            ids, texts, own, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), C.texts(batch.column(1))):
                ids.append(doc_id)
                texts.append(text)
                own.append(_words_of(doc_id, text, rewrite))
                size += len(own[-1])
                if size >= CHUNK:
                    yield made(ids, texts, own)
                    ids, texts, own, size = [], [], [], 0
            if ids:
                yield made(ids, texts, own)

    return docs.mapInArrow(solve, f"doc_id long, n_words long, whole string, text string, fragments {FRAGMENTS}")


def tiles(n: int, tile: int = TILE, small: int = SMALL):
    """(first octave, last octave, start, end) of the tiles of ``n`` words."""
    first, last, core = 8, small, tile
    while first == 8 or 3 * first <= n:
        for at in range(0, n, core):
            yield first, last, max(0, at - last), min(n, at + core + 3 * last)
        first, last, core = 2 * last, 2 * last, 16 * last


def _solve_tiled(docs: DataFrame, rewrite: Rewrite | None, tile: int, small: int) -> DataFrame:
    """(row, period, lo, hi) of texts of many tiles, which are dealt over all tasks."""

    def explode(batches):
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), C.texts(batch.column(2))):
                codes = _numbers(_words_of(doc_id, text, rewrite))
                for first, last, start, end in tiles(len(codes), tile, small):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), *(pa.array([x], pa.int32()) for x in (first, last, start)),
                         pa.array([codes[start:end]], pa.list_(pa.int32()))], ["row", "first", "last", "start", "codes"])

    def solve(batches):
        for batch in batches:
            for row, first, last, start, codes in zip(*(batch.column(i) for i in range(5))):
                own = codes.values.to_numpy(zero_copy_only=False)
                _, q, lo, hi = fragments(own, np.array([0, len(own)]), first.as_py(), last.as_py())
                start = start.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), row.as_py()), pa.int64()), *(pa.array(x, pa.int32()) for x in (q, lo + start, hi + start))],
                    ["row", "period", "lo", "hi"])

    dealt = docs.mapInArrow(explode, "row long, first int, last int, start int, codes array<int>")
    return dealt.repartition("row", "first", "start").mapInArrow(solve, "row long, period int, lo int, hi int")


def stitched(found: DataFrame) -> DataFrame:
    """Runs (row, start, length, period) from fragments (row, period, lo, hi) that touch or overlap."""
    by = Window.partitionBy("row", "period").orderBy("lo", "hi")
    ended = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum((F.coalesce(ended, F.lit(-1)) < F.col("lo")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    whole = found.withColumn("part", part).groupBy("row", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("period")
    return whole.select("row", "start", length.alias("length"), "period") \
        .filter(F.col("length") >= F.greatest(F.lit(MIN_WORDS), 3 * F.col("period")))


def collapsed(docs: DataFrame, rewrite: Rewrite | None = None, tile: int = TILE, small: int = SMALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (by start, then
    period), text (the words kept, joined by a blank; null where all are) and the
    SHA-256 of the words kept.

    ``rewrite`` maps (doc_id, words) to the positions that the words are read from.
    """
    spark = docs.sparkSession
    C.workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long_text = F.coalesce(F.length("text") > 2 * tile, F.lit(False))  # so many characters hold a tile of words at most
    # rows are numbered once, in written tables, so that every later job reads the same numbers
    numbered = F.monotonically_increasing_id().alias("row")
    short = C.spill(_solve_whole(texts.filter(~long_text), rewrite).select(numbered, "*"), "periodic-short")
    long_ = C.spill(texts.filter(long_text).select((-1 - F.monotonically_increasing_id()).alias("row"), "*"), "periodic-long")

    found = short.filter(F.size("fragments") > 0).select("row", F.inline("fragments")) \
        .unionByName(_solve_tiled(long_, rewrite, tile, small))
    runs = stitched(found).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    kept = short.filter(F.size("fragments") > 0).select("row", "doc_id", "text").unionByName(long_)

    def drop(batches):
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch.column(0).to_pylist(), C.texts(batch.column(1)), batch.column(2).to_pylist()):
                all_words = _words_of(doc_id, text, rewrite)
                gone = np.zeros(len(all_words), bool)
                for r in own or ():
                    gone[r["start"] + r["period"]:r["start"] + r["length"]] = True
                joined = b" ".join([w for w, g in zip(all_words, gone.tolist()) if not g])
                out.append((doc_id, len(all_words), own or [], joined.decode("utf-8", "replace") if own else None,
                            hashlib.sha256(joined).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                                             ["doc_id", "n_words", "runs", "text", "collapsed_sha256"])

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "period", "length")])), pa.string(), pa.string()]
    listed = "array<struct<start:int,period:int,length:int>>"
    schema = f"doc_id long, n_words long, runs {listed}, text string, collapsed_sha256 string"
    cut = kept.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(drop, schema)
    same = short.filter(F.size("fragments") == 0).select(
        "doc_id", "n_words", F.expr(f"cast(array() as {listed})").alias("runs"), F.lit(None).cast("string").alias("text"),
        F.col("whole").alias("collapsed_sha256"))
    return cut.unionByName(same)


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent and digests, from ``collapsed``."""
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    # exponents are compared as fractions: a.length / a.period < b.length / b.period
    best = F.expr("""array_sort(runs, (a, b) -> CASE
        WHEN cast(a.length as long) * b.period > cast(b.length as long) * a.period THEN -1
        WHEN cast(a.length as long) * b.period < cast(b.length as long) * a.period THEN 1
        WHEN a.start <> b.start THEN if(a.start < b.start, -1, 1)
        WHEN a.period <> b.period THEN if(a.period < b.period, -1, 1) ELSE 0 END)""")
    top = found.withColumn("best", F.try_element_at(best, F.lit(1)))
    own = [F.col(f"best.{x}").cast("long").alias(x) for x in ("start", "length", "period")]
    milli = F.expr("cast(1000L * best.length div best.period as long)").alias("exponent_milli")
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *own, milli,
                      F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of every document and the digest of its text without their repetitions."""
    return digest(collapsed(C.table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted))
