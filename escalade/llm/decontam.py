"""Benchmark decontamination by a broadcast set of n-gram hashes (operator 10).

The benchmark's windows (``n`` consecutive words of an item; a shorter item is
one window) are hashed into a set that every task holds; documents stream through
it: a window whose hash is in the set is compared word by word before it counts.

Scale: one map-side pass over the documents, no shuffle of texts. The set is
broadcast only up to ``MAX_WORDS`` benchmark words (counted first); the windows of
a larger benchmark and of the documents meet in a shuffle join instead.

Defined results: null or empty texts have no words and are clean; an empty
benchmark hits nothing; a repeated item counts as often as its item_id differs;
null item_ids name no item but their windows hit; items without words have no window;
repeated documents are judged row by row; extra columns are kept by ``remove_spans``
and ignored by ``scan``.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escalade.llm import common as C

NGRAM = 10
# Benchmark words per broadcast set: about 100 bytes each in a worker.
MAX_WORDS = 1_000_000


class Windows:
    """The windows of benchmark items, by length: hash -> (words, item numbers)."""

    def __init__(self, items: list[tuple], n: int = NGRAM):
        self.ids: dict[bytes, int] = {}
        self.items: list = []
        self.by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in C.words(text)]
            if not w:
                continue
            k = min(n, len(w))
            self.items.append(item_id)
            for i in range(len(w) - k + 1):
                self.by_length[k][tuple(w[i:i + k])].add(len(self.items) - 1)
        self.sorted = {}
        for k, windows in self.by_length.items():
            keys = list(windows)
            h = self.hashes(np.array(keys, np.uint64), k)
            self.sorted[k] = np.unique(h)
        self.by_length = {k: dict(v) for k, v in self.by_length.items()}

    @staticmethod
    def hashes(rows, k: int):
        """Polynomial hash of each row of k word ids (modulo 2^64)."""
        h = np.zeros(len(rows), np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j]
        return h

    def find(self, found: list[bytes]) -> tuple:
        """(mask of hit words, item numbers) of a document's words."""
        get = self.ids.get
        w = np.fromiter(map(get, found, repeat(0)), np.uint64, len(found))
        hit, items = np.zeros(len(w), bool), set()
        for k, known in self.sorted.items():
            if len(w) < k:
                continue
            # only starts whose k words are all benchmark words
            ok = np.cumsum(np.concatenate(([0], w != 0)))
            starts = np.flatnonzero(ok[k:] - ok[:-k] == k)
            if not len(starts):
                continue
            h = np.zeros(len(starts), np.uint64)
            for j in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + w[starts + j]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for s in starts[known[at] == h].tolist():
                owners = self.by_length[k].get(tuple(w[s:s + k].tolist()))  # verified
                if owners:
                    hit[s:s + k] = True
                    items |= owners
        return hit, items


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                     T.StructField("items", T.ArrayType(T.StringType()))])


def _hits(spark, windows: Windows):
    """Arrow UDF: text -> (n_words, hit runs of word numbers [from, to), item ids).

    Marked as not deterministic so that a filter on its result does not run it twice.
    """
    shared = spark.sparkContext.broadcast(windows)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))),
                      ("items", pa.list_(pa.string()))])

    @F.arrow_udf(HITS)
    def find(texts: pa.Array) -> pa.Array:
        C.worker_cache("decontamination", dict)  # drops what another operator kept
        w, out = shared.value, []
        for text in C.texts(texts):
            found = C.words(text)
            hit, items = w.find(found)
            out.append({"n_words": len(found), "spans": runs_of(hit) if items else [],
                        "items": sorted({str(w.items[i]) for i in items if w.items[i] is not None})})
        return pa.array(out, kind)

    return find.asNondeterministic()


def runs_of(mask) -> list[list[int]]:
    """[from, to) of each run of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).reshape(-1, 2).tolist()


def _size(benchmark: DataFrame) -> int:
    """Words of all items."""
    n = F.size(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(C.WORD), 0))
    return benchmark.agg(F.sum(n)).first()[0] or 0


def _collected(benchmark: DataFrame, n: int) -> Windows:
    """The window set of a benchmark whose size has been checked."""
    return Windows([tuple(r) for r in benchmark.select("item_id", F.col("text").cast("string")).distinct().collect()], n)


def _words(col):
    return F.regexp_extract_all(C.folded(F.coalesce(col.cast("string"), F.lit(""))), F.lit(C.WORD), 0)


def _windows(frame: DataFrame, lengths) -> DataFrame:
    """One row per window of ``_w``: its length, start and the words joined by a blank."""
    def of(k):
        return F.when(F.size("_w") >= k, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("_w") - k + 1, F.lit(1))),
            lambda i: F.struct(F.lit(k).alias("k"), (i - 1).alias("at"), F.array_join(F.slice("_w", i, k), " ").alias("gram"))))
    each = F.flatten(F.array(*[F.coalesce(of(k), F.array().cast("array<struct<k:int,at:int,gram:string>>")) for k in lengths]))
    return frame.withColumn("_x", F.explode(each)).select(*[c for c in frame.columns if c != "_w"], "_x.*")


def _scan_joined(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """``scan`` for a benchmark beyond the broadcast bound: windows meet in a shuffle join."""
    keyed = C.keyed(docs)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("_w"))
    items = items.filter(F.size("_w") > 0).withColumn("_n", F.least(F.size("_w"), F.lit(n)))
    known = _windows(items, range(1, n + 1)).filter("k = _n").select("k", "gram", "item").distinct()
    lengths = sorted(r[0] for r in known.select("k").distinct().collect())  # at most n values
    mine = _windows(keyed.select("__row", _words(F.col("text")).alias("_w")), lengths or [n])
    met = mine.join(known, ["k", "gram"]).groupBy("__row", "at", "k").agg(F.collect_set("item").alias("items"))
    found = met.groupBy("__row").agg(
        F.array_sort(F.collect_set(F.array(F.col("at").cast("long"), (F.col("at") + F.col("k")).cast("long")))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.expr("cast(array() as array<array<bigint>>)")
    runs = F.aggregate("s", none, lambda a, x: F.when(
        (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1))[1], F.lit(-1)) >= x[0]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.array(
            F.try_element_at(a, F.lit(-1))[0], F.greatest(F.try_element_at(a, F.lit(-1))[1], x[1])))))
        .otherwise(F.concat(a, F.array(x))))
    found = found.select(F.col("__row").alias("__r"), runs.alias("spans"), F.col("items"))
    joined = keyed.join(found, F.col("__row") == F.col("__r"), "left")
    hits = F.struct(F.size(_words(F.col("text"))).cast("long").alias("n_words"), F.coalesce(found["spans"], none).alias("spans"),
                    F.coalesce(found["items"], F.expr("cast(array() as array<string>)")).alias("items"))
    return joined.select(*[keyed[c] for c in docs.columns], hits.alias("_hits"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with ``_hits``: (n_words, spans, items), the spans being runs
    [from, to) of hit words, and the items' ids as sorted strings."""
    if _size(benchmark) > max_words:
        return _scan_joined(docs, benchmark, n)
    C.workers(docs.sparkSession)
    find = _hits(docs.sparkSession, _collected(benchmark, n))
    return docs.withColumn("_hits", find(F.col("text").cast("string")))


def cut_words(text: str, runs) -> str:
    """The text without its words of the given runs: each goes from its first
    word's start to its last word's end."""
    at = [(m.start(), m.end()) for m in C.WORD_RE.finditer(text.translate(C.FOLD))]
    out, done = [], 0
    for a, b in runs:
        out.append(text[done:at[a][0]])
        done = at[b - 1][1]
    return "".join(out) + text[done:]


@C.keeps_columns
def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, max_words: int = MAX_WORDS) -> DataFrame:
    """Documents without their hit words; one that was hit and has no words left goes.

    Columns and their order are kept; ``n_chars``, if there, follows the new text.
    """
    columns, flagged = docs.columns, scan(docs, benchmark, n, max_words)

    @F.arrow_udf("string")
    def clean(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not own else cut_words(t, own)
                         for t, own in zip(texts.to_pylist(), runs.to_pylist())], pa.string())

    touched = F.size(F.col("_hits")["spans"]) > 0
    out = flagged.withColumn("text", F.when(
        touched, clean(F.when(touched, F.col("text")), F.col("_hits")["spans"])).otherwise(F.col("text")))
    out = out.filter(~touched | F.col("text").rlike(C.WORD))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and hit items of every document."""
    found = scan(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "benchmark"))
    hits = F.col("_hits")
    n_hit = F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select("doc_id", hits["n_words"].alias("n_words"), n_hit.alias("n_hit"),
                        F.size(hits["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(hits["items"], ",").cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


_SQL_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), "
              "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
OP10_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
known AS (
  SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (
    SELECT item, w, least({NGRAM}, len(w)) AS k, unnest(range(1, len(w) - least({NGRAM}, len(w)) + 2)) AS i
    FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
met AS (
  SELECT r, i, x.k, item FROM (
    SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (
      SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM known))) x
  JOIN known ON known.k = x.k AND known.gram = x.gram),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""
