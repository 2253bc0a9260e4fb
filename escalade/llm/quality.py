"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 12).

A whole text becomes ``len(STATISTICS)`` numbers: its size, shares of kinds of characters and
words, word and line lengths, and how much of its words, word pairs and lines is repeated. Boosted trees
of one depth are grown on those numbers level by level: values are cut into at most
``BINS`` bins, gradients and curvatures are summed by (node, statistic, bin), and each
node splits where the logistic loss falls most. All trees are flattened into three arrays
(statistic and threshold by node, value by leaf), and a batch of documents walks all of them at
once, one array step a level.

Scale: the trees are grown on the driver from a bounded sample of labelled rows (at most
``SAMPLE`` rows a class, of each its statistics only: some 30 numbers); the classes' shares
come from all labelled rows. Scoring is one map-side pass over all texts with a broadcast of
``TREES`` x 2^(DEPTH + 1) numbers; no text is shuffled, and statistics are array operations over
the bytes of a batch.

Defined results: null or empty texts have statistics of zero and a score like any other;
rows without a label or doc_id are scored but not learned from; repeated label rows count
once, and a document labelled both ways counts as of low quality; of repeated documents one
is learned from; without labels of both classes every score is the smoothed share of label 1;
an empty table gives no rows; extra columns are kept (``score`` replaces columns of the names
it adds).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import common as C

# Bound of the training sample: labelled rows a class, in the order of a hash of the id.
SAMPLE = 10_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 120, 4, 64, 0.1, 5.0, 20.0
THRESHOLD = 0.7
BATCH_BYTES = 4 << 20

# Kinds of bytes, by their first character in this list: blanks, line ends, capitals, small letters, digits,
# full stops, commas and the like, marks of emphasis, other signs; all others are of letters beyond ASCII.
_KINDS = ("blank", "line", "upper", "lower", "digit", "stop", "comma", "mark", "sign", "other")
_KIND = np.full(256, _KINDS.index("other"), np.uint8)
_KIND[:128] = _KINDS.index("sign")
for _kind, _chars in (("blank", " \t\r\v\f"), ("line", "\n"), ("upper", C.UPPER), ("lower", C.LOWER), ("digit", "0123456789"),
                      ("stop", "."), ("comma", ",;:'\"()-"), ("mark", "!?")):
    _KIND[[ord(c) for c in _chars]] = _KINDS.index(_kind)

STATISTICS = (
    "bytes", "words", *(f"share_{k}" for k in _KINDS), "stops_a_word", "commas_a_word", "marks_a_word", "signs_a_word",
    "word_length", "word_length_deviation", "longest_word", "capitalised", "all_capitals", "ends_in_sign", "ends_in_mark",
    "only_letters", "short_words", "distinct_words", "top_word", "distinct_pairs", "top_pair", "words_a_line", "distinct_lines",
    "lines_with_stop",
)

# random numbers for hashing bytes by their place in a word or line
_RNG = np.random.default_rng(12)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _repeated(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's items: the share of distinct ones and that of the most frequent one."""
    total = np.bincount(doc, minlength=n)
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    size, of = np.diff(np.append(at, len(d))), d[at]
    most = np.zeros(n)
    np.maximum.at(most, of, size)
    return np.bincount(of, minlength=n) / np.maximum(total, 1), most / np.maximum(total, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of whole texts, one row each."""
    texts = column.cast(pa.string()).fill_null("").cast(pa.binary())
    n = len(texts)
    if not pc.sum(pc.binary_length(texts)).as_py():
        return np.zeros((n, len(STATISTICS)))
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    size = np.diff(ends)
    doc = np.repeat(np.arange(n), size)
    kind = _KIND[data]
    counts = np.bincount(doc * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1).astype(np.float64)
    blank = kind <= 1

    # words: runs of anything but blanks, within a document
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    full = size > 0
    before[ends[:-1][full]] = True
    after[ends[1:][full] - 1] = True
    first, last = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after)
    of, length = doc[first], (last - first + 1).astype(np.float64)
    words = np.bincount(of, minlength=n).astype(np.float64)
    per_word = np.maximum(words, 1)

    def share(flag):
        return np.bincount(of[flag], minlength=n) / per_word

    def running(flag):
        return np.concatenate([[0], np.cumsum(flag)])

    upper, lower, letters = running(kind == 2), running(kind == 3), running((kind == 2) | (kind == 3) | (kind == 9))
    capitals = upper[last + 1] - upper[first]
    place = np.arange(len(data))
    in_word = place - np.maximum.accumulate(np.where(before, place, 0))
    starts_line = np.zeros(len(data), bool)
    starts_line[1:] = kind[:-1] == 1
    starts_line[ends[:-1][full]] = True
    in_line = place - np.maximum.accumulate(np.where(starts_line, place, 0))
    byte = _BYTE[data]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * _PLACE[in_word & 4095])])
        word = C.mix64(sums[last + 1] - sums[first])
        pair = C.mix64(word[:-1] * np.uint64(3) + word[1:])
        # lines, without their line ends
        line = np.flatnonzero(starts_line)
        line_end = np.append(line[1:], len(data))
        line_end = line_end - (kind[line_end - 1] == 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * _PLACE[in_line & 4095])])
        line_key = C.mix64(sums[line_end] - sums[line])
    line_of, in_text = doc[line], line_end > line
    lines = np.bincount(line_of[in_text], minlength=n).astype(np.float64)
    stopped = in_text & np.isin(kind[line_end - 1], (5, 7))
    mean = np.bincount(of, length, n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(of, length * length, n) / per_word - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    same = of[:-1] == of[1:]
    return np.column_stack([
        np.log1p(size), np.log1p(words), counts / np.maximum(size, 1)[:, None],
        *(counts[:, k] / per_word for k in (5, 6, 7, 8)), mean, spread, longest,
        share(kind[first] == 2), share((capitals >= 2) & (lower[last + 1] == lower[first])), share(kind[last] == 8), share(kind[last] == 7),
        share(letters[last + 1] - letters[first] == length), share(length <= 3),
        *_repeated(of, word, n), *_repeated(of[:-1][same], pair[same], n), words / np.maximum(lines, 1),
        _repeated(line_of[in_text], line_key[in_text], n)[0], np.bincount(line_of[stopped], minlength=n) / np.maximum(lines, 1),
    ])


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2^depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of statistics: all rows walk all trees, a level at a time."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(inner.bit_length()):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.value[tree, at - inner].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, base: float, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
          rate: float = RATE, l2: float = L2, least: float = LEAST) -> Forest:
    """Trees for the logistic loss of ``y`` under ``weight``; ``base`` is the log odds to start from."""
    n, f = x.shape
    # bins of about equally many rows: a value's bin is the number of edges below it
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    width = bins + 1
    cell = binned + np.arange(f) * width
    usable = np.arange(width)[None, :] < np.array([len(e) for e in edges])[:, None]  # a split after bin b needs edge b
    inner = (1 << depth) - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value, margin = np.zeros((trees, inner + 1)), np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        g, h = (p - y) * weight, p * (1 - p) * weight
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 1 << level
            where = (node[:, None] * (f * width) + cell).ravel()
            sums = [np.bincount(where, np.repeat(v, f), nodes * f * width).reshape(nodes, f, width) for v in (g, h, weight)]
            left = [np.cumsum(s, 2) for s in sums]
            all_ = [s[:, :1, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + l2) + (all_[0] - left[0]) ** 2 / (all_[1] - left[1] + l2) - all_[0] ** 2 / (all_[1] + l2)
            fine = usable[None] & (left[2] >= least) & (all_[2] - left[2] >= least)
            gain = np.where(fine, gain, -1).reshape(nodes, -1)
            best = gain.argmax(1)
            split = gain[np.arange(nodes), best] > 1e-9
            own_f, own_b = best // width, best % width
            at = nodes - 1 + np.arange(nodes)
            feature[t, at] = np.where(split, own_f, 0)
            threshold[t, at] = [edges[j][b] if s else np.inf for j, b, s in zip(own_f, own_b, split)]
            own_b = np.where(split, own_b, width)
            node = 2 * node + (binned[np.arange(n), np.where(split, own_f, 0)[node]] > own_b[node])
        value[t] = -rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + l2)
        margin = margin + value[t][node]
    return Forest(feature, threshold, value, base)


def held_out(doc_id) -> F.Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4: never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Statistics and labels of at most ``per_class`` documents a class, and the number of labelled documents of each class."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
             .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
             .groupBy("_id").agg(F.min("_label").alias("_label")))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)

    @F.arrow_udf("array<double>")
    def numbers(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))

    _batches(docs.sparkSession)
    # the sample has at most 2 x per_class short rows, which bounds the broadcast
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "_label", numbers("text").alias("x"))
    # a repeated document must not lift the bound: one row an id
    rows = joined.groupBy("_id", "_label").agg(F.min("x").alias("x")).toArrow().sort_by("_id")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, len(STATISTICS))
    return x, rows["_label"].to_numpy().astype(np.float64), sizes


def _batches(spark) -> None:
    C.workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Forest:
    """Trees grown on ``labels.quality``."""
    x, y, sizes = sample(docs, labels, per_class)
    share = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + sizes.get(1, 0) + 1)
    base = float(np.log(share / (1 - share)))
    n = {c: int((y == c).sum()) for c in (0, 1)}
    if not n[0] or not n[1]:
        return Forest(np.zeros((0, (1 << DEPTH) - 1), np.int64), np.zeros((0, (1 << DEPTH) - 1)), np.zeros((0, 1 << DEPTH)), base)
    # a class counts by its share of all labelled documents, a row by one on average
    weight = np.where(y == 1, share / n[1], (1 - share) / n[0]) * len(y)
    return boost(x, y, weight, base)


def score(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good quality likelier) and ``predicted``."""
    _batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES x 2^(DEPTH + 1) numbers

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.probability(statistics(texts)), pa.float64())

    out = docs.withColumn("score", probability.asNondeterministic()(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@C.keeps_columns
def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, columns unchanged."""
    return score(docs, fit(docs, labels), threshold).filter(F.col("predicted") == 1)


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
