"""URL filter by the ratio of two character language models (operator 3).

Host/path rules label the urls they fit. From those urls two variable-order
Markov models over a small url alphabet are counted, one for accepted and one for
rejected urls: the probability of a character after a context of up to three
characters is interpolated with that after the next shorter context
(Witten-Bell), down to the uniform distribution. A url without a rule is judged by
the mean log-likelihood difference per character against a threshold calibrated
on rule-labelled urls that were not counted.

Scale: parsing and rules are JVM expressions; counting and scoring are map-side
passes. A model has at most SYMBOLS^4 = 2,560,000 cells whatever the
input, so counts are summed per task, then by one small shuffle, and the ratio
table (10 MB) is broadcast within that proven bound.

Defined results: null url, or one without ``://``: empty host and path, no rule;
its (possibly empty) characters are still scored. With no labelled url on one
side there is no model and the verdict is "allow" with difference 0. Ties in
calibration go to the threshold nearest to 0. Repeated rows are counted and
judged row by row; an empty table gives no rows; columns named like those added are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import common as C

# (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

ORDER = 3
# start, a-z, any digit, ten marks, any other byte, end
MARKS = "/.-_?=&#%:"
SYMBOLS = 1 + 26 + 1 + len(MARKS) + 1 + 1
_START, _DIGIT, _OTHER, _END = 0, 27, SYMBOLS - 2, SYMBOLS - 1

# One in HOLD_OUT of the labelled urls calibrates and isn't counted.
HOLD_OUT = 5
# Calibration histogram: differences in steps of 1/STEP, clipped to +-LIMIT.
STEP, LIMIT = 200, 20


def _symbols() -> np.ndarray:
    code = np.full(256, _OTHER, np.int64)
    for i, c in enumerate(C.LOWER):
        code[ord(c)] = code[ord(c.upper())] = 1 + i
    code[[ord(c) for c in "0123456789"]] = _DIGIT
    for i, c in enumerate(MARKS):
        code[ord(c)] = _DIGIT + 1 + i
    return code


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all (context, character) windows of the urls, joined, and each
    url's number of windows (its bytes and the end)."""
    raw = [u.encode("utf-8", "replace") for u in urls]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.full(int(size.sum()) + len(raw) * (ORDER + 1), _START, np.int64)
    ends = np.cumsum(size + ORDER + 1)
    body = np.ones(len(flat), bool)
    for j in range(ORDER):
        body[ends - size - 1 - ORDER + j] = False
    own = body.copy()
    body[ends - 1] = False
    flat[body] = _symbols()[np.frombuffer(b"".join(raw), np.uint8)]
    flat[ends - 1] = _END
    code = np.zeros(len(flat), np.int64)
    for j in range(ORDER, -1, -1):
        code = code * SYMBOLS + (np.concatenate((np.zeros(j, np.int64), flat[:len(flat) - j])) if j else flat)
    return code[own], size + 1


def model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of each character after each context, from the counts of
    all windows of ORDER + 1 characters."""
    full = counts.reshape([SYMBOLS] * (ORDER + 1)).astype(np.float64)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for k in range(ORDER + 1):
        n = full.sum(axis=tuple(range(ORDER - k))) if k < ORDER else full
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        shorter = np.broadcast_to(p, n.shape)
        p = np.where(total > 0, (n + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return np.log(p)


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path`` of the url."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.expr(f"substring(cast(`{url}` as string), instr(cast(`{url}` as string), '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return pages.withColumns({"host": C.folded(host), "path": F.regexp_extract(after, "^[^?#]*", 0)})


def _rule_column(rules, value) -> F.Column:
    """``value(rule)`` of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _differences(spark, table: np.ndarray):
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("double")
    def difference(urls: pa.Array) -> pa.Array:
        texts = [u or "" for u in urls.to_pylist()]
        if not texts:
            return pa.array([], pa.float64())
        code, size = _grams(texts)
        each = shared.value[code].astype(np.float64)
        return pa.array(np.add.reduceat(each, np.cumsum(size) - size) / size)

    return difference.asNondeterministic()


def fit(labelled: DataFrame, url: str = "url", label: str = "label") -> tuple[np.ndarray, float]:
    """Ratio table and threshold from urls labelled "allow" or "block"."""
    spark = labelled.sparkSession
    C.workers(spark, 10_000)
    rows = labelled.select(F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.col(label).alias("label")) \
        .filter(F.col("label").isin("allow", "block"))
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(HOLD_OUT)) == 0
    cells = SYMBOLS ** (ORDER + 1)

    def count(batches: Iterator) -> Iterator:
        totals = np.zeros(2 * cells, np.int64)
        for batch in batches:
            urls, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if urls:
                code, size = _grams(urls)
                side = np.repeat(np.array([x == "allow" for x in labels], np.int64), size)
                at, n = np.unique(code + side * cells, return_counts=True)
                totals[at] += n
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["cell", "n"])

    sums = rows.filter(~held).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * cells, np.int64)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    if not counts[:cells].any() or not counts[cells:].any():
        return np.zeros(cells, np.float32), 0.0
    table = (model(counts[cells:]) - model(counts[:cells])).astype(np.float32).ravel()

    step = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("d"))) * STEP).cast("int")
    bins = rows.filter(held).select("label", _differences(spark, table)(F.col("url")).alias("d")) \
        .groupBy(step.alias("bin"), "label").count().collect()  # at most 2 x (2 LIMIT STEP + 1) rows
    return table, threshold([(r["bin"], r["label"], r["count"]) for r in bins])


def threshold(bins: list[tuple]) -> float:
    """The difference from which urls are accepted that gives the best balanced
    accuracy on (bin, label, count); of ties the middle one nearest to 0."""
    sides = {x: sum(n for _, label, n in bins if label == x) for x in ("allow", "block")}
    if not all(sides.values()):
        return 0.0
    allow, block = np.zeros(2 * LIMIT * STEP + 2), np.zeros(2 * LIMIT * STEP + 2)
    for b, label, n in bins:
        (allow if label == "allow" else block)[b + LIMIT * STEP] += n
    kept = np.cumsum(allow[::-1])[::-1] / sides["allow"]           # allowed at or above the bin
    dropped = (np.cumsum(block) - block) / sides["block"]          # blocked below it
    quality = kept + dropped
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    cut = (best - LIMIT * STEP - 0.5) / STEP
    return float(cut[np.argmin(np.abs(cut))])


def judge(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``difference``: the mean
    log-likelihood difference per character, above 0 towards accepted."""
    spark = pages.sparkSession
    C.workers(spark, 10_000)
    seen = parsed(pages, url).withColumns({
        "rule": _rule_column(rules, lambda r: r[1] + r[2]), "_rule_verdict": _rule_column(rules, lambda r: r[0])})
    table, cut = fit(seen.select(url, F.col("_rule_verdict").alias("label")), url)
    scored = seen.withColumn("difference", _differences(spark, table)(F.col(url).cast("string")))
    own = F.when(F.col("difference") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", F.coalesce(F.col("_rule_verdict"), own)).drop("_rule_verdict")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("difference", 6).alias("difference"))
