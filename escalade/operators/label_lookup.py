"""Label extraction over a dictionary of any size.

``prompts.parse_label`` compares a text with each label in turn, which suits a few labels. Here
an Aho-Corasick automaton finds all labels in one walk over the text, whatever their number. A worker
builds it once from the dictionary. A dictionary is dealt by hash into parts of at most
``part_bytes`` bytes; each part is searched by itself, and what its labels found is added up: two
different labels in a text make it unknown, so a count up to two is all that is carried. One part, some
100,000 labels, costs one walk over the texts; the work beyond that is texts x parts.

Defined results, as in ``parse_label``: NULL text = 'unknown'; the stripped text equal to a label ignoring
case = that label (of several, the least); else the only label contained ignoring case; else 'unknown'.
Labels that differ in case only are two labels, an empty label is contained in every text; NULL and
repeated labels of the dictionary are ignored. An empty dictionary makes every text unknown.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.text import py_strip
from escalade.session import importable, materialize

# Bytes of the labels in one automaton: a node a character, some 100 bytes each.
PART_BYTES = 2_000_000
UNKNOWN = "unknown"

FOUND = "struct<exact:string,hit:string,n:int>"
_BUILT: dict = {}  # of a worker process: the automaton in use


def _automaton(key: str, entries: list[tuple[str, str, int]]):
    """({folded label: (label, how many)}, automaton over them)."""
    if key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        known = {low: (label, n) for low, label, n in entries}
        search = ahocorasick.Automaton()
        for low in known:
            if low:
                search.add_word(low, low)
        search.make_automaton()
        _BUILT[key] = (known, search)
    return _BUILT[key]


def find(text: str, known: dict, search) -> tuple[str | None, str | None, int]:
    """(label equal to the text, a label in it, number of labels in it up to 2) of a folded, stripped text."""
    exact = known[text][0] if text in known else None
    hits = {""} if "" in known else set()
    n = sum(known[low][1] for low in hits)
    if n < 2 and len(search):
        for _, low in search.iter(text):
            if low not in hits:
                hits.add(low)
                n += known[low][1]
                if n > 1:
                    break
    return exact, (known[min(hits)][0] if hits else None), min(n, 2)


def _search(entries, key: str):
    """A function of Arrow batches over one part of the dictionary (a broadcast variable)."""
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, automaton = _automaton(key, entries.value)
        for batch in batches:
            rows = [(None, None, 0) if t is None else find(t, known, automaton) for t in batch.to_pylist()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32()))],
                                             ["exact", "hit", "n"])

    search.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # or a filter on what was found would search again
    return F.arrow_udf(search, FOUND).asNondeterministic()


def _label(found: Column) -> Column:
    return F.coalesce(found["exact"], F.when(found["n"] == 1, found["hit"]), F.lit(UNKNOWN))


def parse_label_many(df: DataFrame, raw_col: str, dictionary: DataFrame, label_col: str, out: str = "label",
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` with ``out``: the label of ``dictionary`` that ``raw_col`` names, or 'unknown'."""
    spark = df.sparkSession
    importable(spark)
    labels = dictionary.select(F.col(label_col).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    labels = materialize(labels.groupBy(F.lower("label").alias("low")).agg(F.min("label").alias("label"), F.count(F.lit(1)).cast("int").alias("n")),
                         "labels")
    size = labels.agg(F.sum(F.octet_length("low") + F.octet_length("label"))).first()[0]
    if size is None:
        return df.withColumn(out, F.lit(UNKNOWN))
    parts = -(-size // part_bytes) or 1

    def part(k: int):
        mine = labels.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == k) if parts > 1 else labels
        return spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # some ``part_bytes`` bytes

    folded = F.lower(py_strip(F.col(raw_col)))
    if parts == 1:
        return df.withColumn("__found", _search(part(0), uuid.uuid4().hex)(folded)).withColumn(out, _label(F.col("__found"))).drop("__found")
    # one search a part, written before the next part is loaded; rows go by a written number
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "label-texts")
    found = None
    for k in range(parts):
        entries = part(k)
        one = rows.select("__row", _search(entries, uuid.uuid4().hex)(folded).alias("f")).select("__row", "f.*").where("n > 0")
        one = materialize(one, f"label-part-{k}")
        entries.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("__row").agg(F.struct(F.min("exact").alias("exact"), F.min("hit").alias("hit"), F.sum("n").alias("n")).alias("__found"))
    return rows.join(found, "__row", "left").withColumn(out, _label(F.col("__found"))).drop("__row", "__found")
