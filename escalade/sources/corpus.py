"""Utterance corpora: nested JSON files keyed by intent, and turn tables.

Corpus document: ``{"<Intent>": [{"data": [{"text": ..., "entity": ...}, ...]}, ...]}``
-- the top-level key is the intent. The JSON reader needs a fixed struct
root, so files are read whole (``binaryFile``) or as JSON lines (``text``),
decoded, and parsed with ``from_json`` into a map keyed by intent.

A large file is read by many tasks (``corpus_scan_split``): the key ``"data":`` ends a record
of the ``text`` source, which deals byte ranges of a file and finds record ends across
them. Those bytes are always that key, as a quote inside a JSON string is escaped and a string
value is not followed by a colon, so every record but a file's first starts with one
utterance's tokens and ends where the next utterance starts.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from escalade.functions.text import py_strip
from escalade.schemas import INTENT_LABELS
from escalade.session import materialize
from escalade.sources.results import list_names

CORPUS_SCHEMA = "map<string,array<struct<data:array<struct<text:string,entity:string>>>>>"
# File name of an intent in each split.
SPLIT_FILES = {"train": "train_{intent}_full.json", "validate": "validate_{intent}.json"}


def flatten_utterance(data: Column) -> Column:
    """Concatenate the token texts with no separator, then strip; no data -> ''.

    A token without ``text`` fails the row (``array_join`` would skip it)."""
    joined = py_strip(F.coalesce(F.array_join(F.transform(data, lambda t: t["text"]), ""), F.lit("")))
    return F.when(F.coalesce(F.exists(data, lambda t: t["text"].isNull()), F.lit(False)),
                  F.raise_error(F.lit("utterance token without text"))).otherwise(joined)


def parse_corpus(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """(file_name, utt_index, intent, text) from rows (file_name, intent, content), each
    holding one corpus JSON document.

    A document that is no valid JSON of this form, or has no key ``intent``, fails the job.
    """
    m = docs.select("file_name", "intent", F.from_json(F.col(content_col), CORPUS_SCHEMA, {"mode": "FAILFAST"}).alias("m"))
    utts = F.when(F.map_contains_key(F.coalesce("m", F.create_map().cast(CORPUS_SCHEMA)), F.col("intent")), F.col("m")[F.col("intent")]) \
        .otherwise(F.raise_error(F.concat(F.lit("no utterances of "), F.col("intent"), F.lit(" in "), F.col("file_name"))))
    u = m.select("file_name", "intent", F.posexplode(utts).alias("utt_index", "u"))
    return u.select("file_name", "utt_index", "intent", flatten_utterance(F.col("u.data")).alias("text"))


def wanted_files(intents: Sequence[str]) -> dict[str, tuple[str, str]]:
    """{file name: (split, intent)}."""
    return {pattern.format(intent=i): (split, i) for split, pattern in SPLIT_FILES.items() for i in intents}


def _found_files(path: str, names: Sequence[str], wanted: dict) -> list[str]:
    for name in wanted:
        if name not in names:
            warnings.warn(f"no corpus file {name} under {path}")
    found = [n for n in wanted if n in names]
    if not found:
        raise FileNotFoundError(f"no corpus files under {path}")
    return found


def corpus_scan(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", json_lines: bool = False,
                intents: Sequence[str] = tuple(INTENT_LABELS)) -> DataFrame:
    """(split, file_name, utt_index, intent, text) of both splits under ``path``.

    Whole files (default; latin-1 bytes decoded): ``SPLIT_FILES`` names one file per
    split and intent, other files are ignored, a missing one gives a warning, none at
    all is an error. ``json_lines``: the layout of ``write_corpus_lines``
    (``split=.../intent=...`` folders), for corpora beyond one file per intent.
    """
    names = list_names(spark, path)
    if json_lines:
        if not any(n.startswith("split=") for n in names):
            raise FileNotFoundError(f"no corpus files under {path}")
        r = spark.read.schema("value string, split string, intent string").text(path)
        r = r.select("split", F.col("_metadata.file_name").alias("file_name"), "intent", F.col("value").alias("content"))
    else:
        wanted = wanted_files(intents)
        found = _found_files(path, names, wanted)
        r = spark.read.format("binaryFile").load([os.path.join(path, n) for n in found])
        at = F.regexp_extract("path", r"([^/]+)$", 1)
        split, intent = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name in found:
            split = F.when(at == name, F.lit(wanted[name][0])).otherwise(split)
            intent = F.when(at == name, F.lit(wanted[name][1])).otherwise(intent)
        r = r.select(split.alias("split"), at.alias("file_name"), intent.alias("intent"), F.decode("content", encoding).alias("content"))
    parts = r.withColumn("file_name", F.concat_ws("/", "split", "file_name"))
    out = parse_corpus(parts)
    return out.select(F.substring_index("file_name", "/", 1).alias("split"), F.substring_index("file_name", "/", -1).alias("file_name"),
                      "utt_index", "intent", "text")


# A file's first record (key; utterances without data; then the first one with data, or the end),
# and any other record (tokens; utterances without data; then the next one, or the end).
_FIRST = r'(?s)^\s*\{\s*("(?:[^"\\]|\\.)*")\s*:\s*\[((?:\s*\{\s*\}\s*,?)*)\s*(\{|\]\s*\})\s*$'
_OTHER = r'(?s)^(\s*\[.*\])\s*\}((?:\s*,\s*\{\s*\})*)\s*(,\s*\{|\]\s*\})\s*$'
_TOKENS = "array<struct<text:string,entity:string>>"


def corpus_scan_split(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                      intents: Sequence[str] = tuple(INTENT_LABELS)) -> DataFrame:
    """The rows of ``corpus_scan`` for files of any size: every file is read by as many tasks as it has splits.

    A name of ``SPLIT_FILES`` may be a file or a folder of parts (``write_corpus_files``), each
    with the intent as its only key. A file that isn't such a document, or is cut off, fails the job;
    one that has blanks before the colon of ``data`` is left to ``corpus_scan``.
    """
    wanted = wanted_files(intents)
    found = _found_files(path, list_names(spark, path), wanted)
    # names and their intents are a few fixed ones
    names = F.create_map(*[F.lit(x) for n in found for x in (n, "/".join(wanted[n]))])
    at = F.expr("_metadata.file_path")
    own = F.coalesce(names[F.element_at(F.split(at, "/"), -1)], names[F.element_at(F.split(at, "/"), -2)])
    records = spark.read.option("lineSep", '"data":').text([os.path.join(path, n) for n in found]) \
        .select(F.decode(F.col("value").cast("binary"), encoding).alias("r"), at.alias("file"),
                F.expr("_metadata.file_block_start").alias("block"), F.split(own, "/").alias("of"))
    first = F.col("r").rlike(r"^\s*\{")

    def bad(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(what), F.lit(" in "), F.col("file")))

    fits = F.when(F.col("r").rlike(r'"data"\s+:'), bad("blanks before a colon")) \
        .when(first, F.when(~F.col("r").rlike(_FIRST), bad("no corpus document"))
              .when(F.get_json_object(F.concat(F.lit('{"k":'), F.regexp_extract("r", _FIRST, 1), F.lit("}")), "$.k") != F.col("of")[1],
                    bad("another intent than that of its name"))) \
        .when(~F.col("r").rlike(_OTHER), bad("no whole utterance"))
    part = lambda k: F.when(first, F.regexp_extract("r", _FIRST, k)).otherwise(F.regexp_extract("r", _OTHER, k))
    records = records.where(fits.isNull()).select(
        "file", "block", "of", first.alias("first"), part(3).startswith("]").alias("last"),
        F.from_json(F.regexp_extract("r", _OTHER, 1), _TOKENS, {"mode": "FAILFAST"}).alias("tokens"),
        F.size(F.regexp_extract_all(part(2), F.lit(r"\{"), F.lit(0))).alias("empty"))
    # one row an utterance, and one without text for a file's start
    own_text = F.when(F.col("first"), F.lit(None).cast("string")).otherwise(flatten_utterance(F.col("tokens")))
    texts = F.concat(F.array(F.struct(own_text.alias("text"), F.col("first").alias("first"), F.col("last").alias("last"))),
                     F.array_repeat(F.struct(F.lit("").alias("text"), F.lit(False).alias("first"), F.lit(False).alias("last")), F.col("empty")))
    rows = records.select("file", "block", "of", F.explode(texts).alias("u")).select(
        "file", "block", "of", "u.*", F.monotonically_increasing_id().alias("place"))
    rows = materialize(rows, "corpus")  # places follow the splits of this scan

    # an utterance's number: those in the file's blocks before, and its place in its block
    blocks = rows.groupBy("file", "block").agg(
        F.min("place").alias("least"), F.count_if(~F.col("first")).alias("n"), F.count_if("first").alias("starts"), F.count_if("last").alias("ends"))
    of_file = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = (F.sum("starts").over(of_file) == 1) & (F.sum("ends").over(of_file) == 1)
    blocks = blocks.select("file", "block", F.when(whole, before - F.col("least") - F.col("starts"))
                           .otherwise(bad("an incomplete document")).alias("shift"))
    out = rows.join(blocks, ["file", "block"]).where(~F.col("first") & F.col("shift").isNotNull())
    name = F.element_at(F.split("file", "/"), -1)
    return out.select(F.col("of")[0].alias("split"), name.alias("file_name"),
                      (F.col("place") + F.col("shift")).cast("int").alias("utt_index"), F.col("of")[1].alias("intent"), "text")


def write_corpus_files(rows: DataFrame, split: str, intent: str, text_col: str, path: str, mode: str = "overwrite") -> None:
    """Write texts as the corpus file of one split and intent: a folder of that name, each part a
    document of its own (``{"<intent>": [...]}``) written by one task."""
    import json

    begin = "{" + json.dumps(intent) + ": ["

    def lines(batches):
        began = False
        for batch in batches:
            out = [] if began or not batch.num_rows else [begin]
            for text in batch.column(0).to_pylist():
                out.append(("," if began else "") + text)
                began = True
            if out:
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        if began:
            yield pa.RecordBatch.from_pydict({"value": pa.array(["]}"], pa.string())})

    doc = F.to_json(F.struct(F.array(F.struct(F.col(text_col).alias("text"), F.lit(None).cast("string").alias("entity"))).alias("data")),
                    {"ignoreNullFields": "false"})
    rows.select(doc).mapInArrow(lines, "value string").write.mode(mode).text(os.path.join(path, SPLIT_FILES[split].format(intent=intent)))


def flatten_turns(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One text per ``key``: the turns' texts in ``order`` with no separator, stripped.
    Each group holds one conversation's turns."""
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
                               .alias("s"))
    return g.select(key, py_strip(F.array_join(F.transform("s", lambda x: x["t"]), "")).alias("text"))


def write_corpus_lines(turns: DataFrame, intent_col: str, text_col: str, path: str, split_col: str = "split",
                       mode: str = "overwrite") -> None:
    """Write rows as JSON-lines corpus documents (one utterance each) in
    ``split=.../intent=...`` folders, which ``corpus_scan(json_lines=True)`` reads."""
    doc = F.to_json(F.create_map(F.col(intent_col), F.array(F.struct(
        F.array(F.struct(F.col(text_col).alias("text"), F.lit(None).cast("string").alias("entity"))).alias("data")))))
    out = turns.select(F.col(split_col).alias("split"), F.col(intent_col).alias("intent"), doc.alias("value"))
    out.write.mode(mode).partitionBy("split", "intent").text(path)
