"""Fixed-length encoding with subword pieces: longest match over a piece table, or the
ids of a tokenizer file.

A piece table has (piece, piece_id, starts): pieces that start a word and pieces that go
on in one. A word becomes the longest piece that starts it, then the longest piece that goes on
from there, and so forth; a word that can't be covered is one unknown id. Ids are framed
into sequences of one length: start and end ids, padding, attention mask, labels.

Every distinct word of an Arrow batch is matched once, in a trie held by the worker; a batch is
mapped in place, so nothing is shuffled. The pieces are broadcast after a check of their size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from escalade.functions.text import analyzer_tokens

# Bounds of a piece table that every worker holds.
MAX_PIECES, MAX_PIECE_BYTES = 1_000_000, 32 << 20


@dataclass(frozen=True)
class Frame:
    """Ids around and beside a text's own ids; ``start`` and ``end`` may be left out."""

    pad: int = 0
    unknown: int = 1
    start: int | None = 2
    end: int | None = 3

    def room(self, max_len: int) -> int:
        """A text's own ids in a sequence of ``max_len``."""
        room = max_len - (self.start is not None) - (self.end is not None)
        if room <= 0:
            raise ValueError(f"a sequence of {max_len} has no room for a text's ids")
        return room


FRAME = Frame()
# Fixed value: pieces of a table made by ``pieces_from_words`` have ids from here on.
FIRST_PIECE = 4


def pieces_from_words(words: DataFrame, col: str = "word") -> DataFrame:
    """(piece, piece_id, starts) of given words: every word and every one of their
    letters, as a start and as a continuation; ids in the order (starts first, piece)."""
    known = words.select(F.col(col).alias("piece")).where(F.col("piece") != "").distinct()
    letters = known.select(F.explode(F.array_distinct(F.split("piece", ""))).alias("piece")).where(F.col("piece") != "")
    both = known.union(letters).distinct().select("piece", F.explode(F.array(F.lit(True), F.lit(False))).alias("starts"))
    # a vocabulary is bounded (see ``checked_pieces``), and so is this window
    w = Window.orderBy(F.col("starts").desc(), "piece")
    return both.select("piece", (F.row_number().over(w) - 1 + FIRST_PIECE).cast("long").alias("piece_id"), "starts")


def checked_pieces(pieces: DataFrame) -> tuple[dict, dict]:
    """(starting, continuing) pieces as {piece: id}, once they are known to fit."""
    size = pieces.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("b")).first()
    if size["n"] > MAX_PIECES or size["b"] > MAX_PIECE_BYTES:
        raise ValueError(f"a table of {size['n']} pieces and {size['b']} bytes is no vocabulary "
                         f"(at most {MAX_PIECES} pieces, {MAX_PIECE_BYTES} bytes)")
    out: tuple[dict, dict] = ({}, {})
    for r in pieces.select("piece", "piece_id", "starts").collect():
        own = out[0 if r["starts"] else 1]
        if own.setdefault(r["piece"], r["piece_id"]) != r["piece_id"]:
            raise ValueError(f"piece {r['piece']!r} has two ids")
    return out


def _trie(pieces: dict[str, int]) -> dict:
    """Nested {letter: node}; a node's id is under the empty string."""
    root: dict = {}
    for piece, number in pieces.items():
        node = root
        for letter in piece:
            node = node.setdefault(letter, {})
        node[""] = number
    root.pop("", None)
    return root


def longest_match(word: str, starts: dict, continues: dict, unknown: int) -> list[int]:
    """Ids of a word: longest piece first, from left to right, over two tries."""
    ids, at, node = [], 0, starts
    while at < len(word):
        found, here = None, at
        while here < len(word) and (node := node.get(word[here])) is not None:
            here += 1
            if "" in node:
                found, end = node[""], here
        if found is None:
            return [unknown]
        ids.append(found)
        at, node = end, continues
    return ids


def _ids_of(tokens: pa.Array, match) -> pa.Array:
    """A batch of word lists as lists of ids: distinct words are matched once."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    words = tokens.flatten().dictionary_encode()
    own = [match(w) if w is not None else [] for w in words.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in own], np.int64)
    flat = np.concatenate([np.asarray(x, np.int64) for x in own]) if own else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = words.indices.fill_null(0).to_numpy(zero_copy_only=False)
    n = sizes[at] if len(at) else np.zeros(0, np.int64)
    n = np.where(words.is_valid().to_numpy(zero_copy_only=False), n, 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    # ids of every occurrence, one after the other
    ids = flat[np.repeat(begin[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else flat
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))


def piece_ids(spark: SparkSession, pieces: DataFrame, unknown: int = FRAME.unknown):
    """Column -> Column: an array of words to the array of their piece ids."""
    shared = spark.sparkContext.broadcast(checked_pieces(pieces))
    held: dict = {}

    @F.arrow_udf("array<bigint>")
    def to_ids(tokens: pa.Array) -> pa.Array:
        if not held:  # once a task, not once a batch
            held["tries"] = tuple(_trie(p) for p in shared.value)
        starts, continues = held["tries"]
        return _ids_of(tokens, lambda w: longest_match(w, starts, continues, unknown))

    return to_ids


def file_ids(spark: SparkSession, path: str):
    """Column -> Column: a text to its ids by a tokenizer file (JSON), without special ids.

    The file is read on the driver's side by Spark, so ``path`` can be in any store."""
    shared = spark.sparkContext.broadcast(spark.read.text(path, wholetext=True).first()[0])
    held: dict = {}

    @F.arrow_udf("array<bigint>")
    def to_ids(texts: pa.Array) -> pa.Array:
        if not held:
            from tokenizers import Tokenizer

            held["it"] = Tokenizer.from_str(shared.value)
            held["it"].encode_special_tokens = True  # their strings in a text are ordinary text
            held["it"].no_padding()
            held["it"].no_truncation()
        found = held["it"].encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        return pa.array([e.ids for e in found], pa.list_(pa.int64()))

    return to_ids


def framed(df: DataFrame, keys: list[str], ids: str, max_len: int, frame: Frame = FRAME, truncate: bool = False) -> DataFrame:
    """``keys`` + (window, input_ids, attention_mask): sequences of ``max_len`` ids.

    A text longer than one sequence goes on in further windows, so no id is lost;
    with ``truncate`` only its first sequence is kept (and no ``window`` column). A text
    without ids gives one sequence of start, end and padding.
    """
    room = frame.room(max_len)
    own = F.coalesce(F.col(ids), F.expr("cast(array() as array<bigint>)"))
    rows = df.select(*keys, own.alias("__ids"))
    if truncate:
        rows = rows.withColumn("window", F.lit(0))
    else:
        last = F.greatest(F.ceil(F.size("__ids") / room).cast("int") - 1, F.lit(0))
        rows = rows.withColumn("window", F.explode(F.sequence(F.lit(0), last)))

    def one(value: int | None) -> list[Column]:
        return [] if value is None else [F.array(F.lit(value).cast("long"))]

    def times(value: int, n: Column) -> Column:
        return F.array_repeat(F.lit(value).cast("long"), n)

    seq = F.concat(*one(frame.start), F.slice("__ids", F.col("window") * room + 1, room), *one(frame.end))
    rows = rows.select(*keys, "window", seq.alias("__seq"))
    size, gap = F.size("__seq"), F.lit(max_len) - F.size("__seq")
    return rows.select(*keys, *([] if truncate else ["window"]), F.concat("__seq", times(frame.pad, gap)).alias("input_ids"),
                       F.concat(times(1, size), times(0, gap)).alias("attention_mask"))


def subword_ids(df: DataFrame, id_col: str, pieces: DataFrame, max_len: int, text_col: str = "text", terms_col: str = "terms",
                label_col: str | None = None, frame: Frame = FRAME, truncate: bool = False) -> DataFrame:
    """(id, window, input_ids, attention_mask[, labels]) of texts by longest match over ``pieces``.

    Words are those of the analyzer (``terms_col`` when present). With ``truncate`` a text's
    first sequence is enough, and no word beyond it is matched (a word gives an id at least).
    """
    words = F.col(terms_col) if terms_col in df.columns else analyzer_tokens(F.col(text_col))
    if truncate:
        words = F.slice(words, 1, frame.room(max_len))
    to_ids = piece_ids(df.sparkSession, pieces, frame.unknown)
    extra = [F.col(label_col).alias("labels")] if label_col else []
    return framed(df.select(id_col, *extra, to_ids(words).alias("__own")), [id_col, *(["labels"] if extra else [])],
                  "__own", max_len, frame, truncate)


def tokenizer_ids(df: DataFrame, id_col: str, path: str, max_len: int, text_col: str = "text", label_col: str | None = None,
                  frame: Frame = FRAME, truncate: bool = False) -> DataFrame:
    """(id, window, input_ids, attention_mask[, labels]) of whole texts by the tokenizer file ``path``."""
    to_ids = file_ids(df.sparkSession, path)
    extra = [F.col(label_col).alias("labels")] if label_col else []
    return framed(df.select(id_col, *extra, to_ids(F.col(text_col)).alias("__own")), [id_col, *(["labels"] if extra else [])],
                  "__own", max_len, frame, truncate)
