"""Deletion of repeated line runs by a suffix array over line ids (operator 6); DataFrame functions only.

A document is the sequence of its non-blank lines. A line goes if it lies in a run of
consecutive lines of at least ``MIN_WORDS`` words that has an earlier occurrence:
maximal repeated runs lose their later copies. Earlier is by (doc_id, row, line). Occurrences in
a document that overlap, one with the next, are one: what overlaps the first stays whole,
such as a column of equal short lines.

Method: prefix doubling. Rank 0 orders the line ids; the rank of 2h lines orders the
pairs (rank of h lines here, rank of h lines h further on). A rank is the place of
the pair in a distributed sort (a rising 64-bit number per sorted row), so equal
prefixes have equal ranks and no task numbers all of them; prefixes met only
once drop out after each step. The suffixes whose first n lines are equal form an LCP
interval of depth n, named by two overlapping ranks. A run of MIN_WORDS non-blank lines
always reaches MIN_WORDS words, so the array is only sorted that deep: deeper order
can't change a decision. For each line the shortest long-enough run that starts there
and the one that ends there are looked up; together these cover every maximal run.
In an interval all runs but the first, and those that a chain of overlaps ties to it, are later copies.

Scale: texts are read once for (row, line number, 16-byte id), and meet the deletions in one join.
Everything between holds lines met at least twice, in narrow rows; a line common
to a third of all documents is one class, combined map-side, and joins split it. Only
occurrences in the first one's own document are put in order, to see which overlap.

Defined results: a null or empty text has no lines and stays as it is; blank lines
(blanks, tabs, carriage returns) count for nothing and stay; a document that had
lines and lost all of them goes from ``dedup``; of repeated rows the later lose their
lines; null doc_ids come first; extra columns are kept. A line's words are those of the shared
word pattern and, of scripts written without blanks, one for every two characters; any
non-blank line counts as one at least. Documents are written with their row number once and every step reads that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from escalade.llm import common as C

MIN_WORDS = 10

# Characters of scripts written without blanks, as code point ranges: Thai to Lao, Burmese, Khmer, Chinese and Japanese
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_UNSPACED = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in UNSPACED) + "]"
_WORD = C.WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # the shared word pattern, of either case
_WORDS = (f"greatest(1, regexp_count(x, r'{_WORD}') + "
          f"if(octet_length(x) = length(x), 0, cast(regexp_count(x, r'{_UNSPACED}') div 2 as int)))")

_LINES = r"filter(transform(split(coalesce(cast(text as string), ''), '\n'), x -> trim(BOTH ' \t\r' FROM x)), x -> x <> '')"


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per non-blank line of ``docs`` (__row, doc_id, text): (row, doc_id, seq, id, ahead, back): the lengths of the
    shortest runs of ``min_words`` words that start and end here (0: none)."""
    w = min_words
    run = (f"aggregate({{}}, named_struct('s', 0, 'c', 0), (a, x) -> if(a.s >= {w}, a, named_struct('s', a.s + x, 'c', a.c + 1)),"
           f" a -> if(a.s >= {w}, a.c, 0))")
    ahead = run.format(f"slice(n, i + 1, {w})")
    back = run.format(f"reverse(slice(n, greatest(i + 2 - {w}, 1), least(i + 1, {w})))")
    own = docs.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.expr(_LINES).alias("l"))
    counted = own.filter(F.size("l") > 0).withColumn("n", F.expr(f"transform(l, x -> {_WORDS})"))
    each = F.expr(f"transform(l, (x, i) -> named_struct('id', unhex(md5(x)), 'ahead', {ahead}, 'back', {back}))")
    return counted.select("row", "doc_id", F.posexplode(each).alias("seq", "x")).select("row", "doc_id", "seq", "x.*")


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Order-preserving ranks of the key values met at least twice: (keys, rank).

    Rows are numbered after a distributed sort, so ranks rise with the keys.
    """
    classes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return C.spill(classes.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_ranks(own: DataFrame, depth: int) -> list[DataFrame]:
    """For h = 1, 2, 4, ... up to ``depth``: (row, seq, rank) of the line sequences of
    length h that occur more than once."""
    first = own.join(_ranked(own, ["id"], "line-classes"), "id").select("row", "seq", "rank")
    levels, h = [C.spill(first, "line-ranks")], 1
    while 2 * h <= depth:
        here = levels[-1].withColumnRenamed("rank", "r1")
        there = levels[-1].select("row", (F.col("seq") - h).alias("seq"), F.col("rank").alias("r2"))
        pairs = here.join(there, ["row", "seq"])
        both = pairs.join(_ranked(pairs, ["r1", "r2"], "line-classes"), ["r1", "r2"])
        levels.append(C.spill(both.select("row", "seq", "rank"), "line-ranks"))
        h *= 2
    return levels


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, gone): per document (__row, doc_id, text) the numbers of its non-blank lines that go."""
    own = C.spill(lines(docs, min_words), "lines")
    levels = suffix_ranks(own, min_words)
    runs = own.filter("ahead > 0").select("row", "doc_id", F.col("seq").alias("start"), F.col("ahead").alias("len"))
    ending = own.filter("back > 1").select("row", "doc_id", (F.col("seq") - F.col("back") + 1).alias("start"), F.col("back").alias("len"))
    longer = runs.filter("len > 1").unionByName(ending).distinct()
    named = runs.filter("len = 1").join(levels[0], (levels[0]["row"] == runs["row"]) & (levels[0]["seq"] == runs["start"])) \
        .select(runs["row"], "doc_id", "start", "len", F.col("rank").alias("ra"), F.col("rank").alias("rb"))
    for k, level in enumerate(levels):
        h = 1 << k
        mine = longer.filter((F.col("len") >= h) & (F.col("len") < 2 * h)) if k < len(levels) - 1 else longer.filter(F.col("len") >= h)
        if k == 0:
            continue  # runs of one line are named above
        ra = level.select("row", F.col("seq").alias("start"), F.col("rank").alias("ra"))
        rb = level.select("row", F.col("seq").alias("_tail"), F.col("rank").alias("rb"))
        named = named.unionByName(mine.withColumn("_tail", F.col("start") + F.col("len") - h)
                                  .join(ra, ["row", "start"]).join(rb, ["row", "_tail"]).drop("_tail"))
    named = C.spill(named.withColumn("at", F.struct("doc_id", "row", "start")), "line-runs")
    interval = ["len", "ra", "rb"]
    firsts = named.groupBy(*interval).agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = named.join(firsts, interval)
    same = F.col("row") == F.col("first.row")
    # in the first one's document: chains of overlapping occurrences, of which the first chain stays
    place = Window.partitionBy(*interval).orderBy("start")
    apart = F.coalesce(F.col("start") >= F.lag("start").over(place) + F.col("len"), F.lit(False))
    own = copies.filter(same).withColumn("_apart", apart.cast("int")).withColumn("_chain", F.sum("_apart").over(place)).filter("_chain > 0")
    later = copies.filter(~same).select("row", "start", "len").unionByName(own.select("row", "start", "len"))
    gone = later.select("row", F.explode(F.expr("sequence(start, start + len - 1)")).alias("seq"))
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("seq")).alias("gone"))


def apply(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text after deletion, ``_lines`` (non-blank lines before) and
    ``_gone`` (numbers of the deleted ones)."""
    keyed = C.keyed(docs)
    gone = C.spill(deletions(keyed, min_words), "line-deletions").withColumnsRenamed({"row": "__row", "gone": "__gone"})
    # a shuffle join at every size: deletions grow with the corpus
    joined = keyed.join(gone.hint("shuffle_hash"), "__row", "left")
    out = joined.withColumns({
        "_lines": F.size(F.expr(_LINES)).cast("long"),
        "_gone": F.coalesce("__gone", F.expr("cast(array() as array<int>)"))})
    # one-element arrays name a value for the lambda in them, so that it is computed once a row
    kept = F.expr(r"""
      element_at(transform(array(split(cast(text as string), '\n')), raw ->
        element_at(transform(array(filter(sequence(0, size(raw) - 1), i -> trim(BOTH ' \t\r' FROM raw[i]) <> '')), places ->
          array_join(transform(array_except(sequence(0, size(raw) - 1), transform(_gone, s -> places[s])), i -> raw[i]), '\n')), 1)), 1)""")
    out = out.withColumn("text", F.when(F.size("_gone") > 0, kept).otherwise(F.col("text")))
    return out.select(*docs.columns, "_lines", "_gone")


@C.keeps_columns
def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs, columns unchanged.

    A document that lost all its lines goes; ``n_chars``, if there, follows the new text.
    """
    out = apply(docs, min_words).filter((F.size("_gone") == 0) | (F.size("_gone") < F.col("_lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_gone") > 0, F.length("text")).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document after deletion, with the numbers of the deleted lines."""
    done = apply(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_lines").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"),
                       F.array_join(F.expr("transform(_gone, x -> cast(x as string))"), ",").alias("removed"), "text")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
l AS (
  SELECT doc_id, text, raw,
         list_filter(list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM d),
s AS (
  SELECT doc_id, l, list_transform(l, lambda x: greatest(1, len(regexp_extract_all(x, '{_WORD}')) + len(regexp_extract_all(x, '{_UNSPACED}')) // 2)) AS n,
         unnest(range(1, len(l) + 1)) AS i FROM l WHERE len(l) > 0),
r AS (
  SELECT DISTINCT doc_id, a, b, list_slice(l, a, b) AS run FROM (
    SELECT doc_id, l, i AS a,
           (SELECT min(e) FROM (SELECT unnest(range(i, least(i + {MIN_WORDS}, len(l) + 1))) AS e)
            WHERE list_sum(list_slice(n, i, e)) >= {MIN_WORDS}) AS b FROM s
    UNION ALL
    SELECT doc_id, l,
           (SELECT max(e) FROM (SELECT unnest(range(greatest(i - {MIN_WORDS} + 1, 1), i + 1)) AS e)
            WHERE list_sum(list_slice(n, e, i)) >= {MIN_WORDS}) AS a, i AS b FROM s)
  WHERE a IS NOT NULL AND b IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM (
    SELECT *, sum(apart) OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM (
      SELECT *, CASE WHEN doc_id = lag(doc_id) OVER w AND a <= lag(b) OVER w THEN 0 ELSE 1 END AS apart
      FROM r WINDOW w AS (PARTITION BY run ORDER BY doc_id, a))) WHERE k > 1),
x AS (SELECT doc_id, list(i ORDER BY i) AS gone FROM g GROUP BY doc_id),
p AS (
  SELECT l.doc_id, l.text, l.raw, len(l.l) AS n_lines, coalesce(x.gone, []) AS gone,
         list_filter(range(1, len(l.raw) + 1), lambda k: trim(l.raw[k], ' ' || chr(9) || chr(13)) <> '') AS places
  FROM l LEFT JOIN x ON l.doc_id = x.doc_id),
q AS (SELECT *, list_transform(gone, lambda k: places[k]) AS dropped FROM p)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
       coalesce(array_to_string(list_transform(gone, lambda k: CAST(k - 1 AS VARCHAR)), ','), '') AS removed,
       CASE WHEN len(gone) = 0 THEN text ELSE coalesce(array_to_string(list_transform(
         list_filter(range(1, len(raw) + 1), lambda k: NOT list_contains(dropped, k)), lambda k: raw[k]), chr(10)), '') END AS text
FROM q
"""
