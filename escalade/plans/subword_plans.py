"""Subword encoding of documents over pieces taken from the benchmark's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions.text import analyzer_tokens
from escalade.operators import subwords as SW
from escalade.operators.labels import label_dictionary, label_encode
from escalade.plans.registry import plan
from escalade.plans.text_plans import MAX_LEN, _doc_tokens, _tok_sql
from escalade.sources.tables import read_table

FR = SW.FRAME
ROOM = FR.room(MAX_LEN)

# longest match by recursion over distinct words: the longest piece from every place of a word first
PIECES_SQL = f"""bw AS (SELECT DISTINCT unnest({_tok_sql('text')}) AS piece FROM benchmark),
ps AS (SELECT piece FROM bw UNION SELECT unnest(string_split(piece, '')) FROM bw),
pieces AS (SELECT piece, starts, row_number() OVER (ORDER BY starts DESC, piece) - 1 + {SW.FIRST_PIECE} AS pid
  FROM ps, (VALUES (true), (false)) t(starts) WHERE piece <> ''),
toks AS MATERIALIZED (SELECT doc_id, lang, {_tok_sql('text')} AS tk FROM documents),
dw AS (SELECT DISTINCT unnest(tk) AS word FROM toks),
longest AS (SELECT max(length(piece)) AS n FROM ps),
cuts AS (SELECT word, fr, fr + len AS till, substr(word, fr::INT + 1, len::INT) AS piece
  FROM (SELECT word, unnest(range(length(word))) AS fr FROM dw), (SELECT unnest(range(1, n + 1)) AS len FROM longest)
  WHERE fr + len <= length(word)),
best AS MATERIALIZED (SELECT word, fr, max(till) AS till, arg_max(pid, till) AS pid FROM cuts JOIN pieces p ON p.piece = cuts.piece AND p.starts = (fr = 0)
  GROUP BY word, fr),
enc AS (SELECT word, 0::BIGINT AS fr, []::BIGINT[] AS ids FROM dw
  UNION ALL SELECT e.word, b.till, list_append(e.ids, b.pid) FROM enc e JOIN best b ON b.word = e.word AND b.fr = e.fr),
done AS (SELECT word, ids FROM enc WHERE fr = length(word)),
wid AS (SELECT word, coalesce(ids, [{FR.unknown}::BIGINT]) AS ids FROM dw LEFT JOIN done USING (word)),
occ AS (SELECT doc_id, unnest(tk) AS word, unnest(range(len(tk))) AS pos FROM toks),
seqs AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM occ JOIN wid USING (word) GROUP BY doc_id),
own AS (SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS labels, coalesce(ids, []::BIGINT[]) AS ids FROM toks LEFT JOIN seqs USING (doc_id))"""


def _framed_sql(window: str, rows: str) -> str:
    seq = f"[{FR.start}::BIGINT] || ids[w * {ROOM} + 1:w * {ROOM} + {ROOM}] || [{FR.end}::BIGINT]"
    return f"""WITH RECURSIVE {PIECES_SQL}
SELECT doc_id, labels, {window} list_resize(seq, {MAX_LEN}, {FR.pad}::BIGINT) AS input_ids,
  list_resize(list_transform(seq, lambda x: 1::BIGINT), {MAX_LEN}, 0::BIGINT) AS attention_mask
FROM (SELECT doc_id, labels, w, {seq} AS seq FROM ({rows}))"""


def _samples(spark, sf_dir):
    """(doc_id, terms, label): the token table with class numbers."""
    docs = _doc_tokens(spark, sf_dir)
    return label_encode(docs, "lang", label_dictionary(docs, "lang"), out="label").select("doc_id", "terms", "label")


def _pieces(spark, sf_dir):
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(analyzer_tokens(F.col("text"))).alias("word"))
    return SW.pieces_from_words(words)


@plan("subword_ids", _framed_sql("w::INT AS window,", f"""SELECT doc_id, labels, ids,
  unnest(range(greatest((len(ids) + {ROOM} - 1) // {ROOM}, 1))) AS w FROM own"""))
def q_subword_ids(spark, sf_dir):
    """Whole documents in windows."""
    return SW.subword_ids(_samples(spark, sf_dir), "doc_id", _pieces(spark, sf_dir), MAX_LEN, label_col="label")


@plan("subword_ids_truncated", _framed_sql("", "SELECT doc_id, labels, ids, 0 AS w FROM own"))
def q_subword_ids_truncated(spark, sf_dir):
    """One sequence a document, the rest cut off (what truncation is for)."""
    return SW.subword_ids(_samples(spark, sf_dir), "doc_id", _pieces(spark, sf_dir), MAX_LEN, label_col="label", truncate=True)
