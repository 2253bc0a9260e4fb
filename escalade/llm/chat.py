"""Cumulative-snapshot collapse of logged conversations, then rendering (operator 9).

A chat log often holds a conversation once per turn, each snapshot repeating the
turns so far. Rolling hashes of the turn prefixes show which conversations are the
beginning of a longer one: an anti-join of whole-conversation hashes against proper
prefixes' hashes keeps the maximal conversations (of equal ones that with the least
conv_id), which are rendered for chat training. DataFrame functions only.

A turn's hash covers its number, role and text; a prefix's hash is the pair of sums
of its turns' hashes (two of 40 bits, besides the number of turns), so the rolling
hash is a running sum. It is built on two levels, within blocks of ``BLOCK`` turn numbers
and over blocks, so that one endless conversation is spread over many tasks; it is
also rendered block by block, as ``segment`` 0, 1, ... of the conversation.

Defined results: rows without a conv_id belong to no conversation and are left out;
a null turn number counts as -1, a null role or text as empty; repeated rows count
once; different rows of the same turn number follow in the order of role and md5 of the
text; an empty table gives no rows; extra columns are ignored. ``<|`` in a text is
written ``< |`` so that it can't open a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from escalade.llm import common as C

BLOCK = 1024
_BITS = 40


def turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their digest, block and the two halves of their hash."""
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.md5("text")
    half = [F.conv(F.substring(F.md5(F.concat_ws("\x00", F.lit(str(k)), F.col("turn").cast("string"), "role", digest)), 1, _BITS // 4),
                   16, 10).cast("long") for k in (0, 1)]
    return own.select("conv_id", "turn", "role", "text", digest.alias("digest"),
                      F.floor(F.col("turn") / BLOCK).cast("long").alias("segment"), half[0].alias("h0"), half[1].alias("h1"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row per distinct turn: the length and hash of the prefix that it ends,
    and the length of its conversation."""
    own = turns(conversations).select("conv_id", "segment", "turn", "role", "digest", "h0", "h1").distinct()
    blocks = own.groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.sum("h0").alias("s0"), F.sum("h1").alias("s1"))
    before = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "segment", F.sum("n").over(W.partitionBy("conv_id")).alias("n_turns"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("n", "s0", "s1")])
    within = W.partitionBy("conv_id", "segment").orderBy("turn", "role", "digest").rowsBetween(W.unboundedPreceding, 0)
    return own.join(blocks, ["conv_id", "segment"]).select(
        "conv_id", "n_turns", (F.col("before_n") + F.count("*").over(within)).alias("n"),
        (F.col("before_s0") + F.sum("h0").over(within)).alias("s0"), (F.col("before_s1") + F.sum("h1").over(within)).alias("s1"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that begin no longer one."""
    rolling = C.spill(prefixes(conversations), "chat-prefixes")
    whole = rolling.filter("n = n_turns").groupBy("n", "s0", "s1").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = rolling.filter("n < n_turns").select("n", "s0", "s1").distinct()
    return whole.join(begun, ["n", "s0", "s1"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per segment of each kept conversation, its turns in order as one text."""
    own = turns(conversations).select("conv_id", "segment", "turn", "role", "digest", "text")
    chosen = own.join(kept, "conv_id")
    order = F.array_sort(F.collect_set(F.struct("turn", "role", "digest", "text")))
    one = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    return chosen.groupBy("conv_id", "segment").agg(
        F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), order.alias("_t")).select(
        "conv_id", "segment", "n_turns", "n_copies", F.array_join(F.transform("_t", one), "").alias("rendered"))


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """The rendered maximal conversations."""
    conversations = C.table(spark, sf_dir, "conversations")
    return render(conversations, maximal(conversations))


OP9_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, md5(text)) AS turns
  FROM t GROUP BY conv_id),
d AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, turns FROM c GROUP BY turns),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM d)),
m AS (SELECT d.* FROM d LEFT JOIN p ON d.turns = p.turns WHERE p.turns IS NULL),
u AS (SELECT conv_id, len(turns) AS n_turns, n_copies, unnest(turns) AS x FROM m)
SELECT conv_id, CAST(floor(x.turn / 1024.0) AS BIGINT) AS segment, n_turns, n_copies,
       string_agg('<|' || x.role || '|>' || chr(10) || replace(x.text, '<|', '< |') || '<|end|>' || chr(10), ''
                  ORDER BY x.turn, x.role, md5(x.text)) AS rendered
FROM u GROUP BY conv_id, segment, n_turns, n_copies
"""
