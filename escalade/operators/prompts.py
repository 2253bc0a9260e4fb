"""Prompt assembly for a generative tier, and label extraction from its output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.text import py_strip

# Layout of the system message.
SYSTEM_LAYOUT = "{task}\n\nAllowed labels:\n{labels}"
LABEL_BULLET = "- "


def system_message(task: str, labels: list[str]) -> str:
    return SYSTEM_LAYOUT.format(task=task, labels="\n".join(LABEL_BULLET + l for l in labels))


def _msg(role: str | Column, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def preamble(pool: DataFrame, task: str, labels: list[str], pool_text: str = "text", pool_label: str = "label",
             pool_order: list[str] | None = None) -> DataFrame:
    """One row with ``messages`` = array<struct<role, content>>: the system message and one
    user/assistant pair per few-shot example. All prompts share it.

    The pool is at most k x classes rows by construction.
    """
    order = pool_order or [pool_label, "rank"]
    ex = pool.select(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                              F.col(pool_text).alias("t"), F.col(pool_label).cast("string").alias("l")).alias("e"))
    pairs = F.flatten(F.transform(F.array_sort(F.collect_list("e")),
                                  lambda e: F.array(_msg("user", e["t"]), _msg("assistant", e["l"]))))
    return ex.agg(F.concat(F.array(_msg("system", F.lit(system_message(task, labels)))), pairs).alias("messages"))


def user_messages(samples: DataFrame, text_col: str, lead: DataFrame) -> DataFrame:
    """Adds (msg_idx, role, content): each sample's own message, which follows the
    preamble ``lead`` (one row) without repeating it."""
    n = lead.select(F.size("messages")).scalar()
    return samples.withColumns({"msg_idx": n.cast("int"), "role": F.lit("user"), "content": F.col(text_col)})


def chat_messages(samples: DataFrame, text_col: str, lead: DataFrame) -> DataFrame:
    """Adds ``messages``: the preamble ``lead`` (one row, read once by a scalar subquery),
    then the sample."""
    return samples.withColumn("messages", F.concat(
        lead.select("messages").scalar(), F.array(_msg("user", F.col(text_col)))))


# A chat template in the style of common instruction models.
DEFAULT_TEMPLATE = ("<|{role}|>\n", "\n<|end|>\n")
GENERATION_MARKER = "<|assistant|>\n"


def prompt_render(df: DataFrame, messages_col: str = "messages", template: tuple[str, str] = DEFAULT_TEMPLATE,
                  generation_marker: str = GENERATION_MARKER) -> DataFrame:
    """Adds ``prompt``: each message as head(role) + content + tail, then the
    generation marker. ``template`` = (head with ``{role}``, tail)."""
    head, tail = template
    pre, post = head.split("{role}")
    parts = F.transform(F.col(messages_col),
                        lambda m: F.concat(F.lit(pre), m["role"], F.lit(post), m["content"], F.lit(tail)))
    return df.withColumn("prompt", F.concat(F.array_join(parts, ""), F.lit(generation_marker)))


def parse_label(raw: Column, labels: list[str]) -> Column:
    """Label named by a generated text, else 'unknown'.

    NULL -> unknown; the stripped text equal to a label ignoring case -> that
    label; else the single label contained (ignoring case) in the text;
    none or several -> unknown.
    """
    s = F.lower(py_strip(raw))
    lab = F.array(*[F.lit(l) for l in labels])
    exact = F.filter(lab, lambda l: F.lower(l) == s)
    hits = F.filter(lab, lambda l: F.instr(s, F.lower(l)) > 0)
    return (F.when(raw.isNull(), F.lit("unknown"))
            .when(F.size(exact) > 0, F.element_at(exact, 1))
            .when(F.size(hits) == 1, F.element_at(hits, 1))
            .otherwise(F.lit("unknown")))
