"""Text expressions: accent folding, Python-style strip, analyzer tokens.

All functions take and return ``Column``s built from Spark built-ins, so
they stay inside whole-stage code generation.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The analyzer keeps pieces made only of ASCII letters, at least
# two long, with no letter, digit or '_' beside them.
TOKEN_PATTERN = r"(?<![\p{L}\p{N}_])[a-z]{2,}+(?![\p{L}\p{N}_])"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate`` that fold accents like NFKD.

    Built from the Unicode database by a rule: a code point whose NFKD form
    without combining marks is another single character maps to that; a
    combining mark maps to nothing (``translate`` deletes the characters of
    ``from`` beyond the length of ``to``).
    """
    src, dst, dele = [], [], []
    for ch, d in _foldings():
        if not d:
            dele.append(ch)
        elif len(d) == 1:
            src.append(ch)
            dst.append(d)
    return "".join(src) + "".join(dele), "".join(dst)


def _foldings():
    """(character, its NFKD form without combining marks) where the two differ."""
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:  # surrogates; Hangul syllables hold no letters to keep
            continue
        ch = chr(cp)
        d = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if d != ch:
            yield ch, d


@lru_cache(maxsize=1)
def expansion_table() -> list[tuple[str, str]]:
    """(character, text) for characters that fold to several ones (ligatures,
    units, ...), where that text holds an ASCII letter."""
    return [(ch, d) for ch, d in _foldings() if len(d) > 1 and any("a" <= c.lower() <= "z" for c in d)]


def _any_of(characters: list[str]) -> str:
    """Pattern of one of ``characters``: a character below all of them ends the test at once, and
    neighbours form ranges (each member of a class is otherwise tried for every letter of a text)."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, characters)):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return r"(?![\x00-\x{%x}])[%s]" % (runs[0][0] - 1, "".join(r"\x{%x}-\x{%x}" % (a, b) for a, b in runs))


def strip_accents(c: Column) -> Column:
    src, dst = accent_table()
    many = expansion_table()
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in many])
    # only rows that hold such a character pay for the replacements
    longer = F.aggregate(pairs, c, lambda t, p: F.replace(t, p["a"], p["b"]))
    has = c.rlike(_any_of([a for a, _ in many]))
    return F.translate(F.when(has, longer).otherwise(c), src, dst)


def py_strip(c: Column) -> Column:
    """Remove leading/trailing Unicode whitespace (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def analyzer_tokens(text: Column) -> Column:
    """array<string>: lowercase, fold accents, and of the runs of letters, digits and '_' those
    that fully match ``[a-z]{2,}``, found in one go. A text of ASCII bytes has no accents to fold."""
    folded = _let(F.lower(text), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(strip_accents(t)))
    return F.regexp_extract_all(folded, F.lit(TOKEN_PATTERN), F.lit(0))


def whitespace_count(text: Column) -> Column:
    """Number of pieces of a whitespace split (Python ``len(s.split())``)."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda p: p != F.lit("")))


def utf8_bytes(text: Column) -> Column:
    """UTF-8 byte length: the message size of a sample."""
    return F.octet_length(text)
