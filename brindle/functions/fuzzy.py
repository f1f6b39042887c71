"""Fuzzy text functions over bytes, as Catalyst expressions.

``similarity``: multiset Jaccard of byte trigrams, of the needle at most its first 64; where either side is shorter than a
trigram, 1 if equal and else 0.  ``edit_distance``: Levenshtein distance of bytes to the needle's first 64 bytes.
Null text gives null.  Both stay inside whole-stage code or Catalyst's interpreted expressions: no Python runs.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A needle of so many grams at most, each found once in it, is looked for gram by gram in generated code.
PLAIN_GRAMS = 24
#: The gram's length in bytes, and the most needle grams and bytes that count.
GRAM, MOST_GRAMS, MOST_BYTES = 3, 64, 64


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0") + "'"


def as_bytes(text: str) -> str:
    """One character for each byte."""
    return text.encode("utf-8").decode("latin-1")


def similarity_sql(column: str, needle: str) -> str:
    low = as_bytes(needle)
    if len(low) < GRAM:
        return f"CASE WHEN {column} IS NULL THEN NULL WHEN {column} = {quoted(needle)} THEN 1.0D ELSE 0.0D END"
    counts = Counter([low[i : i + GRAM] for i in range(len(low) - GRAM + 1)][:MOST_GRAMS])
    n = sum(counts.values())
    if n == len(counts) <= PLAIN_GRAMS:
        # A text shorter than a gram holds none, and so scores 0.  Bytes of a text are looked at as they are where the needle is ASCII.
        hay = column if needle.isascii() else f"decode(encode({column}, 'UTF-8'), 'ISO-8859-1')"
        shared = " + ".join(f"CAST(contains({hay}, {quoted(g)}) AS INT)" for g in counts)
        return f"(CAST({shared} AS DOUBLE) / (greatest(octet_length({column}) - {GRAM - 1}, 0) + {n} - ({shared})))"
    known = f"array({', '.join(quoted(g) for g in counts)})"
    wanted = f"array({', '.join(f'struct({quoted(g)} AS g, {k} AS n)' for g, k in counts.items())})"
    # A one-element array stands for a variable: bytes, then the grams that the needle has, then how many are shared.
    met = f"filter(transform(sequence(1, length(hay) - {GRAM - 1}), i -> substring(hay, i, {GRAM})), h -> array_contains({known}, h))"
    shared = f"transform(transform(array({met}), met -> aggregate({wanted}, 0, (total, p) -> total + least(p.n, size(filter(met, h -> h = p.g))))), shared -> CAST(shared AS DOUBLE) / (length(hay) - {GRAM - 1} + {n} - shared))[0]"
    return f"transform(array(decode(encode({column}, 'UTF-8'), 'ISO-8859-1')), hay -> CASE WHEN hay IS NULL THEN NULL WHEN length(hay) < {GRAM} THEN 0.0D ELSE {shared} END)[0]"


def edit_distance_sql(column: str, needle: str) -> str:
    return f"levenshtein(decode(encode({column}, 'UTF-8'), 'ISO-8859-1'), {quoted(as_bytes(needle)[:MOST_BYTES])})"


def similarity(column: str, needle: str) -> Column:
    return F.expr(similarity_sql(f"`{column}`", needle))


def edit_distance(column: str, needle: str) -> Column:
    return F.expr(edit_distance_sql(f"`{column}`", needle))
