"""Scalar and array column expressions (G1-G4, G10-G14, hashing).

Everything here returns a ``Column`` made of built-in functions, so it stays
inside whole-stage codegen; nothing calls back into Python per row.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["col_of", "part", "last_token", "name_length", "name_vowels", "row_sum",
           "hash_unit", "hash_int", "sigmoid", "gumbel", "log_loss_term", "euclidean",
           "sq_euclidean", "cosine_sim", "vec_item", "entropy2", "binary_by",
           "three_way", "strip_char"]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(c, sep: str, i: int) -> Column:
    """i-th (0-based) piece of ``c`` split on a literal separator; null when
    the piece is missing (``try_element_at`` does not raise under ANSI)."""
    return F.try_element_at(F.split(col_of(c), re.escape(sep)), F.lit(i + 1))


def last_token(c) -> Column:
    """Last whitespace-separated token; empty edge pieces are ignored."""
    toks = F.filter(F.split(col_of(c), r"\s+"), lambda x: x != "")
    return F.try_element_at(toks, F.lit(-1))


def _first_two_parts(c) -> Column:
    # name.split(' ') keeps empty pieces; pieces 1 and 2 are glued together.
    # A one-word name has no second piece and counts as the word alone.
    pieces = F.split(col_of(c), " ")
    return F.when(col_of(c).isNotNull(), F.concat(F.coalesce(F.try_element_at(pieces, F.lit(1)), F.lit("")),
                    F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit(""))))


def name_length(c) -> Column:
    return F.length(_first_two_parts(c)).cast("long")


def name_vowels(c) -> Column:
    s = _first_two_parts(c)
    return (F.length(s) - F.length(F.regexp_replace(s, "[aeiou]", ""))).cast("long")


def row_sum(cols) -> Column:
    """Row-wise sum that skips nulls (an all-null row sums to 0)."""
    return reduce(lambda a, b: a + b, [F.coalesce(col_of(c), F.lit(0)) for c in cols])


def hash_int(c, salt: str = "") -> Column:
    """First 32 bits of md5(salt || key) as a non-negative bigint.

    Reproducible across runs and partitionings, and equal to DuckDB's
    ``('0x' || substr(md5(salt || k::varchar), 1, 8))::bigint``.
    """
    s = F.concat(F.lit(salt), col_of(c).cast("string")) if salt else col_of(c).cast("string")
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_unit(c, salt: str = "") -> Column:
    """Deterministic pseudo-uniform number in [0, 1) from a key."""
    return hash_int(c, salt) / F.lit(4294967296.0)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(x)))


def gumbel(x) -> Column:
    """Generalised-extreme-value style activation exp(-exp(-x))."""
    return F.exp(-F.exp(-col_of(x)))


def log_loss_term(y, p, eps: float = 1e-15) -> Column:
    pc = F.least(F.greatest(col_of(p), F.lit(eps)), F.lit(1 - eps))
    return -(col_of(y) * F.log(pc) + (F.lit(1) - col_of(y)) * F.log(F.lit(1) - pc))


def sq_euclidean(a, b) -> Column:
    d = F.zip_with(col_of(a), col_of(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a, b) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def cosine_sim(a, b, eps: float = 1e-8) -> Column:
    """Cosine similarity with ``eps`` added to the norm product."""
    dot = F.aggregate(F.zip_with(col_of(a), col_of(b), lambda x, y: x * y), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(F.transform(col_of(a), lambda x: x * x), F.lit(0.0),
                            lambda acc, x: acc + x))
    nb = F.sqrt(F.aggregate(F.transform(col_of(b), lambda x: x * x), F.lit(0.0),
                            lambda acc, x: acc + x))
    return dot / (na * nb + F.lit(eps))


def vec_item(c, i: int = 0) -> Column:
    """Element ``i`` of an ML vector as double."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(col_of(c)).getItem(i).cast("double")


def entropy2(p) -> Column:
    """Binary entropy in bits of a positive-class share, 0 at p in {0, 1}."""
    p = col_of(p)
    q = F.lit(1.0) - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(
        -(p * F.log2(p)) - q * F.log2(q))


def binary_by(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def three_way(x, pivot: float = 3) -> Column:
    """positive above ``pivot``, negative below, neutral otherwise (incl. null)."""
    x = col_of(x)
    return (F.when(x > pivot, "positive").when(x < pivot, "negative")
            .otherwise("neutral"))


def strip_char(c, ch: str) -> Column:
    return F.replace(col_of(c), F.lit(ch), F.lit(""))
