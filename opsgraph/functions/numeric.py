"""Numeric expressions: rounding half up, BM25 terms, reciprocal rank fusion, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
CODE_BOOST, SECTION_BOOST, CODE_TF = 50.0, 10.0, 5
RRF_K = 60
DIM = 64


def js_round(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also below zero."""
    p = float(10**digits)
    return F.floor(c * F.lit(p) + F.lit(0.5)) / F.lit(p)


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, length: Column, mean: Column, n: Column, df: Column) -> Column:
    return idf(n, df) * (tf * (K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * (length / mean)))


def rrf(bm25: Column, vector: Column, graph: Column, k: int = RRF_K) -> Column:
    """Fused score of three ranks (null: not in that list), rounded to four digits."""
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(k) + r), F.lit(0.0))
    return js_round(part(bm25, 1.0) + part(vector, 1.0) + part(graph, 1.5), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, within -1 and 1; 0 for vectors that are empty or differ in length."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(0.0)
