"""Similarities of texts and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a fold over the letters of ``a`` that carries one row of the table."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    bs = letters(b)
    zero = F.transform(bs, lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        # the cell left of the first is 0; out[-1] is the cell just made
        def cell(acc: Column, i: Column) -> Column:
            up, diagonal = F.get(row, i), F.coalesce(F.get(row, i - 1), F.lit(0))
            left = F.coalesce(F.get(acc, i - 1), F.lit(0))
            return F.concat(acc, F.array(F.when(F.get(bs, i) == x, diagonal + 1).otherwise(F.greatest(up, left))))

        places = F.filter(F.transform(bs, lambda _, i: i), lambda i: i >= 0)
        return F.aggregate(places, F.array().cast("array<int>"), cell)

    last = F.aggregate(letters(a), zero, next_row)
    return F.coalesce(F.array_max(last), F.lit(0))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """0..100: twice the common subsequence over both lengths, rounded half to even; two empty texts are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100).otherwise(F.bround(200.0 * common_subsequence(a, b) / total, 0)).cast("int")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if either vector has no length."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(_dot(a, b) / norms)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def hybrid(fuzzy: Column, vector: Column) -> Column:
    """0.3 fuzzy + 0.7 vector; a missing vector counts 0."""
    return 0.3 * fuzzy + 0.7 * F.coalesce(vector, F.lit(0.0))
