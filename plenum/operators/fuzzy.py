"""Exact fuzzy joins of names: every pair of a block whose fuzzy ratio reaches a threshold, without comparing all with all.

Two texts of ratio r differ by at most (1-r)(|a|+|b|) insertions and deletions, so at least one of a text's rarest
``4(1-r)/(2-r) |a| + 1`` bigrams survives in its partner: pairs meet on those and on their block only. They are pruned by
length and by 128-bit parity codes of their bigram sets, which differ in no more bits than three times the insertions and
deletions allowed, and scored with a bit-parallel common subsequence. Nothing is lost.

Null names match nothing; empty names match each other; a block that holds everything is joined on its bigrams alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from plenum.runtime import cut

#: Names at a side of a block of pairs.
BLOCK = 512


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word row per letter of ``b``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> int:
    total = len(a) + len(b)
    return 100 if not total else round(200 * lcs(a, b) / total)


def ratios(a: list[str | None], b: list[str | None]) -> list[int | None]:
    """``ratio`` of each pair; those of at most 64 letters together, a block at a time, one letter of all ``b`` after the other."""
    out: list[int | None] = [None] * len(a)
    short = []
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            continue
        if 0 < len(x) <= 64 and 0 < len(y) <= 64:
            short.append(i)
        else:
            out[i] = ratio(x, y)
    for s in range(0, len(short), 2000):
        at = short[s : s + 2000]
        # the padding is no letter: bits of it lie outside of ``full``
        xs, ys = (np.frombuffer("".join(t[i].ljust(64, "\0") for i in at).encode("utf-32-le", "surrogatepass"), "u4").reshape(-1, 64) for t in (a, b))
        nx, ny = (np.array([len(t[i]) for i in at]) for t in (a, b))
        full = np.uint64(2**64 - 1) >> (64 - nx).astype(np.uint64)
        v = full.copy()
        for j in range(int(ny.max())):
            u = v & np.packbits(xs == ys[:, j : j + 1], axis=1, bitorder="little").view("<u8").ravel()
            v = np.where(j < ny, ((v + u) | (v - u)) & full, v)
        for i, n, common in zip(at, (nx + ny).tolist(), (nx - np.bitwise_count(v)).tolist()):
            out[i] = round(200 * common / n)
    return out


class _Spelled:
    """Names in order of length: their letters as numbers, and how often each of 32 kinds of letters occurs, in unary, four bits each."""

    def __init__(self, names: list[str]):
        self.order = np.argsort([len(x) for x in names], kind="stable")
        self.names = [names[i] for i in self.order]
        self.n = np.array([len(x) for x in self.names], np.int64)
        self.flat = np.frombuffer("".join(self.names).encode("utf-32-le", "surrogatepass"), "u4")
        self.starts = np.cumsum(self.n) - self.n
        row = np.repeat(np.arange(len(self.n)), self.n)
        often = np.bincount(row * 32 + self.flat % 32, minlength=32 * len(self.n)).reshape(-1, 32)
        unary = (np.uint64(1) << np.minimum(often, 4).astype(np.uint64)) - np.uint64(1)
        by = (4 * np.arange(16)).astype(np.uint64)
        self.codes = [np.bitwise_or.reduce(unary[:, 16 * h : 16 * h + 16] << by, axis=1) for h in (0, 1)]


def _common(a: _Spelled, b: _Spelled, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``lcs`` of names ``a[i]``, of at most 64 letters each, and ``b[j]``, one letter of all ``b[j]`` after the other."""
    at, place = np.unique(i, return_inverse=True)
    n = a.n[at]
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    alphabet, letter = np.unique(a.flat[np.repeat(a.starts[at], n) + k], return_inverse=True)
    masks = np.zeros((len(at), len(alphabet) + 1), np.uint64)
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(at)), n), letter), np.uint64(1) << k.astype(np.uint64))
    other, there = np.unique(j, return_inverse=True)
    longest = int(b.n[other].max())
    letters = np.full((len(other), longest), len(alphabet), np.int64)  # letters that no ``a`` has
    k = np.arange(longest) < b.n[other][:, None]
    own = b.flat[np.repeat(b.starts[other], b.n[other]) + np.nonzero(k)[1]]
    found = np.minimum(np.searchsorted(alphabet, own), max(0, len(alphabet) - 1))
    letters[k] = np.where(alphabet[found] == own, found, len(alphabet)) if len(alphabet) else 0
    v = np.full(len(i), ~np.uint64(0))
    masks, base = masks.ravel(), place * (len(alphabet) + 1)
    for p in range(longest):
        u = v & masks[base + letters[there, p]]
        v = (v + u) | (v - u)
    full = ~np.uint64(0) >> (64 - np.maximum(a.n[i], 1)).astype(np.uint64)
    return np.where(a.n[i] > 0, a.n[i] - np.bitwise_count(v & full), 0)


def alike(a: list[str], b: list[str] | None, threshold: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ratio): all pairs of names ``a[i]``, ``b[j]`` of ratio >= ``threshold``; without ``b`` those of different names of ``a``, once.

    Names differ in as many letters at least as their counts of letters differ; lengths and these counts decide for all but a few
    pairs, block by block. ``seen`` collects how many pairs each block scored.
    """
    r = (threshold - 0.5) / 100
    x = _Spelled(a)
    y = _Spelled(b) if b is not None else x
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    for s in range(0, len(a), BLOCK):
        e = min(s + BLOCK, len(a))
        # the lengths that reach the threshold with any of this block
        low, high = r * x.n[s] / (2 - r) - 1e-9, (2 - r) * x.n[e - 1] / r + 1e-9
        first, last = (s, len(a)) if b is None else (int(np.searchsorted(y.n, low)), len(y.names))
        last = min(last, int(np.searchsorted(y.n, high, "right")))
        for s2 in range(first, last, BLOCK):
            e2 = min(s2 + BLOCK, last)
            differ = sum(np.bitwise_count(x.codes[h][s:e, None] ^ y.codes[h][None, s2:e2]) for h in (0, 1))
            hits = np.flatnonzero(differ <= min(255, int((1 - r) * (x.n[e - 1] + y.n[e2 - 1]) + 1e-9)))
            i, j = hits // (e2 - s2) + s, hits % (e2 - s2) + s2
            total = x.n[i] + y.n[j]
            ok = (differ.ravel()[hits] <= (1 - r) * total + 1e-9) & (2 * np.minimum(x.n[i], y.n[j]) >= r * total - 1e-9)
            if b is None:
                ok &= i < j
            i, j, total = i[ok], j[ok], total[ok]
            if seen is not None:
                seen.append(len(i))
            common = np.zeros(len(i), np.int64)
            short, turned = x.n[i] <= 64, (x.n[i] > 64) & (y.n[j] <= 64)
            if short.any():
                common[short] = _common(x, y, i[short], j[short])
            if turned.any():
                common[turned] = _common(y, x, j[turned], i[turned])
            for k in np.flatnonzero(~short & ~turned):
                common[k] = lcs(x.names[i[k]], y.names[j[k]])
            q = np.where(total > 0, np.rint(200 * common / np.maximum(total, 1)), 100).astype(np.int64)
            good = q >= threshold
            for to, part in zip(out, (x.order[i[good]], y.order[j[good]], q[good])):
                to.append(part)
    return tuple(np.concatenate(part) for part in out)


@F.arrow_udf(IntegerType())
def fuzzy_ratio_fast(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``fuzzy_ratio`` of two columns in Arrow batches."""
    for a, b in parts:
        yield pa.array(ratios(a.to_pylist(), b.to_pylist()), pa.int32())


def _bigrams(name: Column) -> Column:
    padded = F.concat(F.lit("\u0002"), name, F.lit("\u0003"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(padded, i, F.lit(2))))


def _parity(half: int) -> Column:
    """64 of the 128 bits: each bigram flips the bit it hashes to."""
    bit = lambda g: F.pmod(F.xxhash64(g), F.lit(128)).cast("int")
    mine = F.filter(F.transform("gs", bit), lambda h: (h >= 64 * half) & (h < 64 * half + 64))
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h - 64 * half)))


def similar_names(left: DataFrame, right: DataFrame | None, threshold: int, block: str | None = None) -> DataFrame:
    """([block,] a, b, ratio): names of ``left`` and ``right`` (column ``name``) of ratio >= ``threshold``, distinct names once.

    Without ``right`` the names of ``left`` are joined with each other, both ways round and with themselves.
    """
    keys = [block] if block else []
    r = (threshold - 0.5) / 100
    share = 4 * (1 - r) / (2 - r)
    one = left.filter("name IS NOT NULL").select(*keys, "name").distinct().withColumn("side", F.lit(0))
    both = one if right is None else one.unionByName(right.filter("name IS NOT NULL").select(*keys, "name").distinct().withColumn("side", F.lit(1)))
    # cut: codes are made once a name, prefixes once for both sides
    coded = cut(both.withColumn("gs", _bigrams(F.col("name")))).withColumns({"m0": _parity(0), "m1": _parity(1)})
    coded = cut(coded)
    grams = coded.select(*keys, "side", "name", "m0", "m1", F.explode("gs").alias("g"))
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy(*keys, "side", "name").orderBy("n", "g")
    prefix = cut(grams.join(often, "g").withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= F.floor(F.lit(share) * F.length("name")) + 1).drop("r", "n"))
    part = lambda side, x: prefix.filter(F.col("side") == side).select(*keys, "g", F.col("name").alias(x), F.col("m0").alias(f"{x}0"), F.col("m1").alias(f"{x}1"))
    # few bytes, many pairs: spread over all cores whatever the size
    cores = 4 * left.sparkSession.sparkContext.defaultParallelism
    a, b = part(0, "a").repartition(cores, *keys, "g"), part(0 if right is None else 1, "b").repartition(cores, *keys, "g")
    total = F.length("a") + F.length("b")
    near = 2 * F.least(F.length("a"), F.length("b")) >= r * total - 1e-9
    bits = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    close = bits <= 3 * F.floor((1 - r) * total + 1e-9)
    met = a.join(b, [*keys, "g"]).filter(near & close)
    if right is None:
        met = met.filter("a < b")
    met = met.select(*keys, "a", "b").distinct().repartition(cores, "a", "b")
    found = met.withColumn("ratio", fuzzy_ratio_fast("a", "b")).filter(F.col("ratio") >= threshold)
    if right is None:
        cols = [*keys, "a", "b", "ratio"]
        turned = found.select(*cols, F.explode(F.array(F.lit(False), F.lit(True))).alias("t")).select(*keys, F.when(F.col("t"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("t"), F.col("a")).otherwise(F.col("b")).alias("b"), "ratio")
        found = turned.unionByName(one.select(*keys, F.col("name").alias("a"), F.col("name").alias("b"), F.lit(100).alias("ratio")))
    return found
