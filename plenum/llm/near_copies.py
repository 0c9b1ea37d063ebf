"""Near-duplicate records with small edits: a self-join of binary tries on Hamming codes, exactly verified.

A record is the set of its words, in order of rarity. Records with equal sets form one class and are compared once. Two
sets of overlap >= t differ in at most ``k = (1-t)/(1+t) (|a|+|b|)`` words: the Hamming error budget of the pair.

1. The trie over the words in order of rarity is entered below the first word that both sets have: all words before it
   differ, and their number is what the traversal has accumulated there. Two sets that share none of their first
   ``n - ceil(t n) + 1`` words have used up the budget, so the trie's nodes below those words are all that can be met, and
   they are the partitions of the join. Nothing is sampled and nothing is lost.
2. Inside a node a record is a parity code of ``BITS`` bits: each of its later words flips the bit it hashes to. Codes differ
   in no more bits than the sets differ in words. Records of one size and place of the node's word form a shelf with a binary
   trie of its own; shelves whose budget is used up, or smaller than the difference of their sizes, do not meet. The tries of
   shelves that meet are traversed together, level by level, and a node pair is pruned once its differing bits exceed the
   budget. Node pairs (of ``LEAF`` codes, more where the budget left outlasts the levels) compare by XOR and bit count.
3. What is left is verified on the full word sets.

Hot nodes: a node of more than ``HOT`` records whose shelves leave more than ``MOST HOT^2`` pairs is split by the next word that
both sets have among their first words, one more of them counted; what is still hot after that is cut into ``TILE``-sized tiles
whose pairs are tasks of their own. The sizes come from counters over all rows, ``SLOTS`` of them whatever the table's size;
a counter that several words share only splits sooner.

Defined results
* a record without a description of its own (see ``own_text``) or without id takes no part; null names and aliases add no words;
* every class is expanded into all its pairs and all pairs with classes near it, whatever its size, in blocks of about
  ``BLOCK`` members; only with ``expand`` given is a larger class written as a star around its smallest id, which alone
  then stands in pairs with other classes;
* rows repeated under one id count once; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.own_text import tokens, with_own_description
from plenum.runtime import cut, received, ship

BITS = 128
#: Codes that a trie leaf holds.
LEAF = 8
#: Counters of words, how many records a hot node has at least, and a tile.
SLOTS, HOT, TILE = 1 << 18, 50_000, 25_000
#: Times the square of ``HOT``: pairs within budgets above which a hot node is split.
MOST = 4
#: Rows that a task takes up at once, node pairs of one step of the traversal, and members of one block of a class.
ROWS, PAIRS, BLOCK = 200_000, 2_000_000, 512
#: Codes at a side of what is compared as one rectangle, and cells of the rectangles that are compared at once.
SIDE, CELLS = 512, 1 << 17

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _slot(h: np.ndarray) -> np.ndarray:
    return (_mixed(h) >> _U(3)) & _U(SLOTS - 1)


def first_words(n: np.ndarray, t: float, more: int = 0) -> np.ndarray:
    """How many of a set's rarest words a set of overlap >= t must share one of (``more`` = 1: two of)."""
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + 1 + more)


class Ordered:
    """Word sets of one batch, flat, each in order of rarity, with the parity code of what follows each word."""

    def __init__(self, batch: pa.RecordBatch, counts: np.ndarray | None):
        lists = batch.column(1)
        h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        offsets = np.asarray(lists.offsets)[: batch.num_rows + 1].astype(np.int64)
        offsets = offsets - offsets[0]
        self.n = np.diff(offsets)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        often = counts[_slot(h)] if counts is not None else np.zeros(len(h), np.int64)
        order = np.lexsort((h, often, self.row))
        self.h, self.starts = h[order], offsets[:-1]
        self.pos = np.arange(len(h)) - self.starts[self.row]
        m = _mixed(self.h)
        self.codes = []
        for half in (0, 1):
            bit = np.where(((m >> _U(6)) & _U(1)) == _U(half), _U(1) << (m & _U(63)), _U(0))
            # what follows a word: the whole row's parity without the words up to it
            upto = np.bitwise_xor.accumulate(bit) if len(bit) else bit
            last = upto[offsets[1:] - 1] if len(self.n) else upto
            self.codes.append(last[self.row] ^ upto)


def _counted(kind: str, t: float, known):
    """Batches of (ck, hashes) to (slot, n): how many records have a word, begin with it, or stand below two of their first words."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if kind == "word":
                h = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                total += np.bincount(_slot(h), minlength=SLOTS)
                continue
            often, hot = received(known)
            o = Ordered(batch, often)
            if kind == "first":
                total += np.bincount(_slot(o.h[o.pos < first_words(o.n, t)[o.row]]), minlength=SLOTS)
            else:
                total += np.bincount(_slot(_below(o, hot, t)[0]), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["slot", "n"])

    return run


def _counters(sets: DataFrame, kind: str, t: float, known=None) -> np.ndarray:
    """``SLOTS`` numbers, added up on the executors: the driver gets one row a slot, however many rows there are."""
    rows = sets.mapInArrow(_counted(kind, t, known), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _shelved(t: float, known):
    """Batches of (ck, hashes) to (slot, size, gone, n): how many records of a shelf stand below a much used word."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            often, many = received(known)
            o = Ordered(batch, often)
            slot = _slot(o.h).astype(np.int64)
            i = np.flatnonzero((o.pos < first_words(o.n, t)[o.row]) & many[slot])
            of, n = np.unique(np.stack([slot[i], o.n[o.row[i]], o.pos[i]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(of[0], pa.int32()), pa.array(of[1], pa.int32()), pa.array(of[2], pa.int32()), pa.array(n)], names=["slot", "size", "gone", "n"])

    return run


def _crowded(sets: DataFrame, t: float, known) -> np.ndarray:
    """Which slots' nodes leave more pairs of records than can be compared in one task, after those of shelves too far apart; a slot has few shelves."""
    rows = sets.mapInArrow(_shelved(t, known), "slot int, size int, gone int, n bigint").groupBy("slot", "size", "gone").agg(F.sum("n").alias("n")).orderBy("slot").toArrow()
    slot, size, gone, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("slot", "size", "gone", "n"))
    out = np.zeros(SLOTS, bool)
    cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1], True])
    for s, e in zip(cuts[:-1], cuts[1:]):
        out[slot[s]] = _left(size[s:e], gone[s:e], n[s:e], t) > MOST * HOT * HOT
    return out


def _left(size: np.ndarray, gone: np.ndarray, n: np.ndarray, t: float) -> float:
    """Pairs of records on the shelves of one node that can be within their budget."""
    ratio, total = (1 - t) / (1 + t), 0.0
    slack, below = ratio * size - gone, size - gone
    for i in range(len(n)):
        near = (slack + slack[i] + 1e-6 >= np.abs(below - below[i])) & (np.minimum(size, size[i]) >= t * np.maximum(size, size[i]) - 1e-9)
        total += n[i] * float(n[near].sum()) / 2
    return total


def _below(o: Ordered, hot: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of the nodes that take the place of hot ones: below a hot first word, each other one of the first words and one more."""
    i = np.flatnonzero((o.pos < first_words(o.n, t)[o.row]) & hot[_slot(o.h)])
    many = first_words(o.n, t, 1)[o.row[i]]
    places = np.repeat(i, many)
    others = o.starts[o.row[places]] + np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many)
    # a set of one word has no other: it stays below its only one
    alone = np.repeat(many == 1, many)
    kept = alone | (others != places)
    places, others, alone = places[kept], others[kept], alone[kept]
    return np.where(alone, o.h[places], _mixed(o.h[places] * _U(0x9E3779B97F4A7C15) + o.h[others])), places


NODES = "node bigint, tiles int, ck bigint, n int, gone int, c0 bigint, c1 bigint"


def _nodes(t: float, known):
    """Batches of (ck, hashes) to one row for each node that a record stands below; ``gone``: words before the node."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            often, hot, filled = received(known)
            o = Ordered(batch, often)
            cold = (o.pos < first_words(o.n, t)[o.row]) & ~hot[_slot(o.h)]
            at = np.flatnonzero(cold)
            node, tiles = o.h[at], np.ones(len(at), np.int64)
            if hot.any():
                keys, places = _below(o, hot, t)
                full = filled[_slot(keys)]
                node, at = np.concatenate([node, keys]), np.concatenate([at, places])
                tiles = np.concatenate([tiles, np.where(full > HOT, -(-full // TILE), 1)])
            cks = batch.column(0).to_numpy(zero_copy_only=False)[o.row[at]]
            # a second word may stand before or after the node's first: the code below it holds in either case
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mixed(node).view(np.int64)), pa.array(tiles, pa.int32()), pa.array(cks, pa.int64()), pa.array(o.n[o.row[at]], pa.int32()), pa.array(o.pos[at], pa.int32()), pa.array(o.codes[0][at].view(np.int64)), pa.array(o.codes[1][at].view(np.int64))],
                names=["node", "tiles", "ck", "n", "gone", "c0", "c1"])

    return run


def _differing(c0, c1, i, j):
    return np.bitwise_count(c0[i] ^ c0[j]).astype(np.int32) + np.bitwise_count(c1[i] ^ c1[j])


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k): each index ``many[i]`` times, counted."""
    i = np.repeat(np.arange(len(many)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)


def trie_pairs(starts: np.ndarray, ends: np.ndarray, c0: np.ndarray, c1: np.ndarray, n: np.ndarray, gone: np.ndarray, t: float, seen: list | None = None, met: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within their Hamming budget inside each range ``starts[i]:ends[i]`` of rows sorted by (c0, c1), or across the ranges ``met``: one joint traversal of all tries.

    ``seen`` collects (node pairs met, node pairs pruned, code pairs compared).
    """
    ratio = (1 - t) / (1 + t)
    left, right = [], []
    tally = [0, 0, 0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the largest slack of each range: a pair's budget is at most those of its two ranges together
    top = np.maximum.reduceat(np.append(ratio * n - gone, -np.inf), np.stack([starts, ends], 1).ravel())[::2]

    def compare(al, ah, bl, bh, most):
        own = al == bl
        if (np.maximum(ah - al, bh - bl) > SIDE).any():
            ka, kb = -(-(ah - al) // SIDE), -(-(bh - bl) // SIDE)
            which, k = _spread(ka * kb)
            pa_, pb = k // kb[which], k % kb[which]
            once = ~own[which] | (pa_ <= pb)
            which, pa_, pb = which[once], pa_[once], pb[once]
            al, bl, own, most, ends_a, ends_b = al[which] + SIDE * pa_, bl[which] + SIDE * pb, own[which], most[which], ah[which], bh[which]
            ah, bh = np.minimum(al + SIDE, ends_a), np.minimum(bl + SIDE, ends_b)
        na, nb = ah - al, bh - bl
        tally[2] += int(np.where(al == bl, na * (na - 1) // 2, na * nb).sum())
        ea, eb = (np.frexp(x - 1)[1].astype(np.int64) for x in (na, nb))
        # rectangles of like shape together, padded to powers of two
        kind = ea * 64 + eb
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(kind[order]) != 0, True])
        for g0, g1 in zip(cuts[:-1], cuts[1:]):
            wa, wb = int(ea[order[g0]]), int(eb[order[g0]])
            step = max(1, CELLS >> (wa + wb))
            for s in range(g0, g1, step):
                at = order[s : min(s + step, g1)]
                x = c0[np.minimum(al[at][:, None] + np.arange(1 << wa), len(c0) - 1)]
                y = c0[np.minimum(bl[at][:, None] + np.arange(1 << wb), len(c0) - 1)]
                near = np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= np.minimum(most[at], BITS).astype(np.uint8)[:, None, None]
                hits = np.flatnonzero(near)
                m = at[hits >> (wa + wb)]
                i, j = al[m] + ((hits >> wb) & ((1 << wa) - 1)), bl[m] + (hits & ((1 << wb) - 1))
                real = (i < ah[m]) & (j < bh[m]) & (~own[m] | (i < j))
                i, j = i[real], j[real]
                ok = _differing(c0, c1, i, j) + gone[i] + gone[j] <= np.floor(ratio * (n[i] + n[j]) + 1e-9)
                left.append(i[ok])
                right.append(j[ok])

    x, y = met if met is not None else (np.arange(len(starts)),) * 2
    work = [(starts[x], ends[x], starts[y], ends[y], *(np.floor(top[x] + top[y] + 1e-6).astype(np.int16),) * 2, 0)]
    while work:
        # a node pair's budget, and the bits of it that are left below
        al, ah, bl, bh, whole, rest, depth = work.pop()
        if len(al) > PAIRS:
            h = len(al) // 2
            work += [(*(v[:h] for v in (al, ah, bl, bh, whole, rest)), depth), (*(v[h:] for v in (al, ah, bl, bh, whole, rest)), depth)]
            continue
        alive = (al < ah) & (bl < bh)
        al, ah, bl, bh, whole, rest = (v[alive] for v in (al, ah, bl, bh, whole, rest))
        if not len(al):
            continue
        tally[0] += len(al)
        within = rest >= 0
        tally[1] += int((~within).sum())
        al, ah, bl, bh, whole, rest = (v[within] for v in (al, ah, bl, bh, whole, rest))
        # ``rest`` levels cannot prune anything: what they would split down to leaves is a leaf
        leaf = (np.maximum(ah - al, bh - bl) <= LEAF * np.exp2(np.minimum(rest, 40))) | (depth == BITS)
        if leaf.any():
            compare(al[leaf], ah[leaf], bl[leaf], bh[leaf], whole[leaf])
        al, ah, bl, bh, whole, rest = (v[~leaf] for v in (al, ah, bl, bh, whole, rest))
        if not len(al):
            continue
        word, bit = (c0, 63 - depth) if depth < 64 else (c1, 127 - depth)
        # ones before each row: a node's codes are sorted, so its ones stand at its end
        ones = np.concatenate([[0], np.cumsum(((word >> _U(bit)) & _U(1)).astype(np.int64))])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        other = ~((al == bl) & (ah == bh))
        work.append((np.concatenate([al, am, al, am[other]]), np.concatenate([am, ah, am, ah[other]]), np.concatenate([bl, bm, bm, bl[other]]), np.concatenate([bm, bh, bh, bm[other]]),
                     np.concatenate([whole, whole, whole, whole[other]]), np.concatenate([rest, rest, rest - 1, rest[other] - 1]), depth + 1))
    if seen is not None:
        seen.append(tuple(tally))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _shelves(node: np.ndarray, n: np.ndarray, gone: np.ndarray, t: float):
    """(starts, ends, pairs of them) of rows sorted by (node, n - gone, n): the shelves of one node, n and gone whose codes can be within a budget.

    What stands below a node is ``n - gone`` words, so two shelves differ in no fewer bits than these numbers differ. Pairs come in portions.
    """
    ratio = (1 - t) / (1 + t)
    below = n - gone
    starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (below[1:] != below[:-1]) | (n[1:] != n[:-1])])
    ends = np.r_[starts[1:], len(node)]
    node, n, below, slack = node[starts], n[starts], below[starts], ratio * n[starts] - gone[starts]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    nth = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(node)]))
    reach = slack + np.maximum.reduceat(slack, first)[nth] + 1e-6
    wide = int(below.max()) + 1
    # the shelves from this one on that its words and the node's largest slack reach
    last = np.searchsorted(nth * wide + below, nth * wide + np.minimum(below + np.maximum(np.floor(reach), 0), wide - 1).astype(np.int64), "right")
    many = np.where(reach >= 0, last - np.arange(len(starts)), 0)
    upto = np.cumsum(many)
    s = 0
    while s < len(many):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + PAIRS, "right")))
        x, k = _spread(many[s:e])
        x = x + s
        y = x + k
        fits = (slack[x] + slack[y] + 1e-6 >= below[y] - below[x]) & (np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y]) - 1e-9) & ((x != y) | (ends[x] - starts[x] > 1))
        if fits.any():
            yield starts, ends, (x[fits], y[fits])
        s = e


def _joined(t: float):
    """Rows sorted by (node, c0, c1) to candidate pairs; a tile pair's rows of different tiles meet, those of one tile where it is paired with itself."""

    def pairs_of(table: pa.Table):
        key = table.column("node").to_numpy()
        n, gone, tile = (table.column(c).to_numpy() for c in ("n", "gone", "tile"))
        c0, c1 = (table.column(c).to_numpy() for c in ("c0", "c1"))
        # as unsigned numbers in order
        c0, c1 = c0.view(np.uint64), c1.view(np.uint64)
        order = np.lexsort((c1, c0, n, n - gone, key))
        key, n, gone, tile, c0, c1 = (x[order] for x in (key, n, gone, tile, c0, c1))
        ck = table.column("ck").to_numpy()[order]
        n, gone = n.astype(np.int64), gone.astype(np.int64)
        found = [trie_pairs(starts, ends, c0, c1, n, gone, t, None, met) for starts, ends, met in _shelves(key, n, gone, t)]
        i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        fits = (ck[i] != ck[j]) & ((tile[i] < 0) | (tile[i] != tile[j]))
        i, j = i[fits], j[fits]
        if not len(i):
            return None
        # pairs met below several nodes of one call leave once
        both = np.unique(np.stack([np.minimum(ck[i], ck[j]), np.maximum(ck[i], ck[j])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches):
        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("node").to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:  # the last node may go on in the next batch
                if (out := pairs_of(table.slice(0, last).combine_chunks())) is not None:
                    yield out
            held = table.slice(last).combine_chunks().to_batches()
            # a node above ROWS waits until as much again has come
            rows = sum(b.num_rows for b in held) // 2
        if held:
            if (out := pairs_of(pa.Table.from_batches(held).combine_chunks())) is not None:
                yield out

    return run


def word_sets(entities: DataFrame) -> DataFrame:
    """(entity_id, hashes): the sorted hashes of the words of every record with a description of its own."""
    df = with_own_description(entities.select("entity_id", "canonical_name", "description", "aliases").filter("entity_id IS NOT NULL"))
    df = df.filter("own_description IS NOT NULL")
    text = F.concat_ws(" ", "canonical_name", "description", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    return df.select("entity_id", F.array_sort(F.transform(tokens(text), lambda w: F.xxhash64(w))).alias("hashes")).filter("size(hashes) > 0")


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, ck) of every record, and one row (ck, rep, copies, hashes) of each class of equal sets."""
    keyed = cut(sets.withColumn("ck", F.xxhash64("hashes", F.size("hashes"))))
    whole = keyed.groupBy("ck").agg(F.min("entity_id").alias("rep"), F.count("*").alias("copies"), F.first("hashes").alias("hashes"))
    return keyed.select("entity_id", "ck"), cut(whole)


def candidate_pairs(whole: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the keys of classes whose codes stay within their Hamming budget, each pair once."""
    spark = whole.sparkSession
    sets = whole.select("ck", "hashes")
    often = _counters(sets, "word", threshold)
    hot = _counters(sets, "first", threshold, ship(spark, (often, None))) > HOT
    if hot.any():
        hot = _crowded(sets, threshold, ship(spark, (often, hot)))
    filled = _counters(sets, "second", threshold, ship(spark, (often, hot))) if hot.any() else None
    rows = sets.mapInArrow(_nodes(threshold, ship(spark, (often, hot, filled))), NODES)
    if hot.any():
        # a tile meets every tile of its node, once
        own = F.pmod(F.xxhash64("ck"), F.col("tiles")).cast("int")
        rows = rows.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        one = (F.col("tiles") == 1) | (F.col("own") == F.col("o"))
        node = F.when(F.col("tiles") == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("own", "o"), F.greatest("own", "o")))
        # rows of two tiles that meet: only pairs across count, pairs inside a tile are the tile's own task
        rows = rows.select(node.alias("node"), "ck", "n", "gone", "c0", "c1", F.when(one, -1).otherwise(F.col("own")).alias("tile"))
    else:
        rows = rows.drop("tiles").withColumn("tile", F.lit(-1))
    met = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_joined(threshold), "a bigint, b bigint")
    return met.distinct()


def class_links(whole: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, na, nb, similarity): the representatives of different classes whose word sets overlap by ``threshold`` or more, and the records of both."""
    cand = candidate_pairs(whole, threshold)
    one = whole.select(F.col("ck").alias("a"), F.col("rep").alias("ra"), F.col("hashes").alias("ha"), F.col("copies").alias("na"))
    two = whole.select(F.col("ck").alias("b"), F.col("rep").alias("rb"), F.col("hashes").alias("hb"), F.col("copies").alias("nb"))
    common = F.size(F.array_intersect("ha", "hb"))
    turned = F.col("ra") > F.col("rb")
    exact = cand.join(one, "a").join(two, "b").select(
        F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"), common.alias("c"), (F.size("ha") + F.size("hb")).alias("s"))
    # whole numbers decide: c / (s - c) >= threshold
    return exact.filter(F.col("c") >= F.lit(threshold) * (F.col("s") - F.col("c")) - F.lit(1e-9)).select("a", "b", "na", "nb", (F.col("c") / (F.col("s") - F.col("c"))).alias("similarity"))


def _blocks(copies: str) -> Column:
    """How many blocks a class of ``copies`` records has."""
    return F.ceil(F.col(copies) / F.lit(BLOCK)).cast("int")


def near_pairs(entities: DataFrame, threshold: float = 0.7, expand: int | None = None) -> DataFrame:
    """(entity_id_a, entity_id_b), smaller id first, of records whose word sets overlap by ``threshold`` or more."""
    member, whole = classes(word_sets(entities))
    links = class_links(whole, threshold).select("a", "b", "na", "nb")
    group = member.join(whole.select("ck", "rep", "copies"), "ck").select("entity_id", "rep", "copies")
    shown = group if expand is None else group.filter((F.col("copies") <= expand) | (F.col("entity_id") == F.col("rep")))
    salted = shown.withColumn("n", _blocks("copies")).withColumn("at", F.pmod(F.xxhash64("entity_id"), F.col("n")).cast("int"))
    # one row a block, so that no task has all members of a hot class
    block = salted.groupBy("rep", "at", "n").agg(F.collect_set("entity_id").alias("ids"))
    left = block.select(F.col("rep").alias("a"), F.col("at").alias("i"), F.col("ids").alias("xs"))
    right = block.select(F.col("rep").alias("b"), F.col("at").alias("j"), F.col("ids").alias("ys"))
    met = links.withColumn("i", F.explode(F.sequence(F.lit(0), _blocks("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), _blocks("nb") - 1)))
    across = met.join(left, ["a", "i"]).join(right, ["b", "j"]).select("xs", "ys", F.lit(False).alias("own"))
    # each block meets itself and the later ones of its class
    later = block.filter("n > 1 OR size(ids) > 1").select(F.col("rep").alias("b"), F.col("at").alias("i"), F.col("ids").alias("xs"), F.explode(F.sequence("at", F.col("n") - 1)).alias("j"))
    inside = later.join(right, ["b", "j"]).select("xs", "ys", (F.col("i") == F.col("j")).alias("own"))
    pairs = across.unionByName(inside).select("own", F.explode("xs").alias("x"), "ys").select("own", "x", F.explode("ys").alias("y")).filter("NOT own OR x < y").select("x", "y")
    if expand is not None:
        pairs = pairs.unionByName(group.filter((F.col("copies") > expand) & (F.col("entity_id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("entity_id").alias("y")))
    return pairs.select(F.least("x", "y").alias("entity_id_a"), F.greatest("x", "y").alias("entity_id_b")).distinct()


def near_classes(entities: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(entity_id, class_id, copies, links): each record's class of equal word sets and how many other classes are near it."""
    member, whole = classes(word_sets(entities))
    links = class_links(whole, threshold)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    group = member.join(whole.select("ck", "rep", "copies"), "ck").join(ends, "rep", "left")
    return group.select("entity_id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
