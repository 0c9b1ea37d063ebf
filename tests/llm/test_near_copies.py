import random
import re

import numpy as np

from plenum.llm import near_copies
from plenum.llm.own_text import with_own_description

SCHEMA = "entity_id string, canonical_name string, description string, aliases array<string>, a string, rep string"


def words(r):
    return frozenset(re.findall(r"[^\W_]+", " ".join([r[1] or "", r[2], *[x for x in r[3] or [] if x]]).lower()))


def records(n=260, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 4 == 0:
            base = rng.sample(vocabulary, 40)
        text = [w for w in base if rng.random() > 0.06] + rng.sample(vocabulary, rng.randrange(0, 6))
        out.append((f"e{i:04d}", f"Name{i // 4} Thing", " ".join(text), [None, f"alias{i // 4}"] if i % 3 else None, "x", "y"))
    return out


def brute(rows, t=0.7):
    sets = {r[0]: words(r) for r in rows}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def found(spark, rows, **kw):
    return {tuple(r) for r in near_copies.near_pairs(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_against_all_pairs(spark):
    rows = records()
    assert found(spark, rows) == brute(rows) and len(brute(rows)) > 100


def test_hot_nodes_lose_nothing(spark, monkeypatch):
    # few words, and one that begins a third of all sets: split by the next word, then cut into tiles
    rng = random.Random(4)
    rows = [(f"e{i:04d}", "Name", " ".join(["head"] * (i % 3 == 0) + rng.sample([f"w{k}" for k in range(14)], 10)), None, "x", "y") for i in range(300)]
    want = brute(rows)
    for hot, tile in ((20, 10), (60, 1000), (20, 1000)):
        monkeypatch.setattr(near_copies, "HOT", hot)
        monkeypatch.setattr(near_copies, "TILE", tile)
        assert found(spark, rows) == want
    monkeypatch.setattr(near_copies, "ROWS", 50)
    assert found(spark, rows) == want and len(want) > 1000


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(3)
    codes = np.repeat(rng.integers(0, 2**63, size=(300, 2), dtype=np.uint64), 10, axis=0)
    for _ in range(3):
        codes[:, rng.integers(2)] ^= np.uint64(1) << rng.integers(0, 64, len(codes)).astype(np.uint64)
    codes = codes[np.lexsort((codes[:, 1], codes[:, 0]))]
    n, gone = rng.integers(10, 18, len(codes)).astype(np.int64), rng.integers(0, 2, len(codes)).astype(np.int64)
    half = len(codes) // 2
    seen = []
    i, j = near_copies.trie_pairs(np.array([0, half]), np.array([half, len(codes)]), codes[:, 0], codes[:, 1], n, gone, 0.7, seen)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    bits = sum(np.bitwise_count(codes[:, None, w] ^ codes[None, :, w]).astype(int) for w in (0, 1))
    ok = bits + gone[:, None] + gone[None, :] <= np.floor(0.3 / 1.7 * (n[:, None] + n[None, :]) + 1e-9)
    side = np.arange(len(codes)) < half
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(ok & (side[:, None] == side[None, :]))) if a < b}
    assert got == want and len(want) > 1000
    # the budget prunes node pairs: fewer codes are compared than there are pairs
    met, pruned, compared = seen[0]
    assert pruned > 0 and compared < half * (half - 1)


def test_copies_expand_or_star(spark):
    rows = [(f"c{i:02d}", "Same Name", "one two three four five", None, "x", "y") for i in range(12)]
    every = {(f"c{i:02d}", f"c{j:02d}") for i in range(12) for j in range(i + 1, 12)}
    assert found(spark, rows) == every
    assert found(spark, rows, expand=5) == {("c00", f"c{i:02d}") for i in range(1, 12)}
    got = {r["entity_id"]: (r["class_id"], r["copies"], r["links"]) for r in near_copies.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {f"c{i:02d}": ("c00", 12, 0) for i in range(12)}


def test_large_class_of_different_texts(spark):
    # equal word sets in other orders, beside records near them: all pairs, in one block and in several
    text = "one two three four five six seven eight nine ten".split()
    rows = [(f"h{i:04d}", "Same Name", " ".join(text[i % 10 :] + text[: i % 10] + text[: i % 3]), None, "x", "y") for i in range(700)]
    rows += [(f"n{i}", "Same Name", " ".join(text + [f"extra{i}"]), ["Same"], "x", "y") for i in range(3)]
    ids = sorted(r[0] for r in rows)
    assert found(spark, rows) == brute(rows) == {(a, b) for a in ids for b in ids if a < b}


def test_no_description_of_its_own(spark):
    stock = "Text that stands at many records."
    rows = [(f"s{i}", f"Unlike{i} Person{i}", stock if i % 2 else stock.upper() + "  ", None, "x", "y") for i in range(6)]
    rows += [(f"p{i}", "Same Name", d, None, "x", "y") for i, d in enumerate([None, "", "  ", "N/A", "n/a ", "?", "See  above.", "TBD"])]
    rows += [("d1", "Same Name", "a real text", None, "x", "y"), ("d2", "Same Name", "a real  TEXT", [], "x", "y"), (None, "Same Name", "a real text", [], "x", "y")]
    assert found(spark, rows) == {("d1", "d2")}
    own = {r["entity_id"] for r in with_own_description(spark.createDataFrame(rows, SCHEMA)).filter("own_description IS NOT NULL AND entity_id IS NOT NULL").collect()}
    assert own == {"d1", "d2"}


def test_empty(spark):
    assert found(spark, []) == set()


def test_hot_words_of_a_batch_are_split_at_once(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    sets = [[7]] + [rng.sample(range(60), rng.randrange(1, 14)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["ck", "hashes"])
    o, hot = near_copies.Ordered(batch, None), np.zeros(near_copies.SLOTS, bool)
    hot[near_copies._slot(np.arange(30, dtype=np.uint64))] = True
    calls, mixed = [], near_copies._mixed
    monkeypatch.setattr(near_copies, "_mixed", lambda x: calls.append(1) or mixed(x))
    keys, places = near_copies._below(o, hot, 0.7)
    assert len(calls) <= 3
    want = []
    for i in range(len(o.h)):
        r = o.row[i]
        if o.pos[i] < near_copies.first_words(o.n[r : r + 1], 0.7)[0] and hot[near_copies._slot(o.h[i : i + 1])[0]]:
            others = [j for j in range(o.starts[r], o.starts[r] + near_copies.first_words(o.n[r : r + 1], 0.7, 1)[0]) if j != i]
            want += [(int(mixed(o.h[i : i + 1] * np.uint64(0x9E3779B97F4A7C15) + o.h[j : j + 1])[0]), i) for j in others] or [(int(o.h[i]), i)]
    assert list(zip(keys.tolist(), places.tolist())) == want and len(want) > 400


def test_records_of_unlike_sizes_or_places_are_not_compared(monkeypatch):
    import pyarrow as pa

    # a stock word's node: most records have used up much of their budget before it
    rng = np.random.default_rng(5)
    n, gone = rng.integers(20, 61, 3000), rng.integers(2, 11, 3000)
    codes = np.zeros((3000, 2), np.uint64)
    for i, many in enumerate(n - gone):
        for word in rng.choice(90, many, replace=False):
            codes[i, word // 64] ^= np.uint64(1) << np.uint64(word % 64)
    codes[1::2], n[1::2], gone[1::2] = codes[::2], n[::2], gone[::2] // 2
    codes[1::2, 0] ^= np.uint64(1) << rng.integers(0, 60, 1500).astype(np.uint64)
    n[1::2] += gone[1::2] - gone[::2] + np.where(np.bitwise_count(codes[1::2, 0]) > np.bitwise_count(codes[::2, 0]), 1, -1)
    table = pa.table({"node": np.full(3000, 7), "ck": np.arange(3000), "n": n.astype("i4"), "gone": gone.astype("i4"), "c0": codes[:, 0].view(np.int64), "c1": codes[:, 1].view(np.int64), "tile": np.full(3000, -1, "i4")})
    seen, whole = [], near_copies.trie_pairs
    monkeypatch.setattr(near_copies, "trie_pairs", lambda *a: whole(*a[:7], seen, *a[8:]))
    got = {tuple(sorted(p)) for b in near_copies._joined(0.7)(table.to_batches()) for p in zip(*(b.column(k).to_pylist() for k in (0, 1)))}
    bits = sum(np.bitwise_count(codes[:, None, w] ^ codes[None, :, w]).astype(int) for w in (0, 1))
    ok = bits + gone[:, None] + gone[None, :] <= np.floor(0.3 / 1.7 * (n[:, None] + n[None, :]) + 1e-9)
    ok &= np.minimum(n[:, None], n[None, :]) >= 0.7 * np.maximum(n[:, None], n[None, :]) - 1e-9
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(ok)) if a < b} and len(got) > 100
    assert sum(s[2] for s in seen) < 0.3 * 3000 * 2999 / 2


def test_pairs_left_on_the_shelves_of_a_node():
    rng = np.random.default_rng(6)
    size, gone = rng.integers(5, 30, 400), rng.integers(0, 5, 400)
    of, n = np.unique(np.stack([size, gone]), axis=1, return_counts=True)
    ok = (0.3 / 1.7 * (size[:, None] + size) - gone[:, None] - gone + 1e-6 >= abs((size - gone)[:, None] - (size - gone))) & (np.minimum(size[:, None], size) >= 0.7 * np.maximum(size[:, None], size) - 1e-9)
    assert near_copies._left(of[0], of[1], n, 0.7) == ok.sum() / 2 and 0 < ok.sum() < 400 * 400
