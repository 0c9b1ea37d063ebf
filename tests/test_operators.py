import datetime as dt

import pytest
from pyspark.sql import functions as F

from plenum.operators import dedup, graph, searching, speakers, store, transcript, usage

FLAT = "session_id string, agenda_item_index int, speech_block_index int, sentence_index int, sentence_id long, speaker_name_original string, topic_title string, full_text string, timestamp_seconds long, video_id string"


def flat(spark, n, item=0):
    return spark.createDataFrame([("s", item, i // 3, i % 3, i, f"p{i // 3}", "t", f"x{i}", i, "v") for i in range(n)], FLAT)


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 8, 12, 23])
def test_chunks_equal_slices(spark, n):
    got: dict[int, list[int]] = {}
    for r in transcript.chunk_members(transcript.numbered(flat(spark, n))).orderBy("chunk_index", "local_index").collect():
        got.setdefault(r["chunk_index"], []).append(r["sentence_id"])
        assert r["local_index"] == len(got[r["chunk_index"]]) - 1
    assert list(got.values()) == [list(range(n))[i : i + 7] for i in range(0, n, 5)]


def test_chunk_context_and_texts(spark):
    rows = transcript.chunks(transcript.numbered(flat(spark, 8))).orderBy("chunk_index").collect()
    assert rows[0]["context_speakers"] == "" and rows[1]["context_speakers"] == "p0, p1, p2"
    assert transcript.agenda_text(flat(spark, 4)).first()["agenda_text"] == "p0: x0 x1 x2\n\np1: x3"


def test_unique_rows(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 2)), (1, "a", dt.datetime(2024, 1, 1)), (None, "b", None)], "k int, v string, created_at timestamp")
    assert [tuple(r) for r in transcript.unique_rows(df, "k").collect()] == [(1, "a", dt.datetime(2024, 1, 1))]


def test_recent_entities(spark):
    rows = [("s", 0, c, i, e) for c, i, e in [(0, 0, "b"), (0, 1, "a"), (0, 2, "b"), (1, 0, "b"), (1, 3, "c"), (2, 0, "a")]]
    df = spark.createDataFrame(rows, "session_id string, agenda_item_index int, chunk_index int, local_index int, entity_id string")
    got = lambda **k: {r["chunk_index"]: r["recent"] for r in transcript.recent_entities(df, **k).collect()}
    assert got() == {0: "", 1: "b,a", 2: "b,a,b,c"} and got(keep=2) == {0: "", 1: "b,a", 2: "b,c"}
    assert transcript.recent_entities(df.limit(0)).count() == 0


def registry(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("1", "Jonathan Smithson", "Minister of Health", t), ("2", "Jonathan Smithsen", "Clerk", t), ("3", "Mary Brown", "Minister of Finance", t), ("4", "Ann Unique", None, t)], "canonical_id string, name string, role string, created_at timestamp")


@pytest.mark.parametrize("name, role, want", [
    ("Hon. Mary Brown", None, ("3", "exact")), ("Mary Browne", None, ("3", "fuzzy")), ("Jonathan Smithsan", None, (None, None)),
    ("Jonathan Smithsan", "Minister of Health", ("1", "fuzzy")), ("Z Brown", "Minister of Finance", ("3", "surname")), ("Z Brown", None, (None, None)), ("Zed", "Clerk", (None, None))])
def test_speaker_match(spark, name, role, want):
    q = spark.createDataFrame([(name, role), (None, None)], "name string, role string")
    rows = speakers.match(q, registry(spark)).collect()
    assert [(r["canonical_id"], r["stage"]) for r in rows] == [want]


def test_newcomers_collapse(spark):
    q = spark.createDataFrame([("Dr. New One", None), ("new one", None)], "name string, role string")
    assert speakers.newcomers(speakers.match(q, registry(spark))).count() == 1


def test_candidates_against_all_pairs(spark, small):
    import numpy as np

    from plenum.operators.fuzzy import ratio

    e = spark.read.parquet(f"{small}/entities.parquet").limit(150).withColumn("entity_type", F.lit("x")).cache()
    rows = sorted(e.collect(), key=lambda r: (r["created_at"], r["entity_id"]))
    unit = lambda v: None if v is None or len(v) != 768 or not any(v) else np.array(v) / np.linalg.norm(v)
    vec, want = [unit(r["embedding"]) for r in rows], set()
    names = [[x.lower() for x in [r["canonical_name"], r["name"], *(r["aliases"] or [])] if x is not None] for r in rows]
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            v = 0.0 if vec[i] is None or vec[j] is None else float(vec[i] @ vec[j])
            f = max(ratio(a, b) for a in names[i] for b in names[j]) / 100
            if f >= 0.85 or v >= 0.85 or 0.3 * f + 0.7 * v >= 0.8:
                want.add((rows[i]["entity_id"], rows[j]["entity_id"]))
    for tile in (2000, 40):
        dedup.TILE = tile
        assert {(r["keep_id"], r["merge_id"]) for r in dedup.candidates(e).collect()} == want
    dedup.TILE = 2000


def groups_of(rows):
    up: dict[str, str] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in rows:
        if a is not None and b is not None:
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_are_never_lost(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(f"{rng.randrange(90):02d}", f"{rng.randrange(90):02d}") for _ in range(70)] + [("x", "x"), (None, "y"), ("z", None)] + [("hub", f"h{i}") for i in range(40)]
    chain = [(f"e{i:03d}", f"e{i + 1:03d}") for i in range(40)]
    rng.shuffle(chain)
    df = spark.createDataFrame(rows + chain, "a string, b string")
    want = groups_of(rows + chain)
    assert {r["id"]: r["group"] for r in dedup.linked(df, "a", "b").collect()} == {x: g for x, g in want.items() if x != g}
    assert dedup.linked(df.limit(0), "a", "b").count() == 0


def test_oldest_survives(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    e = spark.createDataFrame([("a", t(3)), ("b", t(1)), ("c", t(2)), ("d", t(1))], "entity_id string, created_at timestamp")
    # a-c and b-c share c only: one group; d and b are equally old; ghost has no record
    pairs = spark.createDataFrame([("a", "c"), ("c", "b"), ("d", "b"), ("ghost", "a"), ("g2", "g1")], "x string, y string")
    assert {tuple(r) for r in dedup.survivors(pairs, "x", "y", e).collect()} == {("a", "b"), ("c", "b"), ("d", "b"), ("ghost", "b"), ("g2", "g1")}


def test_marks_and_chains(spark):
    e = spark.createDataFrame([("a", '{"run": 1}'), ("b", None), ("c", "broken")], "entity_id string, meta_data string")
    m = spark.createDataFrame([("b", "a"), ("c", "b")], "old_id string, root_id string")
    told = dedup.marked(e, m)
    assert {(r["old_id"], r["new_id"]) for r in dedup.stored_map(told).collect()} == {("b", "a"), ("c", "b")}
    assert {(r["old_id"], r["root_id"]) for r in dedup.roots(dedup.stored_map(told)).collect()} == {("b", "a"), ("c", "a")}
    assert told.filter("entity_id = 'a'").first()["meta_data"] == '{"run": 1}'


def test_merge_and_remap(spark):
    t = dt.datetime(2024, 1, 1)
    late = dt.datetime(2024, 2, 1)
    e = spark.createDataFrame([("a", "A", "short", ["x"], 0.4, 0.1, t, '{"k": 1, "own": "y"}'), ("b", "B", "much longer", None, float("nan"), 0.9, late, '{"k": 2}'), ("c", "C", None, [], None, 0.2, t, None)],
                              "entity_id string, canonical_name string, description string, aliases array<string>, confidence double, importance_score double, created_at timestamp, meta_data string")
    roots = spark.createDataFrame([("b", "a")], "old_id string, root_id string")
    got = {r["entity_id"]: r for r in dedup.merged(e, roots).collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"]["description"], got["a"]["confidence"], got["a"]["importance_score"], got["a"]["aliases"], got["a"]["merged_ids"]) == ("much longer", 0.4, 0.9, "B|x", "b")
    assert (got["a"]["canonical_name"], got["a"]["meta_data"], got["c"]["meta_data"]) == ("A", "k=2|own=y", "")
    said = spark.createDataFrame([("a", "New", None), ("c", None, ["p", "q"])], "keep_id string, merged_name string, merged_aliases array<string>")
    named = {r["entity_id"]: (r["canonical_name"], r["aliases"]) for r in dedup.renamed(dedup.merged(e, roots), said).collect()}
    assert named == {"a": ("New", "A|B|x"), "c": ("C", "p|q")}
    edges = spark.createDataFrame([(1, "b", "c", 0.5), (2, "a", "c", 0.9), (3, "b", "b", 0.1)], "i int, s string, t string, w double")
    led = dedup.remapped(edges, roots, ["s", "t"])
    assert {r["i"]: r["updates"] for r in led.collect()} == {1: 1, 2: 0, 3: 2}
    assert {r["i"] for r in dedup.unique_edges(led, ["s", "t"], "w", "i").collect()} == {2, 3}


def test_graph_rules(spark):
    keys = "session_id string, agenda_item_index int, chunk_index int"
    ents = spark.createDataFrame([("s", 0, 0, "e1"), ("s", 0, 0, "e2")], f"{keys}, entity_id string")
    who = spark.createDataFrame([("s", 0, 0, ["Ann"])], f"{keys}, speakers array<string>")
    rel = [("e1", "e2", "supports", "neutral", 0.5), ("Ann", "e2", "supports", "neutral", None), ("Bob", "e2", "supports", "neutral", 0.5), ("e1", "Ann", "supports", "neutral", 0.5), ("e1", "e2", "likes", "neutral", 0.5), ("e1", "e2", "supports", "happy", 0.5), ("e1", "e2", "supports", "neutral", 1.5), (None, "e2", "supports", "neutral", 0.5)]
    df = spark.createDataFrame([("s", 0, 0, *r) for r in rel], f"{keys}, source_id string, target_id string, relation_type string, sentiment string, confidence double")
    got = sorted(str(r["reason"]) for r in graph.rejected(df, ents, who).collect())
    assert got == sorted(["None", "None", "unknown source", "unknown source", "unknown target", "relation type", "sentiment", "confidence"])


def test_location_is_block_local(spark):
    placed = transcript.numbered(flat(spark, 12))
    found = spark.createDataFrame([("s", 0, 1, 2, "e"), ("s", 0, 0, 7 - 0, "e"), ("s", 0, 9, 9, "gone")], "session_id string, agenda_item_index int, chunk_index int, local_index int, entity_id string")
    got = graph.mentions(found, placed).collect()
    assert [(r["speech_block_index"], r["sentence_index"], r["sentence_id"]) for r in got] == [(2, 1, 7)]


def test_nodes_and_upsert(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", None)], "source_id string, target_id string")
    nodes = spark.createDataFrame([("a",)], "entity_id string")
    assert [tuple(r) for r in graph.ensure_nodes(edges, nodes).collect()] == [("b", "b", "unknown")]
    old = spark.createDataFrame([("a", "A", "law", ["x"])], "entity_id string, canonical_name string, entity_type string, aliases array<string>")
    new = spark.createDataFrame([("a", "Z", "law", ["y"], 1), ("n", "N2", "law", None, 2), ("n", "N1", "law", None, 1)], "entity_id string, canonical_name string, entity_type string, aliases array<string>, seen int")
    got = {r["entity_id"]: tuple(r)[1:] for r in graph.upserted(old, new).collect()}
    assert got == {"a": ("A", "law", False, "x|y"), "n": ("N1", "law", True, "")}


def test_store(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", 1, t)], "k string, v int, created_at timestamp")
    new = spark.createDataFrame([("a", 9, t), ("b", 2, t), ("b", 2, t), (None, 3, t)], "k string, v int, created_at timestamp")
    assert [(r["k"], r["v"]) for r in store.insert_absent(old, new, "k").collect()] == [("b", 2)]
    assert [(r["k"], r["v"]) for r in store.updated(old, new.filter("v = 9").select("k", "v"), "k").collect()] == [("a", 9)]
    tables = {n: spark.createDataFrame([("s1", 1), ("s2", 2), (None, 3)], "session_id string, x int") for n in ("sessions", "mentions", "relationships", "entities")}
    left = store.delete_sessions(tables, spark.createDataFrame([("s1",)], "session_id string"))
    assert {n: (d.count(), d.filter("session_id IS NOT NULL").count()) for n, d in left.items()} == {"sessions": (2, 1), "mentions": (2, 1), "relationships": (3, 1), "entities": (3, 2)}
    path = str(tmp_path / "t")
    for rows in ([("s1", 1), ("s2", 2)], [("s1", 5)]):
        store.write_sessions(spark.createDataFrame(rows, "session_id string, x int"), path)
    assert sorted((r["session_id"], r["x"]) for r in spark.read.parquet(path).collect()) == [("s1", 5), ("s2", 2)]
    store.create_tables(spark, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all/entities")).schema["embedding"].dataType.simpleString() == "array<float>"


def test_usage(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, "u", t + dt.timedelta(seconds=30 * i), 1.5) for i in range(4)] + [(9, None, None, None)], "event_id int, who string, at timestamp, ms double")
    got = [r["in_window"] for r in usage.rate_window(log, "at", "who", "event_id", 60, 2).orderBy("event_id").collect()]
    assert got == [1, 2, 3, 3]
    assert {r["stage"]: (r["calls"], r["total"]) for r in usage.rollup(log, {"stage": "who"}, "ms").collect()} == {"u": (4, 6.0), None: (1, None)}
    tokens = usage.rollup(log, {"stage": "who", "model": "'m'"}, "ms", {"prompt_tokens": "event_id", "total_tokens": "event_id + 5"}).collect()
    assert {(r["stage"], r["model"], r["prompt_tokens"], r["total_tokens"]) for r in tokens} == {("u", "m", 6, 26), (None, "m", 9, 14)}
    done = spark.createDataFrame([("success",), ("failed",), (None,)], "status string")
    assert tuple(usage.successes(done, "status").first()) == (3, 1, 2)


def test_nearest(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [2.0, 0.0])]
    e = spark.createDataFrame(rows, "i long, v array<float>")
    got = [(r["i"], r["place"]) for r in searching.nearest(e, e.filter("i = 1"), "i", "v", 2, 3).orderBy("place").collect()]
    assert got == [(1, 1), (7, 2), (3, 3)]
    assert searching.nearest(e, e.filter("i = 5"), "i", "v", 2).count() == 0
    assert searching.postings(spark.createDataFrame([(1, "a water water")], "i int, t string"), "i", "t").first()["positions"] == [2, 3]


def test_batches_by_position(spark):
    ids = [3 * i + i % 2 for i in range(257)]
    got = {r["k"]: r["batch"] for r in store.batches(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 100).collect()}
    assert got == {k: n // 100 for n, k in enumerate(sorted(ids))}
    assert store.batches(spark.createDataFrame([], "k long"), "k", 100).count() == 0


def test_lookups_and_order(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", 1, dt.datetime(2024, 1, 1)), ("c", None, dt.datetime(2023, 1, 1))], "k string, v int, created_at timestamp")
    assert [r["k"] for r in searching.lookup(df, v=1, k="a").collect()] == ["a"] and [r["k"] for r in searching.lookup(df, v=None).collect()] == ["c"]
    assert [r["k"] for r in store.by_age(df, "k").collect()] == ["b", "c", "a"]


def test_registry_after(spark):
    t = dt.datetime(2024, 1, 1)
    reg = spark.createDataFrame([("p", "Ann", None, "Clerk", ["s1"], t, t)], "canonical_id string, name string, title string, role string, session_ids array<string>, created_at timestamp, updated_at timestamp").withColumns({"party": F.lit(""), "chamber": F.lit(None).cast("string")})
    late = dt.datetime(2024, 3, 1)
    met = spark.createDataFrame([("p", "ANN", "Dr.", "Minister", "Tide", None, "s2", late), ("p", "Ann", None, None, None, "house", "s1", t), ("new", "Bo", None, None, None, "house", "s2", late), (None, "x", None, None, None, None, "s2", t)],
                                "canonical_id string, name string, title string, role string, party string, chamber string, session_id string, at timestamp")
    got = {r["canonical_id"]: r for r in speakers.registry_after(reg, met).collect()}
    assert set(got) == {"p", "new"} and (got["new"]["name"], got["new"]["session_ids"], got["new"]["chamber"]) == ("Bo", ["s2"], "house")
    p = got["p"]
    assert (p["name"], p["title"], p["role"], p["party"], p["chamber"], sorted(p["session_ids"]), p["updated_at"]) == ("Ann", "Dr.", "Clerk", "Tide", "house", ["s1", "s2"], late)


def test_search_ranks_by_nearness(spark):
    docs = spark.createDataFrame([(1, "water prices and cleaner"), (2, "clean waters; the price"), (3, "clean water"), (4, None), (5, "water " * 3 + "x " * 200 + "price clean")], "i int, t string")
    got = [(r["i"], r["rank"]) for r in searching.keyword(docs, "i", "t", "the water price").collect()]
    assert [i for i, _ in got] == [1, 2, 5] and got[0][1] > got[1][1] > 0 and got[2][1] == 0
    assert [r["i"] for r in searching.keyword(docs, "i", "t", "watering").collect()] == [5, 1, 2, 3]
    assert searching.keyword(docs, "i", "t", "the").count() == 0
    assert searching.text_vectors(docs, "t").orderBy("i").collect()[1]["search_vector"] == "'clean':1 'price':4 'water':2"


def test_provenance(spark):
    e = spark.createDataFrame([("s1", "v", 5, "a", "b"), ("s1", "v", 50, "a", "c"), ("s1", "w", None, "a", "d"), ("s0", "v", 7, "a", "e")], "session_id string, video_id string, evidence_timestamp_seconds int, source_id string, target_id string")
    got = lambda **k: [r["target_id"] for r in graph.provenance(e, **k).collect()]
    assert got() == ["e", "b", "c", "d"] and got(session="s1", video="v", first=6) == ["c"] and got(last=7) == ["e", "b"]


def test_ratios_of_a_block_are_those_of_its_pairs():
    import random

    from plenum.operators.fuzzy import ratio, ratios

    r = random.Random(1)
    text = lambda: "".join(r.choice("abcde éß\U0001F600\0") for _ in range(r.randrange(80)))
    a, b = ([None, "x" * 64, "", *(text() for _ in range(3000))] for _ in range(2))
    assert ratios(a, b) == [None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)]


def test_alike_scores_few_pairs_and_loses_none():
    import random

    from plenum.operators.fuzzy import alike, ratio

    r = random.Random(2)
    word = lambda n: "".join(r.choice("abdeilmnorst") for _ in range(n))
    a = [f"{word(8)} {k}" for k in ("harbour model", "bay", "ferry subsidy stance", "é\U0001F600 " + "long " * 12) for _ in range(150)] + ["", "\0", "x" * 64, "x" * 65, "x" * 70]
    b = [x[:4] + x[5:] for x in a[::3]] + [x + "q" for x in a[1::7]] + a[::11]
    want = {(x, y): ratio(x, y) for x in set(a) for y in set(b) if ratio(x, y) >= 85}
    i, j, q = alike(a, b, 85)
    assert {(a[x], b[y]): z for x, y, z in zip(i, j, q.tolist())} == want and len(want) > 1000
    seen = []
    i, j, q = alike(a, None, 85, seen)
    assert {(min(x, y), max(x, y)): z for x, y, z in zip(i.tolist(), j.tolist(), q.tolist())} == {(x, y): ratio(a[x], a[y]) for x in range(len(a)) for y in range(x + 1, len(a)) if ratio(a[x], a[y]) >= 85}
    # the counts of letters leave few others than pairs of one long phrase
    assert sum(seen) < 0.15 * len(a) ** 2 / 2 and all(len(p) == 0 for p in alike([], None, 85))


def test_candidates_scores_of_odd_vectors_and_names(spark):
    import numpy as np

    from plenum.operators.fuzzy import ratio

    rng = np.random.default_rng(4)
    vecs = [None, [0.0] * 8, [1.0] * 7] + [(rng.integers(1, 9, 8) / 512 if i % 2 else rng.random(8) * 10.0 ** rng.integers(-20, 20)).astype("f4").tolist() for i in range(60)]
    rows = [(f"e{i:02d}", "t", None if i % 9 == 0 else f"name {i % 5}", None, None if i % 3 else ["", None, "Shared Alias"], v) for i, v in enumerate(vecs)]
    e = spark.createDataFrame(rows + rows[5:6] + [("u0", "u", None, None, None, None)], "entity_id string, entity_type string, canonical_name string, name string, aliases array<string>, embedding array<float>").withColumn("created_at", F.lit(None).cast("timestamp"))
    want = {}
    unit = [None if v is None or len(v) != 8 or not any(v) else np.array(v) / np.linalg.norm(v) for v in vecs]
    names = [[x.lower() for x in [r[2], *(r[4] or [])] if x is not None] for r in rows]
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            v = 0.0 if unit[i] is None or unit[j] is None else float(unit[i] @ unit[j])
            f = max([0, *(ratio(a, b) for a in names[i] for b in names[j])]) / 100
            if f >= 0.85 or v >= 0.85 or 0.3 * f + 0.7 * v >= 0.8:
                want[rows[i][0], rows[j][0]] = (round(v, 4), round(0.3 * f + 0.7 * v, 4))
    for tile in (2000, 10):
        before, dedup.TILE = dedup.TILE, tile
        got = dedup.candidates(e, 8).collect()
        dedup.TILE = before
        assert {(r["keep_id"], r["merge_id"]): (r["vector"], r["hybrid"]) for r in got} == want and len(got) == len(want) > 500
    assert dedup.candidates(e.limit(0), 8).count() == 0


def test_ranked_is_in_order_and_computes_its_pairs_once(spark):
    import numpy as np

    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    score = [float(x) for x in np.round(np.random.default_rng(1).choice([1.0, 0.3, 0.25, -0.4], 900) - np.random.default_rng(2).random(900) * 0.2, 4)] + [float("nan"), None, 1.0, 0.36, 0.2, -0.7]
    rows = [(f"k{i % 40:03d}", f"m{i:04d}", s) for i, s in enumerate(score)] + [(f"k{i % 40:03d}", f"m{i:04d}", 0.3) for i in range(2000, 2100)]
    df = spark.createDataFrame(rows, "keep_id string, merge_id string, hybrid double")
    got = [tuple(r) for r in dedup.ranked(df.mapInArrow(counted, df.schema)).collect()]
    key = lambda r: (2 if r[2] is None else 0 if np.isnan(r[2]) else 1, -(r[2] or 0) if r[2] == r[2] else 0, r[0], r[1])
    assert [(*r[:2], str(r[2])) for r in got] == [(*r[:2], str(r[2])) for r in sorted(rows, key=key)] and met.value == len(rows)
