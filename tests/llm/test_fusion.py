import datetime as dt
import random

import pytest

from plenum.llm import fusion

SCHEMA = "entity_id string, canonical_name string, description string, confidence double, source string, updated_at timestamp, aliases array<string>, value string, pref string"
T = dt.datetime(2024, 1, 1)


def run(spark, rows, groups, **kw):
    r = spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)
    g = spark.createDataFrame(groups, "entity_id string, group_id string")
    return {(x["group_id"], x["field_name"]): x["entity_id"] for x in fusion.fuse(r, g, **kw).collect()}, r, g


ROWS = [
    ("a", "N", "short text", 0.9, "s1", T, ["x", " "]), ("b", "N", "a longer  text", 1.5, "s2", T, ["x", "y"]), ("c", "N", "a longer text", 0.9, "s1", T + dt.timedelta(1), None),
    ("d", "N", None, None, None, None, []), ("e", "N", "?", float("nan"), None, T, [None]), ("alone", "N", "text", 0.5, "s1", T, []),
]
GROUPS = [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("alone", "alone"), ("gone", "alone"), ("nowhere", "z")]


def test_stated_preference(spark):
    got, r, g = run(spark, ROWS, GROUPS, strict=True)
    # of the equally long texts the one with a usable confidence; of the equal confidences the later one
    assert got == {("a", "description"): "c", ("a", "confidence"): "c"}
    rec = fusion.fused_records(r, g).collect()
    assert [(x["group_id"], x["description"], x["confidence"]) for x in rec] == [("a", "a longer text", 0.9)]
    assert {(x["alias"], x["n_records"]) for x in fusion.group_aliases(r, g).collect()} == {("x", 2), ("y", 1)}


def test_copied_votes_count_less(spark):
    rows, groups = [], []
    # s3 repeats s2 word for word, also where both are wrong; s1, s4 and s5 agree independently
    for i in range(30):
        wrong = i % 2 == 0
        for s in ("s1", "s4", "s5", "s2", "s3"):
            text = f"item {i} false text" if wrong and s in ("s2", "s3") else f"item {i} right text"
            rows.append((f"{i:02d}{s}", "N", text, None, s, T, None))
            groups.append((f"{i:02d}{s}", f"{i:02d}s1"))
    rows.append(("98a", "N", "copied longer claim", None, "s2", T, None))
    rows.append(("98b", "N", "copied longer claim", None, "s3", T, None))
    rows.append(("98c", "N", "trusted", None, "s1", T, None))
    groups += [(x, "98a") for x in ("98a", "98b", "98c")]
    got, *_ = run(spark, rows, groups, prior=0.0)
    assert all(got[(f"{i:02d}s1", "description")][2:] in ("s1", "s4", "s5") for i in range(0, 30, 2))
    assert got[("98a", "description")] == "98c"
    strict, *_ = run(spark, rows, groups, strict=True)
    assert strict[("98a", "description")] == "98a"


def test_empty(spark):
    assert run(spark, [], [])[0] == {}


def planted(n=150, seed=5):
    """Two sources that are mostly right, one that is mostly wrong, and two that copy its values, false ones included."""
    rng = random.Random(seed)
    rows, groups, truth = [], [], {}
    for i in range(n):
        right = rng.randrange(5, 60) / 100
        wrong = lambda: rng.randrange(61, 100) / 100
        bad = right if rng.random() < 0.3 else wrong()
        said = {"a": right if rng.random() < 0.9 else wrong(), "b": right if rng.random() < 0.85 else wrong(), "c": bad, "d": bad if rng.random() < 0.95 else wrong(), "e": bad if rng.random() < 0.95 else wrong()}
        truth[f"g{i}"] = right
        for s, v in said.items():
            names = ["True Name", "True   name"] if s in "ab" else ["False Name"] if bad != right else []
            rows.append((f"{i}{s}", f"N{i}", None, v, s, T, names, None, None))
            groups.append((f"{i}{s}", f"g{i}"))
    return rows, groups, truth


@pytest.mark.xfail(strict=True, reason="known limit: where copiers are the majority, their false values are accepted first and no longer speak for copying")
def test_copied_votes_are_discounted(spark):
    rows, groups, truth = planted()
    r, g = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(groups, "entity_id string, group_id string")
    got = {x["group_id"]: float(x["value"]) for x in fusion.fuse(r, g, prior=0.0).collect()}
    said: dict[str, list[float]] = {}
    for (e, gid), row in zip(groups, rows):
        said.setdefault(gid, []).append(row[3])
    score = lambda chosen: sum(abs(chosen[k] - v) < 1e-9 for k, v in truth.items()) / len(truth)
    majority = score({k: max(v, key=v.count) for k, v in said.items()})
    assert score(got) > 0.85 > majority + 0.1
    _, accuracy, dep = fusion._fused(r, g, 0.0, False)
    pairs = {(x["s"], x["t"]): x["dep"] for x in dep.collect()}
    assert min(pairs["c", "d"], pairs["c", "e"]) > 0.9 > 0.1 > pairs["a", "b"]
    alias = {x["alias"]: x for x in fusion.fused_aliases(r, g, 0.0).filter("group_id = 'g0' OR group_id = 'g1'").collect()}
    assert alias["true name"]["accepted"] and (alias.get("false name") is None or not alias["false name"]["accepted"])
