import pytest

from plenum.llm import mixing


def test_quotas():
    assert mixing.quotas({"a": (0.5, 100, 1), "b": (0.5, 10, 2)}) == {"a": 20.0, "b": 20.0}
    assert mixing.quotas({"a": (0.5, 100, 1), "none": (0.5, 0, 9)}) == {"a": 100.0}
    filled = mixing.quotas({"a": (0.5, 100, 1), "b": (0.5, 10, 2)}, total=100)
    assert filled == {"b": 20, "a": 80}
    assert mixing.quotas({}) == {} and mixing.quotas({"a": (None, 5, 1), "b": (0.5, 5, 0)}) == {}


def data(spark, n=300):
    docs = [(i, "word " * (3 + i % 5), "big" if i % 3 else "small", i) for i in range(n)] + [(900, None, "big", 0), (901, "", "small", 0), (902, "x", None, 0), (903, "x", "other", 0), (None, "x", "big", 0)]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 5), (None, 0.1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, block long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, targets = data(spark)
    rows = mixing.mixture(docs, targets, block=32).collect()
    used: dict[int, int] = {}
    for r in rows:
        used[r["doc_id"]] = used.get(r["doc_id"], 0) + 1
    small = {i for i in range(300) if i % 3 == 0}
    assert all(n <= (3 if d in small else 1) for d, n in used.items()) and not set(used) & {900, 901, 902, 903}
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    by = {r["source"]: r for r in mixing.shares(docs, targets, block=32).collect()}
    assert by["big"]["actual_share"] == pytest.approx(0.5 / 0.9, abs=0.02) and by["small"]["actual_share"] == pytest.approx(0.4 / 0.9, abs=0.02)
    assert by["absent"]["used"] == 0 and sum(r["actual_share"] for r in by.values()) == pytest.approx(1)


def test_schedule_is_even(spark):
    docs, targets = data(spark, 1500)
    rows = sorted(mixing.mixture(docs, targets, block=32).collect(), key=lambda r: (r["slot"], r["place"]))
    total = sum(r["n_tokens"] for r in rows)
    for part in (0.25, 0.5, 0.75):
        seen, big = 0, 0
        for r in rows:
            seen += r["n_tokens"]
            big += r["n_tokens"] * (r["source"] == "big")
            if seen >= part * total:
                break
        assert big / seen == pytest.approx(0.5 / 0.9, abs=0.05)


def test_empty(spark):
    docs, targets = data(spark, 3)
    assert mixing.mixture(docs.limit(0), targets).count() == 0 and mixing.mixture(docs, targets.limit(0)).count() == 0
    assert mixing.shares(docs.limit(0), targets).count() == 3
