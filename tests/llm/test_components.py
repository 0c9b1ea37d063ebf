import random

from plenum.llm.components import connected_components


def groups(rows):
    parent: dict[str, str] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


def check(spark, rows):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "p string, q string, u string, v string")
    assert {r["entity_id"]: r["group_id"] for r in connected_components(df, "p", "q").collect()} == groups(rows)


def test_chain_hub_and_dirt(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    random.Random(1).shuffle(chain)
    hub = [("hub", f"h{i:04d}") for i in range(600)]
    check(spark, chain + [(b, a) for a, b in chain[:9]] + hub + [("x", "x"), ("y", None), (None, "z"), (None, None), ("m", "n"), ("m", "n")])


def test_random(spark):
    rng = random.Random(2)
    check(spark, [(f"{rng.randrange(120)}", f"{rng.randrange(120)}") for _ in range(90)])


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "p string, q string"), "p", "q").count() == 0
