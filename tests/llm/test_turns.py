import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import turns

from .test_names import T, speakers

SENT = "sentence_id long, block_id long, session_id string, video_id string, agenda_item_index int, speech_block_index int, sentence_index int, start_time string, text string, created_at timestamp, who string, form string"


@pytest.mark.parametrize("text, want", [
    ("9m9s", 549), ("1h0m0s", 3600), ("00:01:05", 65), ("0h 0m 10s", 10), ("0M10S", 10), ("[0m11s]", 11), ("0m11.9s", 11), ("2:03", 123), ("12s", 12), ("--", None), ("n/a", None), ("", None), (None, None)])
def test_seconds(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(turns.seconds(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text, want", [
    ("[00:01:54] Um, the port [applause] authority (laughter) will erm... act.", "the port authority will act."), ("Ah, um — ♪ ♪", ""), ("[inaudible 00:12]", ""), ("-- interruption --", ""), ("*coughs* {bell rings} <noise>", ""),
    ("00:05:24 - The committee (Taneskers 622) met, you know, today.", "The committee (Taneskers 622) met, today."), ("The umbrella of the era.", "The umbrella of the era."), ("", "")])
def test_clean(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(turns.clean(F.col("t"))).first()[0] == want


def made(spark, rows, labels):
    """rows: (block, sentence, time, text) of one item; ids follow the rows."""
    s = spark.createDataFrame([(i, b, "s1", "v", 0, b, n, t, x, T, "c", "c") for i, (b, n, t, x) in enumerate(rows)], SENT)
    b = spark.createDataFrame([(i, "s1", x, T) for i, x in labels.items()], "block_id long, session_id string, speaker_name string, created_at timestamp")
    people = speakers(spark, [("r1", "Theodore Cashanan", ["Theo Cashanan"], ["s1"]), ("r2", "Odessa Tafimoft", None, ["s1"])])
    return s, b, people


def ends(spark, rows, labels):
    return sorted(tuple(r) for r in turns.turn_ends(*made(spark, rows, labels)).collect())


def test_turns(spark):
    rows = [
        (0, 0, "0m1s", "Order."), (1, 0, "0m5s", "First."), (1, 1, "--", "Second."), (2, 0, "0m9s", "(laughter)"), (3, 0, "0m10s", "Third."), (4, 0, "0m20s", "Fourth."),
        (4, 1, "0m25s", "Mr. Speaker: Order again."), (4, 2, "0m26s", ">> Odessa Tafimoft: My answer is this: no."), (5, 0, "0m30s", "Let me say: more."), (6, 0, "0m40s", "x"), (7, 0, "0m41s", "y"), (8, 0, "0m42s", "z"), (9, 0, "0m43s", "late"), (5, 0, "0m2s", None)]
    labels = {0: "Mr Speaker", 1: "Theodore Cashanan", 2: "Odessa Tafimoft", 3: "T. Cashanan", 4: "Hon. Tafimoft", 5: "ODESSA TAFIMOFT", 6: None, 7: "An Hon. Member", 8: "Speaker 1", 9: "SPEAKER_01"}
    assert ends(spark, rows, labels) == [(0, 0), (1, 4), (5, 5), (6, 6), (7, 8), (9, 10), (11, 12)]


def test_order_is_spoken_time(spark):
    rows = [(0, 0, "0m30s", "a."), (1, 0, "0m10s", "b."), (2, 0, "0m10.7s", "c."), (2, 1, None, "d.")]
    labels = {0: "Theodore Cashanan", 1: "Odessa Tafimoft", 2: "O. Tafimoft"}
    assert ends(spark, rows, labels) == [(0, 0), (1, 3)]
    text = {r["first_sentence_id"]: r["text"] for r in turns.turns(*made(spark, rows, labels)).collect()}
    assert text == {0: "a.", 1: "b. c. d."}


def test_repeats_and_missing_blocks(spark):
    s, b, p = made(spark, [(0, 0, "0m1s", "a."), (1, 0, "0m2s", "b.")], {0: "Odessa Tafimoft"})
    again = s.withColumn("created_at", F.lit(T + dt.timedelta(days=20)))
    late = b.withColumn("created_at", F.lit(T + dt.timedelta(days=20)))
    assert sorted(tuple(r) for r in turns.turn_ends(s.unionByName(again), b.unionByName(late), p).collect()) == [(0, 0), (1, 1)]
    assert turns.turn_ends(s.limit(0), b.limit(0), p.limit(0)).count() == 0


def test_boosted_trees_learn_and_score_alike(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, size=(4000, 4)).astype(float)
    y = ((x[:, 0] == 0) & (x[:, 1] == 1) | (x[:, 2] == 1) & (x[:, 3] == 0)).astype(float)
    m = turns.BoostedTrees(x[:3000], y[:3000], np.ones(3000), trees=30)
    held = m.score(x[3000:])
    assert ((held > 0) == (y[3000:] == 1)).mean() > 0.98
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[3000:3100]], "a double, b double, c double, d double")
    assert np.allclose([r[0] for r in df.selectExpr(m.sql(["a", "b", "c", "d"])).collect()], held[:100])


def test_fillers_are_judged_by_how_they_stand():
    # hesitations are set off most of the time, words seldom; one phrase is used like the ones, the other like the others
    rows = [(f, 1000, 100, 500, 60) for f in ("um", "uh", "er", "erm", "ah")] + [(f"word{c}", 1000, 60, 50, 3) for c in "abcdefgh"] + [("you know", 400, 40, 190, 30), ("i mean", 400, 24, 16, 1)]
    m = turns.FillerModel(rows)
    assert m.is_filler("you know", False, True) and m.is_filler("uh", False, False) and not m.is_filler("i mean", False, False) and not m.is_filler("worda", True, True)
    assert "you know" in m.pattern() and m.pattern().count("i mean") < 4
    # without data the list holds
    assert turns.FillerModel([]).is_filler("um", False, True) and turns.FillerModel([]).is_filler("you know", True, True)


def test_units_know_their_marks(spark):
    got = spark.createDataFrame([("Well, um, we — you know — [noise] agree",)], "t string").select(F.explode(turns._units(F.col("t"))).alias("u")).select("u.*").collect()
    assert [tuple(r) for r in got if r["form"] in ("um", "we", "you know", "agree")] == [("um", True, True), ("we", True, True), ("agree", True, True), ("you know", True, True)]


def test_trees_decide_where_the_registry_does_not(spark):
    # nobody of these is registered: equal labels and fitting initials go on, others end the turn
    rows = [(0, 0, "0m1s", "a."), (1, 0, "0m5s", "b."), (2, 0, "0m9s", "c."), (3, 0, "0m12s", "d.")]
    labels = {0: "Zebulon Quorn", 1: "Z. Quorn", 2: "Mathilda Brack", 3: "Mathilda Brack"}
    assert ends(spark, rows, labels) == [(0, 1), (2, 3)]
