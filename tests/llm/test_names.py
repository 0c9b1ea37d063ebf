import datetime as dt

import pytest
from pyspark.sql import functions as F

from plenum.llm import names

T = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("label, want", [
    ("Hon. Cáshanan", ("person", None, "", "cashanan")), ("Cáshanan, T. E.", ("person", None, "te", "cashanan")), ("TE.Cáshanan", ("person", None, "te", "cashanan")), ("Dr the Hon O Tafimoft", ("person", None, "o", "tafimoft")),
    ("Ms. Yaleline, Minister of Health", ("person", None, "", "yaleline")), ("Leonard Gekivow, M.P.", ("person", "leonard", "l", "gekivow")), ("Clabugan,Rosalind", ("person", "rosalind", "r", "clabugan")),
    ("DR.Quiguday", ("person", None, "dr", "quiguday")), ("Fatuline, Q. C.", ("person", None, "qc", "fatuline")), ("Dr. Quiguday", ("person", None, "", "quiguday")),
    (" Ann   Lee ", ("person", "ann", "a", "lee")), ("ANN LEE (Minister of Health)", ("person", "ann", "a", "lee"))])
def test_people(label, want):
    assert names.parse(label)[:4] == want


@pytest.mark.parametrize("label, kind", [(None, "nobody"), ("", "nobody"), ("???", "nobody"), ("[crowd]", "nobody"), ("An Hon. Member", "nobody"), ("Hon. Member (name not caught)", "nobody"), ("Unknown Speaker", "nobody"),
                                         ("SPEAKER_07", "number"), ("speaker 7", "number"), ("Mr. Speaker (in the Chair)", "presiding"), ("Madame President:", "presiding"), ("the speaker:", "presiding"), ("Minister of Finance", "office")])
def test_kinds(label, kind):
    assert names.parse(label)[0] == kind


def test_organisations():
    same = ["Grekoban Port & Harbour Trust", "The Grekoban Port & Harbour Trust", "Harbour and Port Trust, Grekoban", "GREKOBAN PORT AND HARBOUR TRUST (witness)"]
    assert len({tuple(names.parse(x)[5]) for x in same}) == 1
    assert names.parse("Federation of Small Farmers (Soltirine)")[5] == names.parse("Soltirine Small Farmers Fed.")[5]
    assert names.parse("Grekoban P.&H. Trust")[5] == ["=hp", "grekoban", "trust"] and names.parse("Yemudow C. of C.")[5] == ["=cc", "yemudow"]
    assert names.parse("Ann Lee M.P.")[0] == "person" and names.parse("Lee, A. B.")[0] == "person"


def speakers(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, T, "x", "y") for r in rows], "canonical_id string, name string, aliases array<string>, session_ids array<string>, role string, party string, chamber string, title string, created_at timestamp, who string, label string")


def blocks(spark, rows):
    return spark.createDataFrame([(i, s, l, T) for i, (l, s) in enumerate(rows)], "block_id long, session_id string, speaker_name string, created_at timestamp")


PEOPLE = [("r1", "Theodore Cashanan", ["T. Cashanan", "Theo Cashanan", None], ["s1", "s2"]), ("r2", "Cashanan, Theo", [], ["s1"]), ("r3", "Odessa Tafimoft", None, ["s1"]), ("r4", "Oliver Tafimoft", None, ["s2"]),
          ("r5", "Water Board Trust", None, None), ("r6", "THE WATER BOARD TRUST (witness)", [""], ["s9"]), ("r7", None, None, None)]


def test_links(spark):
    labels = [("Theodore Cashanan", "s9"), ("Cashanan", "s1"), ("Mr. Tafimoft", "s1"), ("O. Tafimoft", "s2"), ("O. Tafimoft", "s9"), ("Tafimoft", "s9"), ("Mr. Speaker", "s1"), ("???", "s1"), (None, "s1"), ("Water Board Trust", None), ("Theodroe Cashanan", "s1")]
    labels += [("Theodore Cashanan", "s1")] * 30
    got = {tuple(r) for r in names.linked(speakers(spark, PEOPLE), blocks(spark, labels)).collect()}
    mine = {b: {k.split(":")[1] for x, k in got if x == f"block:{b}"} for b in range(11)}
    assert mine == {0: {"r1", "r2"}, 1: {"r1", "r2"}, 2: {"r3"}, 3: {"r4"}, 4: set(), 5: set(), 6: set(), 7: set(), 8: set(), 9: {"r5", "r6"}, 10: {"r1", "r2"}}
    assert {(a, b) for a, b in got if a.startswith("speaker")} == {("speaker:r1", "speaker:r2"), ("speaker:r5", "speaker:r6")}


def test_organisations_with_a_word_more_or_less(spark):
    rows = [("r1", "Grekoban Port and Harbour Trust", [], []), ("r2", "Grekoban Port Trust", [], []), ("r3", "Birrugard Port and Harbour Trust", [], []), ("r4", "Soltirine Teachers Union", [], []), ("r5", "Grekoban Water Company", [], [])]
    labels = ["Soltirine Primary Teachers Union", "Port and Harbour Trust", "Soltirine Nurses Association", "Soltirine Port and Harbour Trust", "Grekoban Port and Harbour Trust"]
    got = {tuple(r) for r in names.linked(speakers(spark, rows), blocks(spark, [(x, "s1") for x in labels])).collect()}
    assert got == {("speaker:r1", "speaker:r2"), ("block:0", "speaker:r4"), ("block:4", "speaker:r1"), ("block:4", "speaker:r2")}


def test_initials_without_sessions_follow_the_role(spark):
    rows = [("a", "Cosmo Drofemow", [], ["s1"]), ("b", "Catherine Drofemow", [], ["s2"]), ("c", "The Hon C Drofemow", [], [])]
    people = speakers(spark, rows).withColumn("role", F.when(F.col("canonical_id") == "b", "Clerk").otherwise("Minister of Health"))
    assert {tuple(r) for r in names.linked(people, blocks(spark, [])).collect()} == {("speaker:a", "speaker:c")}


def test_empty(spark):
    assert names.linked(speakers(spark, []), blocks(spark, [])).count() == 0
    assert names.linked(speakers(spark, PEOPLE), blocks(spark, [])).count() == 2
    assert names.linked(speakers(spark, []), blocks(spark, [("Ann Lee", "s")])).count() == 0


def test_organisations_by_initials_and_stems(spark):
    rows = [("r1", "Grekoban Port and Harbour Trust", [], []), ("r2", "Grekoban P.&H. Trust", [], []), ("r3", "Grekoban Teachers' Union", ["Grekoban T.U."], []), ("r4", "Soltirine Fishing Cooperative", [], []), ("r5", "Soltirine Teachers' Union", [], []), ("r6", "Grekoban Fishing Cooperative", [], []), ("r7", "Yemudow Fishing Cooperative", [], [])]
    labels = ["Grekoban T.U.", "Cooperative of Soltirine fishermen", "Grekoban N.A.", "Soltirine T.U."]
    got = {tuple(r) for r in names.linked(speakers(spark, rows), blocks(spark, [(x, "s1") for x in labels] + [("Soltirine Fishing Cooperative", "s1")] * 3)).collect()}
    mine = {b: {y for x, y in got if x == f"block:{b}"} for b in range(4)}
    assert mine == {0: {"speaker:r3"}, 1: {"speaker:r4"}, 2: set(), 3: {"speaker:r5"}} and ("speaker:r1", "speaker:r2") in got


def test_short_forms_are_learned(spark):
    # Drew stands beside Andrew in two rows; Bill speaks twice where William alone attended; Kim does once
    rows = [("a", "Andrew Golo", ["Drew Golo"], []), ("b", "Andrew Hape", ["Drew Hape", "Andrwe Hape"], []), ("c", "William Isu", [], ["s1", "s2", "s3"]), ("d", "William Jar", [], ["s4"]), ("e", "Odessa Jar", [], ["s5"])]
    labels = [("Bill Isu", "s1"), ("Bill Jar", "s4"), ("Kim Isu", "s2"), ("Drew Golo", None), ("Bill Jar", "s5"), ("Bill Isu", "s9")]
    reg = names.Registry(speakers(spark, rows), spark.createDataFrame([(l, s, 1) for l, s in labels], "label string, session_id string, n long"))
    assert {tuple(r) for r in reg.shorts.collect()} == {("drew", "andrew"), ("bill", "william")}
    got = {tuple(r) for r in names.linked(speakers(spark, rows), blocks(spark, labels)).collect()}
    assert {(a, b) for a, b in got if a.startswith("block")} == {("block:0", "speaker:c"), ("block:1", "speaker:d"), ("block:3", "speaker:a"), ("block:4", "speaker:d"), ("block:5", "speaker:c")}


def test_equally_frequent_spellings_meet(spark):
    # one row each, and nothing but the surname's spelling apart; the other pair has given names of its own
    rows = [("a", "Theodore Cashanan", [], ["s1"]), ("b", "Theodore Cashannan", [], ["s1"]), ("c", "Odessa Tafimoft", [], ["s1"]), ("d", "Quincy Tafimort", [], ["s1"])]
    assert {tuple(r) for r in names.linked(speakers(spark, rows), blocks(spark, [])).collect()} == {("speaker:a", "speaker:b")}
