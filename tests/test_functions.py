import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plenum.functions import search, similarity, text
from plenum.operators.fuzzy import lcs, ratio, similar_names


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.withColumn("o", make(F.col("v"))).orderBy("i").select("o").collect()]


def test_time_to_seconds(spark):
    given_ = ["5m30s", "1h15m20s", "30s", "30.7s", "30", "1m30", "1h", "", None, "h", "xh1m"]
    assert column(spark, given_, text.time_to_seconds) == [330, 4520, 30, 30, 0, 60, 3600, 0, None, None, None]


def test_time_round_trip(spark):
    seconds = list(range(0, 8000, 37)) + [3600, 7200, 86399]
    df = spark.createDataFrame([(s,) for s in seconds], "s bigint")
    assert df.filter(text.time_to_seconds(text.seconds_to_time(F.col("s"))) != F.col("s")).count() == 0
    assert column(spark, [0, 59, 60, 3600, 4520], text.seconds_to_time, "bigint") == ["0s", "59s", "1m0s", "1h0m0s", "1h15m20s"]


def test_names(spark):
    names = ["Hon. Dr. A. Smith", "the honourable x", "Drake", "Sirius", "reverend jones", "José O'Neil-X.", None, "  "]
    assert column(spark, names, text.normalize_name) == ["a smith", "x", "ake", "ius", "erend jones", "josé oneil-x", None, ""]
    assert column(spark, names, lambda c: text.normalize_name(c, "word")) == ["a smith", "x", "drake", "sirius", "reverend jones", "josé oneil-x", None, ""]
    assert column(spark, ["Ann Lee", "  ", "x"], text.surname) == ["lee", "", "x"]


def test_identifiers(spark):
    row = spark.sql("SELECT date'2026-01-06' AS d, '' AS none, '125' AS n").select(
        text.session_id(F.col("n"), F.col("d")), text.session_id(F.col("none"), F.col("d")), text.order_paper_id(F.lit("house"), F.col("d")), text.agenda_item_id(F.lit("s_1"), F.lit(0))).first()
    assert list(row) == ["s_125_2026_01_06", "s_unknown_2026_01_06", "op_h_2026_01_06", "s_1_a0"]
    assert column(spark, ["https://a/watch?v=abc&t=1", "https://youtu.be/xyz?t=2", "https://a/b"], text.video_id) == ["abc", "xyz", None]
    assert column(spark, ["2026-01-20", "20 January 2026", "January 20, 2026", "soon", " 2026-01-20 "], text.parse_date) == ["2026-01-20"] * 3 + [None, "2026-01-20"]
    assert column(spark, ['a<b>:"c"/d\\e|f?g*h\x01'], text.sanitize_filename) == ["a_b___c__d_e_f_g_h_"]
    assert column(spark, ["/x.pdf", "http://y", ""], lambda c: text.absolute_url("http://b", c)) == ["http://b/x.pdf", "http://y", ""]


@settings(max_examples=150, deadline=None)
@given(st.text("abcx", max_size=14), st.text("abcx", max_size=14))
def test_lcs_against_table(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert lcs(a, b) == rows[-1][-1]


def test_fuzzy_ratio_expression(spark):
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("kitten", "sitting"), ("anna lee", "anne leigh"), (None, "a")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(similarity.fuzzy_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [100, 0, 100, ratio("kitten", "sitting"), ratio("anna lee", "anne leigh"), None]


def test_similar_names_is_exact(spark):
    import random

    rng = random.Random(4)
    base = ["water board trust", "harbour port trust", "small farmers fund", "clean water act", "a", "ab", ""]
    names = sorted({"".join(c for c in b if rng.random() > 0.1) + rng.choice(["", "s", " x"]) for b in base for _ in range(12)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for t in (80, 85):
        got = {(r["a"], r["b"]): r["ratio"] for r in similar_names(df, None, t).collect()}
        assert got == {(a, b): ratio(a, b) for a in names for b in names if ratio(a, b) >= t}
        two = {(r["a"], r["b"]) for r in similar_names(df, df, t).collect()}
        assert two == set(got)


def test_cosine(spark):
    df = spark.sql("SELECT array(1F, 0F) AS a, array(1F, 1F) AS b, array(0F, 0F) AS z")
    row = df.select(similarity.cosine(F.col("a"), F.col("b")), similarity.cosine(F.col("a"), F.col("z")), similarity.hybrid(F.lit(1.0), F.lit(None).cast("double"))).first()
    assert row[0] == pytest.approx(2**-0.5) and row[1] == 0.0 and row[2] == pytest.approx(0.3)


def test_search(spark):
    docs = spark.createDataFrame([(1, "Clean water, and water again"), (2, "water"), (3, None), (4, "the and of")], "i int, t string")
    v = docs.withColumn("v", search.lexemes(F.col("t")))
    assert [x["position"] for x in v.filter("i = 1").first()["v"]] == [1, 2, 4]
    assert {r[0] for r in v.filter(search.matches(F.col("v"), search.query_terms("the Water"))).select("i").collect()} == {1, 2}
    assert v.filter(search.matches(F.col("v"), [])).count() == 0
    ranks = {r[0]: r[1] for r in v.select("i", search.rank(F.col("v"), "water")).collect()}
    assert ranks[2] == pytest.approx(0.0607927, abs=1e-6) and ranks[1] == pytest.approx(0.0607927 * 1.25, abs=1e-6) and ranks[4] == 0


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
    ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"),
    ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("yes", "ye"), ("us", "us"), ("école", "école")])
def test_stems(spark, word, want):
    from plenum.functions.search import stem

    assert spark.range(1).select(stem(F.lit(word))).first()[0] == want
