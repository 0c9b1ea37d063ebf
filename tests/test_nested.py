import json

from plenum.operators import nested

COLUMNS = "session_id string, raw_transcript_json string, path string, v string"


def nodes(spark, texts, papers=()):
    s = spark.createDataFrame([(f"s{i}", t, "clash", "clash") for i, t in enumerate(texts)], COLUMNS)
    p = spark.createDataFrame([(f"p{i}", a, b) for i, (a, b) in enumerate(papers)], "order_paper_id string, speakers string, agenda_items string")
    return {tuple(r) for r in nested.node_index(s, p).collect()}


def test_shapes_and_wrappers(spark):
    doc = {"agenda_items": [{"speech_blocks": [{"sentences": [{"text": "a"}, None, "b"]}, None]}, None, "x"]}
    want = {("agenda_item", "0"), ("agenda_item", "2"), ("speech_block", "0.0"), ("sentence", "0.0.0"), ("sentence", "0.0.2")}
    plain = json.dumps(doc)
    texts = [plain, "﻿ " + plain, f"```json\n{plain}\n```", json.dumps(plain), json.dumps({"transcript": doc}), json.dumps([doc]), f"Here it is: {plain} thanks", f"A list [1]:\n```\n{plain}\n``` {{end}}",
             json.dumps({"agendaItems": [{"speechBlocks": [{"Sentences": [{"text": "a"}, None, "b"]}, None]}, None, "x"]})]
    got = nodes(spark, texts)
    for i in range(len(texts)):
        assert {(k, p) for r, k, p in got if r == f"s{i}"} == want, texts[i][:40]


def test_no_document(spark):
    doc = json.dumps({"agenda_items": [{"speech_blocks": [{"sentences": [{"text": "a"}]}]}]})
    assert nodes(spark, [None, "", "   ", "no json", doc[:-3], "[]", "{}", "null", '"text"', "12"]) == set()


def test_single_values_and_repeats(spark):
    doc = json.dumps({"agenda_items": {"speech_blocks": {"sentences": {"text": "a"}}}})
    got = nodes(spark, [doc])
    assert got == {("s0", "agenda_item", "0"), ("s0", "speech_block", "0.0"), ("s0", "sentence", "0.0.0")}
    twice = spark.createDataFrame([("s", doc), ("s", doc), (None, doc)], "session_id string, raw_transcript_json string")
    assert nested.transcript_nodes(twice).count() == 3
    empty = spark.createDataFrame([], "order_paper_id string, speakers string, agenda_items string")
    assert nested.node_index(twice, empty).count() == 6


def test_papers_any_depth(spark):
    item: dict = {"topic_title": "deep"}
    for _ in range(12):
        item = {"topic_title": "t", "sub_items": [item]}
    got = nodes(spark, [], [(json.dumps({"name": "A"}), json.dumps([item, {"subItems": {"topic_title": "only"}}])), ('["B", null, {"name": "C"}]', '"[{\\"topic_title\\": \\"x\\"}]"'), ('"Jo Doe"', '"[{\\"topic_ti"'), (None, None)])
    assert ("p0", "paper_speaker", "0") in got and ("p0", "paper_item", ".".join(["0"] * 13)) in got and ("p0", "paper_item", "1.0") in got
    assert {p for r, k, p in got if r == "p1" and k == "paper_speaker"} == {"0", "2"}
    assert {(k, p) for r, k, p in got if r == "p1" and k == "paper_item"} == {("paper_item", "0")}
    assert {(k, p) for r, k, p in got if r == "p2"} == {("paper_speaker", "0")}


def test_tables_know_their_parents(spark, small):
    t = nested.transcript_tables(spark.read.parquet(f"{small}/sessions.parquet"))
    orphans = t["sentences"].join(t["speech_blocks"].selectExpr("record_id", "node_path AS parent_path"), ["record_id", "parent_path"], "left_anti")
    assert t["sentences"].count() > 0 and orphans.count() == 0
    p = nested.paper_tables(spark.read.parquet(f"{small}/order_papers.parquet"))
    assert p["paper_speakers"].filter("name IS NOT NULL").count() > 0 and p["paper_items"].filter("topic_title IS NOT NULL").count() > 0
